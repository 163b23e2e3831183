"""Fill-in-the-middle, tokenizer alignment and chat formatting against brute force and round trips."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter
from itertools import pairwise

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postpulse.llm import align, catalogue, chat, infill, tokens
from postpulse.llm.tokens import default_tokenizer
from tests.compare import canonical, connection
from tests.llm.conftest import CLASHING, make


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_chat_formatting"])
def test_matches_sql(spark, sf_dir, name):
    frame = catalogue.queries()[name](spark, sf_dir)
    answer = connection(sf_dir).execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert canonical(frame.columns, [tuple(r) for r in frame.collect()]) == canonical(
        columns, answer.fetchall()
    )


# Operator 11

ODD = ["😀a\n😀", "a<P>b", "<M>", "<<S", "<S", "é" * 50, " \r\n\x00x", "P>", "a<", "><P", "퟿\U0010ffff"]


def arranged(doc_id, text, spec=infill.Infill(), units=list):
    text, raw = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(raw[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units(text))
    if not text or any(s in text for s in spec.sentinels()) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    low, high = sorted(x % (n + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (units(text)[:low], units(text)[low:high], units(text)[high:]))
    if h[3] % 100 < 20:
        return doc_id, n, "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_arrange(spark, corpus):
    rows = [*corpus, *corpus[:4], (None, "no id"), (None, None)]
    rows += [(1_000 + k, t) for k, t in enumerate(ODD * 20)]
    found = infill.arrange(make(spark, rows))
    kept = found.select("*", infill.restored(F.col("output"), F.col("form")).alias("again")).collect()
    wanted = [arranged(*r) for r in rows]
    assert sorted(map(str, (tuple(r)[:-1] for r in kept))) == sorted(map(str, wanted))
    assert Counter(r.again for r in kept) == Counter(t or "" for _, t in rows)
    assert {r.form for r in kept} == {"plain", "psm", "spm"}


def test_arrange_words(spark, corpus):
    import re

    spec = infill.Infill(unit=infill.WORDS)
    found = infill.arrange(make(spark, corpus), spec).collect()
    wanted = [arranged(*r, spec, lambda t: re.findall(spec.unit, t, re.ASCII)) for r in corpus]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))


def test_arrange_nothing(spark, no_documents):
    assert infill.arrange(no_documents).collect() == []


@pytest.mark.parametrize("wrong", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "<<S>", "<M>"), ("P", "<P", "M")])
def test_sentinels_that_could_be_misread(wrong):
    with pytest.raises(ValueError):
        infill.Infill(*wrong)


def test_arrange_stays_in_spark(spark, documents):
    found = infill.arrange(documents)
    plan = found.select(infill.restored(F.col("output"), F.col("form")))._jdf.queryExecution().executedPlan()
    assert not any(x in plan.toString() for x in ("Python", "Arrow", "Exchange"))


# Operator 12


def brute_alignment(rows):
    """Every pair of tokens of a text compared by byte ranges."""
    from sentencepiece import SentencePieceProcessor

    a_side = Tokenizer.from_file(default_tokenizer())
    a_side.encode_special_tokens = True
    b_side = SentencePieceProcessor(model_file=align.default_pieces())
    import public_tokenizers

    lines = map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))
    a_bytes = {int(rank): base64.b64decode(token) for token, rank in lines}

    def spans(ids, lengths):
        ends = [0]
        for k in ids:
            ends.append(ends[-1] + lengths(k))
        return list(pairwise(ends))

    def b_bytes(k):
        piece = b_side.id_to_piece(k)
        return bytes.fromhex(piece[3:5]) if b_side.is_byte(k) else piece.replace("▁", " ").encode()

    docs = []
    for doc_id, text in rows:
        a = a_side.encode(f" {text or ''}", add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        joined = b"".join(map(b_bytes, b))
        if not text or joined != f" {text}".encode() or b"".join(a_bytes[k] for k in a) != joined:
            docs.append((doc_id, [], [], [], ""))
            continue
        at_a, at_b = spans(a, lambda k: len(a_bytes[k])), spans(b, lambda k: len(b_bytes(k)))
        links, first = [], 0
        for k, (s, e) in zip(a, at_a, strict=True):
            while at_b[first][1] <= s:
                first += 1
            j = first
            while j < len(b) and at_b[j][0] < e:
                links.append((k, b[j]))
                j += 1
        groups, x, y = [], 0, 0
        for end in sorted({e for _, e in at_a} & {e for _, e in at_b}):
            ga, gb = [], []
            while x < len(a) and at_a[x][1] <= end:
                ga.append(str(a[x]))
                x += 1
            while y < len(b) and at_b[y][1] <= end:
                gb.append(str(b[y]))
                y += 1
            groups.append(f"{','.join(ga)}|{','.join(gb)}")
        docs.append((doc_id, a, b, links, ";".join(groups)))
    counts = Counter(link for d in docs for link in d[3])
    best: dict[int, int] = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return [
        (
            doc_id, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links),
            sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
            digest(groups) if groups else "",
        )
        for doc_id, a, b, links, groups in docs
    ]


#: A sentencepiece mark that is text, strings of special tokens, characters without a piece, blanks.
TEXTS = ["▁", "a▁b", "<|endoftext|> x <s></s><0x0A>", "日本語 の", "😀😀 x", "a  b   c", " \n\t ", "ﬁ①", "\x00", "naïve café"]


def test_ranks_encode_as_the_library():
    tokens.check_ranks(default_tokenizer())
    library, ranked = Tokenizer.from_file(default_tokenizer()), tokens.ranked_encoder(default_tokenizer())
    library.encode_special_tokens = True
    points = [c for c in range(1, 0x110000, 41) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}! {chr(c)}'s" for c in points] + TEXTS
    assert [x.ids for x in library.encode_batch(texts, add_special_tokens=False)] == [
        ranked.encode_ordinary(t) for t in texts
    ]


@pytest.mark.parametrize("frequent", [align.FREQUENT, 40, 1])
def test_alignment(spark, corpus, frequent):
    rows = [*corpus, *corpus[:4], (None, corpus[0][1]), (None, None), *[(900 + k, t) for k, t in enumerate(TEXTS)]]
    found = align.alignment_report(make(spark, rows).repartition(5), frequent=frequent)
    assert Counter(map(tuple, found.collect())) == Counter(brute_alignment(rows))


def test_alignment_over_slices(corpus):
    texts = [t for _, t in corpus]
    cut = list(align.slices(align.np.array([len(t or "") for t in texts]), 500))
    assert len(cut) > 20 and [s for s, _ in cut[1:]] == [e for _, e in cut[:-1]]
    both = align.Tokenizers.default().loaded()
    whole = align._aligned(both, *zip(*both.encode(texts), strict=True))
    parts = [align._aligned(both, *zip(*both.encode(texts[s:e]), strict=True)) for s, e in cut]
    for name in ("link_bounds", "group_bounds"):
        sizes = align.np.concatenate([align.np.diff(getattr(p, name)) for p in parts])
        assert (sizes == align.np.diff(getattr(whole, name))).all()


def test_alignment_of_nothing(spark, no_documents):
    assert align.alignment_report(no_documents).collect() == []


def test_alignment_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = catalogue.op12_token_alignment(spark, sf_dir)
    assert Counter(map(tuple, found.collect())) == Counter(brute_alignment(rows))


def test_few_pairs_are_broadcast(spark):
    counts = spark.createDataFrame([(k, 1 + 1000 // (k + 1)) for k in range(500)], "pair long, n long")
    highest = counts.groupBy((F.col("pair") % 10).alias("b")).agg(F.max("n").alias("highest"))
    known = align.frequent_pairs(counts, highest, 10, 20)
    total = sum(1 + 1000 // (k + 1) for k in range(500))
    assert 0 < len(known.pairs) <= 20 and known.least == -(-total // 20)
    assert known.of(align.np.array([0, 499, 7])).tolist() == [1001, 0, 126 if 126 >= known.least else 0]


# Operator 13

TEMPLATE = chat.Template()


def escaped(text: str) -> str:
    import re

    firsts = {c[0] for c in TEMPLATE.controls()}
    for first in firsts:
        rest = "|".join(re.escape(c[1:]) for c in TEMPLATE.controls() if c[0] == first)
        text = re.sub(rf"({re.escape(first)})(\\*)(?={rest})", r"\1\\\2", text)
    return text


def conversations(spark, rows):
    filled = [(*r, 1, 2, "k", "c", 3.0, "o") for r in rows]
    return spark.createDataFrame(filled, f"conv_id long, turn long, role string, text string, {CLASHING}")


def brute_chat(rows):
    found = {}
    for conv, turn, role, text in sorted(
        rows, key=lambda r: (r[1] is not None, r[1] or 0, f"[INST]{escaped(r[2] or '')}[/INST]", escaped(r[3] or ""))
    ):
        found.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in found.items():
        formatted = "".join(f"[INST]{escaped(r)}[/INST]{escaped(t)}</s>" for r, t in turns)
        out[conv] = (formatted, turns, "".join(t for r, t in turns if r == "assistant"))
    return out


def test_chat_round_trip(spark):
    draw = random.Random(9)
    bits = [*TEMPLATE.controls(), "\\", "<", "[", "/", "s>", "INST]", "é", "😀", "\n", " ok ", "$1", "[\\INST]", "<\\\\/s>"]
    rows = []
    for conv in range(40):
        for turn in range(draw.randint(1, 9)):
            text = "".join(draw.choices(bits, k=draw.randint(0, 12)))
            rows.append((conv, turn, draw.choice(["user", "assistant", "system", "</s>x"]), text))
    rows += [(50, 0, None, None), (50, None, "assistant", None), (None, 1, "assistant", "x"), (None, 0, "user", "")]
    rows += [(51, 0, "user", "same"), (51, 0, "user", "same"), (51, 1, "assistant", "long " * 30_000)]
    rows += [(52, 3, "assistant", "b"), (52, 3, "assistant", "a"), (52, 2, "tool", "[INST]")]
    found = chat.read_back(chat.format_conversations(conversations(spark, rows).repartition(3))).collect()
    wanted = brute_chat(rows)
    assert len(found) == len(wanted)
    for r in found:
        formatted, turns, loss = wanted[r.conv_id]
        assert r.formatted == formatted
        assert [tuple(t) for t in r.read_turns] == turns
        assert r.loss_text == loss and r.attachments == [] and r.media_tokens == 0
        spans = ["".join(r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert spans == [escaped(t) for role, t in turns if role == "assistant"]
        for control in TEMPLATE.controls():
            times = len(turns) if control in (TEMPLATE.opens, TEMPLATE.between, TEMPLATE.closes) else 0
            assert r.formatted.count(control) == times


def test_chat_media_in_markdown(spark):
    photo, talk, paper = "![a </s> cat](x/y.png#w=640&h=480)", "![](t.mp3#t=2.5)", "![p](p.pdf#pages=3)"
    rows = [
        (1, 0, "user", f"see {photo}{talk} and ![no](http://x/y) or ](z"),
        (1, 1, "assistant", f"{paper}[IMAGE] </s>"),
        (1, 2, "assistant", "![q](q.jpeg)"),
        (2, 0, "user", "none"),
    ]
    found = {r.conv_id: r for r in chat.read_back(chat.format_conversations(conversations(spark, rows))).collect()}
    one = found[1]
    assert one.formatted == (
        "[INST]user[/INST]see [IMAGE][AUDIO] and ![no](http://x/y) or ](z</s>"
        "[INST]assistant[/INST][DOCUMENT][\\IMAGE] <\\/s></s>[INST]assistant[/INST][IMAGE]</s>"
    )
    assert [tuple(t) for t in one.read_turns] == [r[2:] for r in rows[:3]]
    assert one.loss_text == rows[1][3] + rows[2][3]
    assert [(a.kind, a.ref, a.tokens) for a in one.attachments] == [
        ("image", "x/y.png#w=640&h=480", 23 * 18), ("audio", "t.mp3#t=2.5", 63),
        ("document", "p.pdf#pages=3", 3_000), ("image", "q.jpeg", 256),
    ]
    assert one.media_tokens == 23 * 18 + 63 + 3_000 + 256 and found[2].attachments == []


def test_chat_typed_parts(spark):
    parts = [
        ("text", "look: [IMAGE]", None, None, None, None, None),
        ("image", "alt", "s3/a", 28, 29, None, None),
        (None, "untyped", None, None, None, None, None),
        ("audio", None, "s3/b", None, None, None, None),
        ("video", "unknown type", "s3/c", None, None, None, None),
        ("document", None, None, None, None, None, 2),
        None,
    ]
    rows = [(7, 0, "assistant", parts), (7, 1, "user", None), (7, 2, "user", [])]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<struct<{chat.PART.replace(' ', ':')}>>".replace(",:", ","))
    (one,) = chat.read_back(chat.format_conversations(frame, parts_col="parts")).collect()
    assert one.formatted == (
        "[INST]assistant[/INST]look: [\\IMAGE][IMAGE]untyped[AUDIO]unknown type[DOCUMENT]</s>"
        "[INST]user[/INST]</s>[INST]user[/INST]</s>"
    )
    assert [(a.kind, a.ref, a.tokens) for a in one.attachments] == [
        ("image", "s3/a", 2), ("audio", "s3/b", 750), ("document", "", 2_000)
    ]
    assert one.read_turns[0].text == "look: [IMAGE]![alt](s3/a)untyped![](s3/b)unknown type![]()"


def test_chat_of_nothing(spark):
    assert chat.format_conversations(conversations(spark, [])).collect() == []


def test_chat_stays_in_spark(spark, sf_dir):
    plan = catalogue.op13_chat_formatting(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "ExistingRDD")) and plan.count("Exchange") == 1


@pytest.mark.parametrize("wrong", [{"opens": ""}, {"opens": "[a[b"}, {"closes": "<\\x"}, {"image": "[INST]"}])
def test_templates_that_could_be_misread(wrong):
    with pytest.raises(ValueError):
        chat.Template(**wrong)
