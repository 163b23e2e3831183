"""Personal data, toxicity and mixing."""

from __future__ import annotations

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from postpulse.llm import crf, mixing, pii, toxicity
from postpulse.llm.common import span_digest
from tests.llm.conftest import make


def brute(text: str) -> list[tuple[int, int, str]]:
    found = [
        (m.start(), 0, m.end())
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)
    ]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(s, e, pii.BASE_KINDS[k]) for s, k, e in sorted(found)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+- 0123456789()é%", max_size=70))
def test_base_spans_match_re(text):
    assert pii.base_spans(text) == brute(text)


def test_long_runs_stay_linear():
    assert pii.base_spans("1" * 200_000) == []
    assert pii.base_spans("a@" * 100_000) == []
    assert pii.base_spans("+1" * 50_000) == []


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def path_score(field, words, labels):
    forms = [crf.shape(w) for w in words]
    classes = [crf.EDGE, *map(crf.shape_class, forms), crf.EDGE]
    none = np.zeros(len(field.labels))
    total, before = 0.0, 0
    for t, label in enumerate(labels):
        own = sum(field.own.get(f, none)[label] for f in crf.features(forms[t]))
        own += field.left.get(classes[t], none)[label] + field.right.get(classes[t + 2], none)[label]
        total += own + field.moves[before, label]
        before = label
    return total + field.moves[before, 0]


def test_viterbi_is_exact():
    """The decoded path has the best score of all paths, pruning included."""
    from itertools import product

    field = pii.trained_field()
    draw = random.Random(2)
    pool = "the 555-0123 (555) 12 AB123456 1999. 1234 X9X end, 078-05-1120 | Q+1".split()
    texts = [draw.choices(pool, k=draw.randint(1, 6)) for _ in range(60)] + [[]]
    for words, runs in zip(texts, crf.Decoder(field).decode(texts), strict=True):
        labels = [0] * len(words)
        for first, end, label in runs:
            labels[first:end] = [label] * (end - first)
        if words:
            best = max(path_score(field, words, p) for p in product(range(len(field.labels)), repeat=len(words)))
            assert abs(path_score(field, words, labels) - best) < 1e-9


#: Lines that no training line was made from, marked as those are.
HELD_OUT = """
You can phone us on 0161/phone 496/phone 0321/phone until six
home: (415)/phone 555-0142/phone, work later
ring 212-555-0199/phone before Friday
her mobile is 07911/phone 123456/phone I think
Fax: 303.555.0188/phone.
the desk answers at +31/phone 20/phone 555/phone 0123/phone only
(312)/phone 555-0155/phone or nothing
Tel (0221)/phone 4455-778/phone Cologne
his social security number, 219-09-9999/id, leaked
applicant 987-65-4321/id was refused
a passport XK7654321/id and a visa
IBAN: NL91ABNA0417164300/id for rent
send it to DE44/id 5001/id 0517/id 5407/id 3249/id now
national insurance QQ/id 12/id 34/id 56/id again
visa 4012888888881881/card declined
charged 5105/card 1051/card 0510/card 5100/card twice
number 6011-1111-1111-1117/card on the back
Mail me: pat.lee7@news.example.net/email!
ask bob_k@shop.example/email today
reply to first.last+tag@deep.sub.example.org/email or wait
(support-42@help.example.com)/email replied
server 203.0.113.77/ip went down
ping 198.51.100.4/ip and 192.0.2.235/ip again
blocked 127.0.0.1:5432/ip there
gateway 2001:db8:85:12:9:8a2e:370:7334/ip set
Nobody knew what the committee had decided, or why.
CLOSED FOR THE SUMMER. PLEASE COME BACK IN AUTUMN!
Founded in 1887, it had 340 members by 1920.
prices rose 4.7% to 1,350 dollars (from 1,290)
see section 3.2.1 and figure 14b
meet at 18:45 on 12/06/2021, room 204
Windows 95, Python 3.11.4 and Java 21
a 1920x1080 screen at 60 Hz for $249.00
visit https://docs.example.org/v2/page#top now
games ended 3-1, 2-2 and 0-4
5 apples, 12 pears, 700 nuts
ISBN 0-306-40615-2 (paperback)
J. K. Lee and M. O'Neil's "Big Book"
C++ and C# or F# [sic] @ work
hash 9f86d081884c7d65 of the file
from A to B via C and D
"""


def test_field_on_held_out_lines():
    """Spans of lines written apart from the training table: exact spans and kinds count."""
    decoder, labels = crf.Decoder(pii.trained_field()), pii.trained_field().labels
    right = found = wanted = 0
    for words, marks in pii.labelled_table(HELD_OUT):
        runs = [(k, x) for k, x in enumerate(marks) if x != "O"]
        truth = set()
        for k, x in runs:
            if k and marks[k - 1] == x:
                continue
            end = next((n for n in range(k, len(marks)) if marks[n] != x), len(marks))
            truth.add((k, end, x))
        got = {(a, b, labels[x]) for a, b, x in decoder.decode([words])[0]}
        right, found, wanted = right + len(got & truth), found + len(got), wanted + len(truth)
        if got != truth:
            print(words, got ^ truth)
    precision, recall = right / found, right / wanted
    print("precision", precision, "recall", recall)
    assert precision >= 0.9 and recall >= 0.85
    assert 2 * precision * recall / (precision + recall) >= 0.9


def test_field_finds_what_the_patterns_find(spark, sf_dir):
    """On whole documents: nine tenths of the base spans are spans of the field, with the same kind."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    same = F.size(F.filter("spans", lambda s: F.array_contains(
        F.col("field_spans"), F.struct(F.concat(F.lit("field_"), s["kind"]).alias("kind"), s["start"], s["end"]))))
    base = F.size(F.filter("spans", lambda s: ~s["kind"].startswith("field_")))
    row = pii.find_personal_data(docs).agg(F.sum(same), F.sum(base)).first()
    assert row[1] > 20 and row[0] / row[1] >= 0.9


def test_field_adds_what_the_patterns_miss(spark):
    text = "é call 555-867-5309 or (020) 7946 0991 now; her number is 078-05-1120. card 4111.1111.1111.1111 at 10.0.0.1"
    row = pii.find_personal_data(make(spark, [(1, text)])).first()
    found = {(s.kind, text[s.start : s.end]) for s in row.spans}
    assert found >= {("field_phone", "555-867-5309"), ("field_phone", "(020) 7946 0991"),
                     ("field_id", "078-05-1120"), ("field_card", "4111.1111.1111.1111"), ("ip", "10.0.0.1")}


def test_blocks_of_texts_change_nothing(monkeypatch):
    field = pii.trained_field()
    texts = ["a 078-05-1120 b", "", "call 555-867-5309", "x " * 50, "10.0.0.1"] * 3
    whole = list(pii._text_spans(texts, crf.Decoder(field), field.labels))
    monkeypatch.setattr(pii, "BLOCK_CHARS", 20)
    assert list(pii._text_spans(texts, crf.Decoder(field), field.labels)) == whole


def test_field_leaves_prose_alone(corpus):
    texts = [t.split() for _, t in corpus if t]
    assert not any(crf.Decoder(pii.trained_field()).decode(texts))


def test_personal_data_query(spark, corpus):
    rows = [*corpus, (500, "é a@b.co +1 (555) 010-2030 at 10.0.0.1 or 4111 1111 1111 1111 call 555-867-5309 x")]
    found = {r.doc_id: r for r in span_digest(pii.find_personal_data(make(spark, rows)), pii.BASE_KINDS).collect()}
    row = found[500]
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert "field_phone" in row.spans and row.spans.startswith("email:2:8,phone:9:26,ip:30:38")
    assert len(found) == len(rows)


def test_masking(spark, no_documents):
    frame = make(spark, [(1, "to a@b.co, now"), (2, None), (3, "clean")])
    found = {r.doc_id: r.text for r in pii.mask(frame).collect()}
    assert found == {1: "to <email>, now", 2: None, 3: "clean"}
    assert pii.mask(no_documents).count() == 0 and pii.find_personal_data(no_documents).count() == 0
    assert pii.masked("abcdef", [(1, 3, "x"), (2, 4, "y")]) == "a<x>ef"


def labelled(n=600, seed=1):
    draw = random.Random(seed)
    clean = ["".join(draw.choices("abdeilnorst", k=draw.randint(2, 9))) for _ in range(400)]
    bad = ["nastyfool", "vilescum"] + [f"grumbo{draw.choice(clean)}" for _ in range(60)]
    out = []
    for k in range(n):
        words = draw.choices(clean, k=draw.randint(5, 200))
        toxic = k % 5 == 0
        for _ in range(draw.randint(2, 12) if toxic else 0):
            words[draw.randrange(len(words))] = draw.choice(bad)
        out.append((words, int(toxic)))
    return out


def test_toxicity_on_held_out_documents():
    rows = labelled()
    model = toxicity.train(rows[:300])
    assert list(model.cuts) == sorted(model.cuts)
    scorer = toxicity._Scorer(model)
    scores = np.array([scorer.score(" ".join(w)) for w, _ in rows[300:]])
    grades = model.grades(scores)
    assert np.allclose(grades.sum(axis=1), 1) and (grades >= 0).all()
    called = grades[:, 0] < 0.5
    truth = np.array([t for _, t in rows[300:]], dtype=bool)
    assert called[truth].mean() > 0.95 and called[~truth].mean() < 0.01
    severe = grades @ np.arange(toxicity.GRADES)
    assert severe[truth].mean() > 1 and severe[~truth].mean() < 0.1


def ordinal_sample(n=40, n_features=6, n_grades=4, seed=3):
    draw = np.random.default_rng(seed)
    rows = [np.sort(draw.choice(n_features, draw.integers(0, n_features), replace=False)) for _ in range(n)]
    values = [draw.uniform(0.2, 2, len(r)) for r in rows]
    return rows, values, draw.integers(0, n_grades, n), n_features, n_grades


def test_gradient_is_the_slope_of_the_loss():
    sample = toxicity._Sample.of(*ordinal_sample())
    draw = np.random.default_rng(4)
    for _ in range(5):
        point = draw.normal(scale=0.5, size=6 + 3)
        _, gradient = sample.loss(point)
        for k in range(len(point)):
            step = np.zeros(len(point))
            step[k] = 1e-6
            slope = (sample.loss(point + step)[0] - sample.loss(point - step)[0]) / 2e-6
            assert abs(slope - gradient[k]) < 1e-6


def test_loss_is_the_likelihood_of_the_grades():
    """By the definition, document after document: P(grade <= k) = logistic(cut k - score)."""
    from math import exp, log

    rows, values, grades, n_features, n_grades = ordinal_sample()
    point = np.random.default_rng(5).normal(scale=0.5, size=n_features + n_grades - 1)
    weights, raw = point[:n_features], point[n_features:]
    cuts = [raw[0]]
    for x in raw[1:]:
        cuts.append(cuts[-1] + exp(x))
    total = toxicity.RIDGE / 2 * float(weights @ weights)
    for columns, own, grade in zip(rows, values, grades, strict=True):
        score = sum(weights[c] * v for c, v in zip(columns, own, strict=True))
        up_to = [1 / (1 + exp(score - cut)) for cut in cuts]
        same = sum((g > 0) == (grade > 0) for g in grades)
        p = (up_to[grade] if grade < n_grades - 1 else 1) - (up_to[grade - 1] if grade else 0)
        total -= len(grades) / 2 / same * log(p)
    loss, _ = toxicity._Sample.of(rows, values, grades, n_features, n_grades).loss(point)
    assert abs(loss - total / len(rows)) < 1e-9


def test_fit_ends_at_the_least_loss():
    sample = toxicity._Sample.of(*ordinal_sample())
    point = toxicity._fitted(sample, 1500)
    loss, gradient = sample.loss(point)
    assert np.abs(gradient).max() < 2e-3
    draw = np.random.default_rng(6)
    assert all(sample.loss(point + draw.normal(scale=0.3, size=len(point)))[0] > loss for _ in range(50))


def test_grades_come_from_models_that_did_not_see_the_document():
    """A document's own fold is left out, and grades follow the scores of the others' models."""
    rows, values = [], []
    draw = np.random.default_rng(8)
    toxic = np.arange(90) % 3 == 0
    for flag in toxic:
        rows.append(np.array([0, 1]) if flag else np.array([2]))
        values.append(np.array([draw.uniform(0.5, 3), 1.0]) if flag else np.array([1.0]))
    grades = toxicity.graded(rows, values, toxic, 3)
    assert (grades[~toxic] == 0).all() and grades[toxic].min() >= 1
    strength = np.array([v[0] for v in values])
    assert strength[grades == 3].mean() > strength[toxic & (grades < 3)].mean() + 0.5
    moved = [v * 5 if k == 0 else v for k, v in enumerate(values)]
    models = [toxicity.left_out_scores(rows, x, toxic, 3) for x in (values, moved)]
    mates = toxicity.folds(toxic) == toxicity.folds(toxic)[0]
    assert mates[toxic].sum() == 10 and mates[~toxic].sum() == 20
    mates[0] = False
    assert np.allclose(models[0][mates], models[1][mates])


def test_fits_agree():
    rows = labelled(200)
    assert toxicity.train(rows) == toxicity.train(rows)


def test_severity_edges(spark, documents, no_documents, corpus):
    model = toxicity.train(labelled(200))
    rows = toxicity.severity(documents, model).collect()
    assert len(rows) == len(corpus) and not any(r.toxic for r in rows if corpus[r.doc_id][1] in ("", None))
    assert toxicity.severity(no_documents, model).count() == 0
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    harmless = toxicity.fit(documents, labels)
    assert toxicity.without_toxic(documents, harmless).count() == len(corpus)
    frame = make(spark, [(1, "nastyfool vilescum you nastyfool"), (2, "abde"), (3, None)])
    assert sorted(r.doc_id for r in toxicity.without_toxic(frame, model).collect()) == [2, 3]


def reference_targets(sizes: list[int]) -> list[float]:
    weights = [1 + k % 3 for k in range(len(sizes))]
    got, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        total = sum(weights[k] for k in open_)
        share = {k: left * weights[k] / total for k in open_}
        over = [k for k in open_ if share[k] > 3 * sizes[k]]
        if not over:
            for k in open_:
                got[k] = share[k]
            break
        for k in over:
            got[k] = 3.0 * sizes[k]
            left -= got[k]
            open_.discard(k)
    return got


def sourced(spark, rows):
    return spark.createDataFrame(
        [(*r, 1, "k") for r in rows], "doc_id long, source string, text string, target long, key string"
    )


def test_mix_meets_targets(spark):
    draw = random.Random(6)
    rows = []
    for name, n, most in (("a", 80, 30), ("b", 3, 20), ("Z", 40, 9), (None, 20, 40), ("é", 1, 1), ("c", 200, 60)):
        rows += [(len(rows) + k, name, "w " * draw.randint(1, most)) for k in range(n)]
    rows += [(900, "a", None), (901, "a", ""), (902, "empty", None), (5, "a", "w w w"), (5, "a", "w w w")]
    found = mixing.mix(sourced(spark, rows)).collect()
    assert len(found) == len(rows)
    names = sorted({r[1] for r in rows if r[1] is not None}) + [None]
    sizes = [sum(r.size for r in found if r.source == n) for n in names]
    for name, size, target in zip(names, sizes, reference_targets(sizes), strict=True):
        own = [r for r in found if r.source == name]
        assert all(r.source_size == size for r in own)
        assert all(abs(r.target - target) < 1e-6 * max(1, target) for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 1.5
        assert all(0 <= r.taken <= 3 * r.size for r in own)
    again = mixing.mix(sourced(spark, rows)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_copies_repeat_rows(spark):
    rows = [(k, "ab"[k % 2], "w " * (k + 1)) for k in range(30)]
    frame = sourced(spark, rows)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(frame).collect()}
    found = mixing.copies(frame)
    assert found.columns == frame.columns
    counts = {r.doc_id: r["count"] for r in found.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in taken.items() if v}
    assert mixing.mix(frame.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(
    st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=8),
    st.integers(0, 300),
    st.integers(0, 50),
)
def test_fit_is_as_near_as_a_full_search(pairs, budget, exact):
    lengths, counts = np.array(list(pairs), dtype=np.int64), np.array(list(pairs.values()), dtype=np.int64)
    takes = mixing.fit_budget(lengths, counts, budget, exact=10_000)
    assert ((takes >= 0) & (takes <= counts)).all()
    total = int((takes * lengths).sum())
    assert total <= max(budget, 0)
    share = min(1.0, budget / max(1, (lengths * counts).sum()))
    base = np.floor(counts * share).astype(np.int64)
    sums = {int((base * lengths).sum())}
    for size, spare in zip(lengths.tolist(), (counts - base).tolist(), strict=True):
        sums = {s + k * size for s in sums for k in range(spare + 1)}
    assert total == max(s for s in sums if s <= budget)


def test_long_words_count_whole():
    decoder = crf.Decoder(pii.trained_field())
    own = lambda word: decoder._own[decoder._form(word)].tolist()
    assert own("a" * 65) == own("a" * 64) != own("a" * 64 + "12345")
    assert own("a" * 64 + "12345") == own("a12345")
    mixed = "aB" * 60
    assert own(mixed + "12345") != own(mixed)
    assert "b=" + crf.shape(mixed) in crf.features(crf.shape(mixed))
    before = len(decoder._own)
    for k in range(50):
        decoder._form("-".join(["Ab9"] * (40 + k)))
    assert len(decoder._own) <= before + 1 and all(len(f) <= 40 for f in decoder._forms)


def test_fit_reads_whole_labelled_texts(spark):
    """Rare words of a document with more than 4,000 others count, and so do all repeats."""
    filler = lambda k: " ".join(f"{w} {w}" for w in (f"w{'abcdefghij'[k]}" + "".join(
        "abcdefghij"[int(d)] for d in f"{n:04d}") for n in range(4_200)))
    rows = [(k, f"{filler(k)} " + ("zznastyfool " + "vilescum " * 30 if k % 2 else "zzplain")) for k in range(8)]
    docs = make(spark, rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert "=zznastyfool" in model.weights
    whole = toxicity.train(sorted((toxicity.chunk_words(t), k % 2) for k, t in rows))
    assert model.weights.keys() == whole.weights.keys()
    assert np.allclose([model.weights[f] for f in whole.weights], list(whole.weights.values()))
    assert np.allclose(model.cuts, whole.cuts)


def test_copies_are_taken_row_by_row(spark):
    """Shared and null ids, repeated rows, and columns named as those used inside."""
    from collections import Counter

    schema = "doc_id long, source string, text string, mixed_copy long, mixed_id long, size long, quota long, key string, times long"
    rows = [(k % 7 if k % 5 else None, "abc"[k % 3], "w " * (k % 4 + 1), 1, 2, 3, 4, "k", k // 20) for k in range(60)]
    rows += rows[:9] + [(3, "a", "", 1, 2, 3, 4, "k", 0), (3, None, None, 1, 2, 3, 4, "k", 0)]
    frame = spark.createDataFrame(rows, schema)
    found = mixing.copies(frame)
    assert found.columns == frame.columns
    taken = mixing.mix(frame).groupBy("source").sum("taken").collect()
    words = Counter()
    for r in found.collect():
        words[r.source] += len(r.text.split())
    assert {r.source: r["sum(taken)"] for r in taken if r["sum(taken)"]} == dict(words)
    counts, given = Counter(tuple(r) for r in found.collect()), Counter(rows)
    assert all(n <= 3 * given[r] for r, n in counts.items())
    assert mixing.copies(frame.limit(0)).count() == 0


def test_labelled_rows_are_bounded(spark, monkeypatch):
    """One id with thousands of rows teaches no more rows than the bound."""
    monkeypatch.setattr(toxicity, "MAX_OTHER", 50)
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 20)
    docs = spark.range(3_000).selectExpr("1L AS doc_id", "concat('word', id % 100) AS text").union(
        spark.range(200).selectExpr("id + 2 AS doc_id", "'bad one' AS text")
    )
    labels = spark.range(1, 202).selectExpr("id AS doc_id", "CASE WHEN id > 150 THEN 1 ELSE 0 END AS toxic")
    found = {r["toxic"]: r["count"] for r in toxicity.labelled_texts(docs, labels).groupBy("toxic").count().collect()}
    assert found == {0: 50, 1: 20}
    again = [sorted(map(tuple, toxicity.labelled_texts(d, labels).collect())) for d in (docs, docs.repartition(7))]
    assert again[0] == again[1]


def test_cards_have_a_check_digit(spark):
    texts = [(1, "card: 4111 1111 1111 1112 thanks"), (2, "card 4111.1111.1111.1111 thanks"), (3, "order 1234567890123456 sent")]
    found = {r.doc_id: [s.kind for s in r.field_spans] for r in pii.find_personal_data(make(spark, texts)).collect()}
    assert "field_card" not in found[1] + found[3] and "field_card" in found[2]
