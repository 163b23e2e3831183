"""Token ids, files, histograms and packing against the library and brute force."""

from __future__ import annotations

import io
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postpulse.llm import frames, lengths, packing, tokens
from tests.llm.conftest import make

LIBRARY = Tokenizer.from_file(tokens.default_tokenizer())


def whole(text: str | None) -> bytes:
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, dtype="<u4").tobytes()


def ended(text: str | None) -> bytes:
    return whole(text) + bytes(4)


@settings(max_examples=300, deadline=None)
@given(
    st.text(max_size=60)
    | st.text(alphabet="ab é'sl.1 \n\t 日д<|endoftext|>", max_size=60)
    | st.lists(st.sampled_from(["it's", " ", "  ", "word.", "<|endoftext|>", "\n", "we'll"])).map("".join)
)
def test_chunks_encode_as_the_whole_text(text):
    assert tokens.encoder(tokens.default_tokenizer()).encode(text) == whole(text)


def test_full_memo_changes_nothing(corpus):
    small = tokens.ChunkEncoder(tokens.default_tokenizer(), room=600)
    for _, text in corpus:
        assert small.encode(text or "") == whole(text)


def test_files_round_trip(spark, documents, corpus):
    found = frames.encode_and_report(documents).orderBy("doc_id").collect()
    start = 0
    for row, (doc, text) in zip(found, corpus, strict=True):
        ids = ended(text)
        assert tuple(row) == (doc, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def bytes_for(df, files: int) -> int:
    """``file_bytes`` that make an input ask for so many files."""
    whole = df.selectExpr("sum(coalesce(octet_length(text), 0) + 16)").first()[0]
    return -(-int(whole) // files)


def test_wanted_documents_only(spark, documents, corpus, tmp_path):
    path = str(tmp_path / "ids")
    frames.write_ids(documents, path, file_bytes=bytes_for(documents.select("doc_id", "text"), 9))
    assert len(list((tmp_path / "ids").glob("part-*"))) > 1
    rows = frames.read_ids(spark, path, wanted=[3, 5, 99_999]).collect()
    assert {r.doc_id: bytes(r.ids) for r in rows} == {k: ended(corpus[k][1]) for k in (3, 5)}


def test_files_are_plain_zstandard(spark, documents, corpus, tmp_path, monkeypatch):
    """Any decompressor reads them: data, then the index, in the order of ids over all files."""
    import zstandard

    size = bytes_for(documents.select("doc_id", "text"), 9)
    frames.write_ids(documents, str(tmp_path / "ids"), file_bytes=size)
    found = b""
    for path in sorted((tmp_path / "ids").glob("part-*")):
        content = path.read_bytes()
        reader = frames.FileReader(content)
        stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True)
        plain = stream.read()
        assert plain.endswith(reader.index.tobytes())
        found += plain[: len(plain) - reader.index.nbytes]
        assert sum(e[0] for e in reader._entries) < len(content)
    assert found == b"".join(ended(t) for _, t in corpus)


@pytest.mark.parametrize("frame_ids", [1, 4, 1000])
def test_file_layout(frame_ids):
    """Chunks with seams between them; a reader opens only the frames of what it wants."""
    builder = frames.FileBuilder(frame_ids=frame_ids)
    content = b""
    for doc in range(5):
        builder.add(doc, bytes(range(doc * 4, doc * 4 + 12)))
        if doc in (1, 3):
            content += builder.chunk()
            assert content[-1] == frames.LAST
    content += builder.finish()
    assert content[-4:] == frames.SEEKABLE_MAGIC.to_bytes(4, "little")
    reader = frames.FileReader(io.BytesIO(content))
    assert len(set(reader.index["frame"].tolist())) == {1: 5, 4: 3, 1000: 3}[frame_ids]
    assert list(reader.documents({1, 4})) == [(d, bytes(range(d * 4, d * 4 + 12))) for d in (1, 4)]
    assert [d for d, _ in reader.documents()] == list(range(5))
    if frame_ids == 1:
        opened = []
        reader.frame = lambda k, ahead=0: opened.append(k) or frames.FileReader.frame(reader, k, ahead)
        assert [d for d, _ in reader.documents({2})] == [2]
        assert opened == [int(reader.index["frame"][2])]
    broken = bytearray(content)
    broken[6] ^= 0xFF
    with pytest.raises(Exception, match="."):
        list(frames.FileReader(bytes(broken)).documents())


def test_larger_inputs_ask_for_more_files(documents, corpus):
    assert frames._file_count(documents, frames.FILE_BYTES) is None
    assert frames._file_count(documents, bytes_for(documents, 9)) == 9
    whole = sum(16 + len((t or "").encode()) for _, t in corpus)
    assert frames._file_count(documents, 100) == -(-whole // 100)


def test_one_id_may_fill_many_files(spark, tmp_path):
    """Equal rows of one id are dealt to several tasks and keep their order."""
    from pyspark.sql import functions as F

    rows = spark.range(0, 4000, 1, 4).select(F.lit(7).alias("doc_id"), F.lit("a b c").alias("text"))
    path = str(tmp_path / "ids")
    frames.write_ids(rows, path, file_bytes=bytes_for(rows, 9))
    assert len([p for p in (tmp_path / "ids").glob("part-*") if p.stat().st_size]) > 1
    found = frames.ids_report(spark, path).orderBy("start").collect()
    assert [r.start for r in found] == list(range(0, 16_000, 4)) and {r.n_tokens for r in found} == {4}


def test_other_tokenizers_are_refused(tmp_path):
    import json

    plain = json.loads(LIBRARY.to_str())
    assert tokens.cuttable(plain)
    for change in (
        {"pre_tokenizer": {"type": "Whitespace"}},
        {"pre_tokenizer": {**plain["pre_tokenizer"], "add_prefix_space": True}},
        {"normalizer": {"type": "NFC"}},
        {"pre_tokenizer": None},
        {"added_tokens": [{**plain["added_tokens"][0], "content": "a b"}]},
    ):
        assert not tokens.cuttable({**plain, **change})
    path = tmp_path / "other.json"
    path.write_text(json.dumps({**plain, "normalizer": {"type": "Lowercase"}}))
    with pytest.raises(ValueError, match="chunks"):
        tokens.ChunkEncoder(str(path))


def test_no_documents(no_documents):
    assert frames.encode_and_report(no_documents).count() == 0
    assert packing.pack_documents(no_documents).count() == 0
    assert lengths.cumulative(lengths.histogram(no_documents)).count() == 0


def test_null_and_repeated_ids(spark):
    frame = make(spark, [(2, "b"), (2, "a"), (None, "c"), (2, "a")])
    found = frames.encode_and_report(frame).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 2, 2, 2]
    assert found[1].ids_crc32 == found[2].ids_crc32


def test_histogram(spark, documents, corpus):
    sizes = sorted(len(whole(t)) // 4 for _, t in corpus)
    sums = lengths.cumulative(lengths.histogram(documents))
    rows = {r.length: r for r in sums.collect()}
    assert {k: r.n_docs for k, r in rows.items()} == Counter(sizes)
    for limit, row in rows.items():
        assert row.docs_over == sum(s > limit for s in sizes)
        assert row.tokens_over == sum(s for s in sizes if s > limit)
        assert row.truncated_tokens == sum(min(s, limit) for s in sizes)
    limits = [0, 1, 7, 100, 10**6]
    for row in lengths.at_limits(sums, limits).collect():
        assert row.truncated_tokens == sum(min(s, row.limit) for s in sizes)
        assert row.docs_over == sum(s > row.limit for s in sizes)
    for row in lengths.quantile_length(sums, [0.25, 0.5, 1.0]).collect():
        assert row.length == sizes[int(np.ceil(row.share * len(sizes))) - 1]


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(1, 4) == [(0, 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=80))
def test_bins_hold_their_items(sizes):
    bins, offsets = packing.sum_of_squares(np.array(sizes, dtype=np.int64), 16)
    filled = Counter()
    for k, size in enumerate(sizes):
        assert offsets[k] == filled[bins[k]]
        filled[bins[k]] += size
    assert all(v <= 16 for v in filled.values())
    assert len(filled) <= max(1, -(-2 * sum(sizes) // 16))


def test_sum_of_squares_rule():
    """Each item goes where the sum of squares is smallest, by trying all places."""
    draw = np.random.default_rng(1)
    sizes = draw.integers(1, 11, 300)
    bins, _ = packing.sum_of_squares(sizes, 12)
    gaps: list[int] = []
    for size, chosen in zip(sizes.tolist(), bins.tolist(), strict=True):

        def score(place, size=size):
            after = [*gaps, 12] if place == len(gaps) else list(gaps)
            after[place] -= size
            return sum(n * n for g, n in Counter(after).items() if 0 < g < 12)

        places = [k for k, g in enumerate(gaps) if g >= size] + [len(gaps)]
        assert score(chosen) == min(map(score, places))
        if chosen == len(gaps):
            gaps.append(12)
        gaps[chosen] -= size


def test_packed_documents(spark, documents, corpus):
    rows = packing.pack_documents(documents, capacity=64).collect()
    by_doc: dict = {}
    by_sequence: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in corpus:
        ids, at = ended(text), 0
        for number, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            part = ids[at * 4 : (at + r.length) * 4]
            assert (r.piece, r.start, r.ids_crc32) == (number, at, zlib.crc32(part))
            assert number == 0 or r.length == 64
            at += r.length
        assert at * 4 == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.1 * -(-total // 64) + 2


def test_sequences_hold_the_ids(spark, corpus):
    frame = make(spark, corpus[:20])
    packed = packing.pack_documents(frame, capacity=64, with_ids=True)
    rows = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        own = rows[r.sequence_id][r.offset * 4 : (r.offset + r.length) * 4]
        assert own == bytes(r.ids)
