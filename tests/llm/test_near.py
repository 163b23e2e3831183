"""SimHash groups, embedding links, neighbours and components against brute force."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from postpulse.llm import forest, graph, itq, simhash
from tests.llm.conftest import make


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        a, b = sorted((self.find(x), self.find(y)))
        self.up[b] = a


def slow_fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(documents, corpus):
    found = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(documents).collect()}
    assert found == {doc: slow_fingerprint(text) for doc, text in corpus}


def test_groups(spark, documents, corpus):
    prints = [slow_fingerprint(t) for _, t in corpus]
    union = Union(len(prints))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                union.join(a, b)
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents).collect()}
    assert found == {k: union.find(k) for k in range(len(prints))}
    kept = simhash.first_of_each(documents).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(found.values()))


def near_prints():
    """Chains, shared bytes and random values."""
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, k, dtype=np.uint64))
            for b in base for k in (1, 2, 3, 4, 5)]
    dense = (np.uint64(0xABCDEF0123) << np.uint64(24)) | draw.integers(0, 64, 60, dtype=np.uint64)
    ends = np.array([0, 1, (1 << 64) - 1], dtype=np.uint64)
    return np.unique(np.concatenate([base, np.array(near), dense, ends]))


def joined(nodes, pairs) -> dict:
    place = {x: k for k, x in enumerate(nodes)}
    union = Union(len(nodes))
    for a, b in pairs:
        union.join(place[a], place[b])
    return {x: union.find(k) for x, k in place.items()}


@pytest.mark.parametrize("block_rows", [simhash.BLOCK_ROWS, 7, 1])
def test_edges_connect_what_links_connect(spark, block_rows):
    """Whole keys, and keys split into blocks."""
    prints = near_prints().tolist()
    pairs = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3]
    frame = spark.createDataFrame([(int(x),) for x in near_prints().view(np.int64)], "fp long")
    rows = simhash.edges(frame, block_rows=block_rows).collect()
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in rows]
    assert joined(prints, found) == joined(prints, pairs)


def test_each_pair_is_found_under_one_choice():
    """A tile of two fingerprints reports them under the first choice they share, and there only."""
    prints = near_prints()
    for a in prints[::3].tolist():
        for b in prints.tolist():
            pair = [np.array([x], dtype=np.uint64) for x in (a, b)]
            shared = [p for p in range(8) if (a ^ b) >> 8 * p & 255 == 0]
            choices = [c for c in simhash.combinations(range(7), 4) if set(c) <= set(shared)]
            found = [c for c in choices if any(len(e) for e in simhash._tile(*pair, c, 3))]
            assert found == (choices[:1] if 0 < (a ^ b).bit_count() <= 3 else [])


def test_a_dense_group_reports_a_forest(spark):
    """Fingerprints within three bits of each other: far fewer edges than pairs."""
    rows = [(0xAB << 40 | 1 << a | 1 << b,) for a in range(24) for b in range(a)]
    frame = spark.createDataFrame(rows, "fp long")
    found = simhash.edges(frame, block_rows=50).collect()
    assert len(set(joined([r[0] for r in rows], [(r.a, r.b) for r in found]).values())) == 1
    assert len(found) < 4_000 < len(rows) * (len(rows) - 1) // 4


def test_null_ids_and_no_documents(spark, no_documents):
    assert simhash.near_duplicates(no_documents).count() == 0
    frame = make(spark, [(None, "a b c d"), (7, "a b c d"), (3, "a b c d"), (7, "a b c d"), (None, None)])
    found = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(frame).collect())
    assert found == [("3", "3"), ("7", "3"), ("7", "3"), ("None", "3"), ("None", "None")]
    kept = [r.doc_id for r in simhash.first_of_each(frame).collect()]
    assert sorted(kept, key=str) == [3, None, None]


def test_components(spark):
    draw = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 300, (220, 2))]
    edges += [(k, k + 1) for k in range(400, 460)] + [(5, 5)]
    union = Union(500)
    for a, b in edges:
        union.join(a, b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    frame = spark.createDataFrame(edges, "x long, y long")
    found = {r.node: r.component for r in graph.components(frame).collect()}
    assert found == {n: union.find(n) for n in nodes}
    assert graph.components(frame.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, n long, id string, vector string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "i", "v") for i, v in rows], VECTORS)


def near_set(n_groups=25, copies=6, width=24, seed=5):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(n_groups, width))
    found = [c + draw.normal(scale=0.12 * (k % 4 + 0.2), size=width) for c in centres for k in range(copies)]
    return [np.float32(v).tolist() for v in found]


def odd_vectors(width=24):
    plain = [1.0] * width
    return [None, [0.0] * width, [None, *plain[1:]], [float("nan"), *plain[1:]],
            [float("inf"), *plain[1:]], [1.0, 2.0], []]


def test_embedding_links(spark):
    plain = near_set()
    rows = [*plain, plain[0], plain[0], plain[3], *odd_vectors()]
    found = {r.id: r for r in itq.near_duplicates(vectors(spark, enumerate(rows))).collect()}
    n = len(plain) + 3
    x = np.array(rows[:n], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    union = Union(len(rows))
    for a, b in zip(*np.nonzero(close), strict=True):
        union.join(int(a), int(b))
    assert len(found) == len(rows)
    total = sum(found[k].n_links for k in range(n))
    expected = int(close.sum()) - n
    assert 0.98 * expected <= total <= expected
    same = sum(found[k].component_id == union.find(k) for k in range(n))
    assert same >= 0.98 * n
    assert found[n - 3].n_links >= 2
    for k in range(n, len(rows)):
        assert (found[k].n_links, found[k].component_id) == (0, k)


def test_no_vectors(spark):
    empty = vectors(spark, [])
    assert itq.near_duplicates(empty).count() == 0
    assert forest.neighbours(empty, empty["vec_id"] >= 0).count() == 0
    odd = vectors(spark, enumerate(odd_vectors()[:5]))
    assert itq.near_duplicates(odd).count() == 5


def test_codes_are_balanced_and_keep_near_vectors_near():
    x = np.random.default_rng(1).normal(size=(4000, 32)) + 0.3
    codes = itq.learn(x)
    bits = np.unpackbits(codes.encode(x)[:, :1].view(np.uint8), axis=1, bitorder="little")[:, :32]
    assert np.all(np.abs(bits.mean(axis=0) - 0.5) < 0.1)
    moved = codes.encode(x + np.random.default_rng(2).normal(scale=0.1, size=x.shape))
    assert np.bitwise_count(moved ^ codes.encode(x)).mean() < 4


def test_neighbours(spark):
    draw = np.random.default_rng(8)
    plain = [np.float32(v).tolist() for v in draw.normal(size=(1500, 12)) * draw.uniform(0.5, 2, (1500, 1))]
    plain[7] = plain[6]
    rows = [*plain, *odd_vectors(12)]
    found = forest.neighbours(vectors(spark, enumerate(rows)), F.col("id") % 50 == 0, k=20).collect()
    x = np.array(plain, dtype=np.float64)
    hits = 0
    for query in range(0, 1500, 50):
        own = sorted((r for r in found if r.query_id == query), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        scores = x @ x[query]
        order = [k for k in np.lexsort((np.arange(1500), -scores)) if k != query][:20]
        assert all(abs(r.score - scores[r.id]) < 1e-12 for r in own)
        pairs = [(-r.score, r.id) for r in own]
        assert pairs == sorted(pairs)
        hits += len({r.id for r in own} & set(order))
    assert hits / (30 * 20) >= 0.9


def test_fewer_candidates_than_wanted(spark):
    rows = [(k, [float(k), 1.0]) for k in range(4)]
    found = forest.neighbours(vectors(spark, rows), F.col("id") == 0, k=20).collect()
    assert sorted(r.id for r in found) == [1, 2, 3]


def mixed_lengths():
    """More vectors of length 12 than of 8, 3 and 2, and one of length 5."""
    draw = np.random.default_rng(4)
    near = lambda n, width: (draw.normal(size=width) + draw.normal(scale=0.05, size=(n, width))).tolist()
    return [*near_set(10, 6, 12), *near(9, 8), *near_set(4, 3, 8), *near(2, 3), [1.0, 2.0], [1.0, 2.1], [1.0] * 5]


def test_embedding_links_of_every_length(spark):
    rows = mixed_lengths()
    found = {r.id: r for r in itq.near_duplicates(vectors(spark, enumerate(rows))).collect()}
    unit = [np.float32(v).astype(np.float64) for v in rows]
    unit = [v / np.linalg.norm(v) for v in unit]
    union, links = Union(len(rows)), np.zeros(len(rows), dtype=int)
    for a, x in enumerate(unit):
        for b, y in enumerate(unit):
            if a != b and len(x) == len(y) and x @ y >= 0.95:
                links[a] += 1
                union.join(a, b)
    others = [k for k, v in enumerate(rows) if len(v) != 12]
    assert links[others].sum() >= 9 * 8 + 4
    assert len(found) == len(rows)
    for k in others:
        assert (found[k].n_links, found[k].component_id) == (links[k], union.find(k))


def test_links_of_two_vectors(spark):
    one = np.random.default_rng(6).normal(size=64).tolist()
    rows = [(0, one), (1, [one[0] + 0.2, *one[1:]])]
    found = itq.near_duplicates(vectors(spark, rows)).collect()
    assert sorted((r.id, r.n_links, r.component_id) for r in found) == [(0, 1, 0), (1, 1, 0)]


def test_neighbours_of_every_length(spark):
    """Every query has its full number of rows of its own length, with exact scores; nine tenths are the nearest."""
    rows = mixed_lengths()
    found = forest.neighbours(vectors(spark, enumerate(rows)), F.col("id") >= 0, k=5).collect()
    exact = [np.float32(v).astype(np.float64) for v in rows]
    hits = wanted = 0
    for query, x in enumerate(exact):
        scores = {k: y @ x for k, y in enumerate(exact) if k != query and len(y) == len(x)}
        best = sorted(scores, key=lambda k: (-scores[k], k))[:5]
        own = sorted((r for r in found if r.query_id == query), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(best) + 1))
        assert np.allclose([r.score for r in own], [scores[r.id] for r in own])
        hits, wanted = hits + len({r.id for r in own} & set(best)), wanted + len(best)
    assert hits / wanted >= 0.9


def test_reused_ids_lose_no_text(spark):
    a, b, c = ("one two three four five", "quite another text than that", "and a third one again")
    rows = [(3, a), (5, a), (5, b), (5, b), (7, c), (7, c), (8, c), (9, a), (9, b), (None, a)]
    kept = simhash.first_of_each(make(spark, rows)).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == [(0, a), (3, a), (5, b), (7, c)]
    frame = make(spark, [(1, a), (1, b), (1, b), (2, b)])
    kept = simhash.first_of_each(frame).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (1, b)]


def test_clashing_names(spark):
    """Columns named as those the choice works with."""
    schema = "doc_id long, text string, print long, rank int, chosen_id long, chosen_fp long, later_id long, m map<string,int>"
    rows = [(1, "a b c d", 5, 6, 7, 8, 9, {"a": 1}), (2, "a b c d", 5, 6, 7, 8, 9, None), (1, "a b c d", 4, 6, 7, 8, 9, None)]
    frame = spark.createDataFrame(rows, schema)
    kept = simhash.first_of_each(frame)
    assert kept.columns == frame.columns
    assert [tuple(r) for r in kept.collect()] == [rows[2]]


def measured(x: np.ndarray, k: int = 20, n_queries: int = 60) -> tuple[float, float]:
    """Recall and the share of rows scored, by the forest's own functions without Spark."""
    draw = np.random.default_rng(1).permutation(len(x))
    sample = x[draw[: forest.FIT_ROWS]]
    grown = forest.grow(sample, np.linalg.norm(x, axis=1).max(), forest.TREES, forest.DEPTH)
    coverage = forest.learned_coverage(grown, sample, k)
    leaves = grown.leaves(x)
    sizes = forest.leaf_sizes(grown, leaves)
    hits = scored = 0.0
    for query, offsets in zip(draw[:n_queries], grown.offsets(x[draw[:n_queries]]), strict=True):
        seen = np.zeros(sizes.size, dtype=bool)
        seen[grown.visits(offsets, sizes, coverage, k + 1)] = True
        found = forest.candidates(seen.reshape(1, *sizes.shape), leaves)[0]
        scores = x @ x[query]
        scores[query] = -np.inf
        hits += found[np.argsort(-scores, kind="stable")[:k]].mean()
        scored += found.mean()
    return hits / n_queries, scored / n_queries


@pytest.mark.parametrize(("n", "most"), [(1_500, 0.75), (10_000, 0.7), (40_000, 0.75)])
def test_recall_without_structure(n, most):
    recall, share = measured(np.random.default_rng(9).normal(size=(n, 64)))
    assert recall >= 0.9 and share <= most


@pytest.mark.parametrize("n", [10_000, 40_000])
def test_clustered_vectors_need_a_small_share(n):
    draw = np.random.default_rng(10)
    centres = draw.normal(size=(n // 100, 64))
    x = centres[draw.integers(0, len(centres), n)] + draw.normal(scale=0.15, size=(n, 64))
    recall, share = measured(x)
    assert recall >= 0.9 and share <= 0.15


def test_blocks_hold_whole_leaves_or_parts_of_one(monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_ROWS", 10)
    first, count = forest.blocks_of(np.array([4, 5, 3, 25, 0, 9, 2]))
    assert first.tolist() == [0, 0, 1, 2, 5, 5, 6] and count.tolist() == [1, 1, 1, 3, 1, 1, 1]


def test_recall_through_spark(spark, monkeypatch):
    """Several blocks, vectors without structure."""
    n = 9000
    plain = [np.float32(v).tolist() for v in np.random.default_rng(9).normal(size=(n, 32))]
    rows = list(enumerate(plain))
    found = forest.neighbours(vectors(spark, rows), F.col("id") % 300 == 0).collect()
    x = np.array(plain, dtype=np.float64)
    hits = 0
    for query in range(0, n, 300):
        scores = x @ x[query]
        scores[query] = -np.inf
        best = set(np.argsort(-scores, kind="stable")[:20].tolist())
        own = [r for r in found if r.query_id == query]
        assert len(own) == len({r.id for r in own}) == 20
        hits += len(best & {r.id for r in own})
    assert hits / (n // 300 * 20) >= 0.9


def pairs_near(width: int, n: int, low: float, high: float, seed: int = 3):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = draw.normal(size=(n, width))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cosine = draw.uniform(low, high, (n, 1))
    return x, cosine * x + np.sqrt(1 - cosine**2) * y


@pytest.mark.parametrize("width", [24, 64])
def test_recall_of_links_at_the_limit(spark, width):
    """5,000 vectors and more; pairs just above the limit, narrow vectors included."""
    x, y = pairs_near(width, 2600, 0.951, 0.96)
    rows = np.concatenate([x, y])
    frame = vectors(spark, [(k, v.tolist()) for k, v in enumerate(rows)])
    found = {r.id: r.component_id for r in itq.near_duplicates(frame).collect()}
    together = np.mean([found[k] == found[k + 2600] for k in range(2600)])
    assert together >= 0.97


@pytest.mark.parametrize("width", [8, 24, 48, 64, 100])
def test_substrings_hold_bits_at_every_width(width):
    """No substring is constant: the fullest bucket holds a small part of the rows."""
    x, _ = pairs_near(width, 5000, 0.95, 0.96)
    found = itq.learn(x).encode(x)
    for code in found.T:
        for table in range(4):
            part = (code >> np.uint64(16 * table)) & np.uint64(0xFFFF)
            assert np.bincount(part.astype(int)).max() < 100


def test_every_row_of_a_repeated_id_links(spark):
    draw = np.random.default_rng(6)
    u, v = (draw.normal(size=16).tolist() for _ in range(2))
    more = [1.0001 * x for x in u], [1.0001 * x for x in v]
    rows = [(0, u), (0, v), (7, more[1]), (8, more[0])]
    found = itq.near_duplicates(vectors(spark, rows)).collect()
    assert sorted(map(tuple, found)) == [(0, 1, 0), (0, 1, 0), (7, 1, 0), (8, 1, 0)]
    rows = [(5, u), (5, u), (3, v), (5, more[1]), (None, more[0]), (None, [0.0] * 16), (9, [1.0] * 16), (None, [-1.0] * 16)]
    found = itq.near_duplicates(vectors(spark, rows)).collect()
    wanted = [(5, 2, 5), (5, 2, 5), (3, 1, 3), (5, 1, 3), (None, 2, 5), (None, 0, None), (9, 0, 9), (None, 0, None)]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))


def test_repeated_ids_agree_with_sql(spark, tmp_path):
    import duckdb

    from postpulse.llm import catalogue
    from tests.compare import canonical

    draw = np.random.default_rng(12)
    centres = draw.normal(size=(12, 24))
    points = centres[draw.integers(0, 12, 300)] + 0.06 * draw.normal(size=(300, 24))
    rows = [(int(k) if k else None, p.tolist()) for k, p in zip(draw.integers(0, 90, 300), points, strict=True)]
    rows += rows[:9] + [(4, None), (4, [0.0] * 24)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = catalogue.op10_embedding_links(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    answer = con.execute(catalogue.OP10_SQL)
    columns = [c[0] for c in answer.description]
    assert canonical(found.columns, [tuple(r) for r in found.collect()]) == canonical(columns, answer.fetchall())


def test_every_row_of_a_repeated_id_is_a_candidate(spark):
    draw = np.random.default_rng(3)
    points = draw.normal(size=(60, 8))
    ids = [k % 20 for k in range(60)]
    rows = [(i, p.tolist()) for i, p in zip(ids, points, strict=True)]
    frame = vectors(spark, rows)
    found = forest.neighbours(frame, F.col("id") % 10 == 0, k=59).collect()
    exact = np.asarray(frame.select("embedding").toPandas()["embedding"].tolist(), dtype=np.float64)
    wanted = []
    for q in range(60):
        if ids[q] % 10 == 0:
            order = sorted((-float(exact[q] @ exact[j]), ids[j]) for j in range(60) if j != q)
            wanted += [(ids[q], n + 1, i) for n, (_, i) in enumerate(order)]
    assert sorted((r.query_id, r["rank"], r.id) for r in found) == sorted(wanted)
