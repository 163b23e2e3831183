"""Operator 8: toxicity severity by cumulative-link ordinal regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postpulse.llm.common import map_batches, materialized, picked

#: Labelled documents that a fit may see at most, toxic and other.
MAX_TOXIC, MAX_OTHER = 2_000, 4_000
#: Grade 0 is for documents that are not toxic.  Labels say no more than that,
#: so toxic ones are graded 1 to 3 by the scores of models that did not see
#: them.  Bounds lie between what other documents reach (0) and the median of
#: the toxic ones (1).
GRADE_BOUNDS = (0.4, 0.8)
GRADES = len(GRADE_BOUNDS) + 2
#: Share of the other documents whose left-out scores stay below the level 0.
USUAL = 0.999
#: Parts of the labelled documents; each is scored by a model of the others.
FOLDS = 3
#: Documents whose features a task counts at a time.
COUNTED = 200
#: Weight of the squared feature weights in the loss.
RIDGE = 0.05

_WORDS = re.compile(r"[^\W\d_]+")
_STEMS = (4, 5, 6)


def word_features(word: str) -> tuple[str, ...]:
    """A lower-case word itself and its beginnings, so inflected forms share weights."""
    return (f"={word}", *(f"^{word[:n]}" for n in _STEMS if len(word) > n))


def chunk_words(chunk: str) -> list[str]:
    return _WORDS.findall(chunk.lower())


@dataclass(frozen=True)
class Model:
    """P(grade <= k) is the logistic function of ``cuts[k]`` minus the score.

    One weight vector serves all thresholds.  ``weights`` maps a feature to
    its weight; a document's score adds weight x log(1 + occurrences).
    """

    weights: dict[str, float]
    cuts: tuple[float, ...]

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each grade, by row."""
        below = 1 / (1 + np.exp(-np.clip(np.subtract.outer(self.cuts, scores), -40, 40)))
        edges = np.vstack([np.zeros_like(scores), below, np.ones_like(scores)])
        return np.diff(edges, axis=0).T


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class _Sample:
    """Graded documents as (document, feature, value) triples.

    Toxic and other documents weigh the same in all, however many they are.
    A model's parameters are one vector: feature weights, the first cut and
    the logarithms of the steps to the others, which keeps cuts in order.
    """

    owner: np.ndarray
    column: np.ndarray
    value: np.ndarray
    grades: np.ndarray
    weight: np.ndarray
    n_features: int
    n_grades: int

    @classmethod
    def of(cls, rows, values, grades, n_features: int, n_grades: int) -> _Sample:
        grades = np.asarray(grades)
        toxic = grades > 0
        sizes = np.maximum(np.bincount(toxic, minlength=2), 1)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        column = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        value = np.concatenate([np.zeros(0), *values])
        weight = len(grades) / 2 / sizes[toxic.astype(np.int64)]
        return cls(owner, column, value, grades, weight, n_features, n_grades)

    def cuts(self, parameters: np.ndarray) -> np.ndarray:
        raw = parameters[self.n_features :]
        return np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])

    def start(self) -> np.ndarray:
        """No weights, and the cuts that give the grades' shares."""
        weight = np.bincount(self.grades, self.weight, minlength=self.n_grades)
        share = np.cumsum(weight)[:-1] / weight.sum()
        share = np.clip(share, 1e-4, 1 - 1e-4)
        cuts = np.log(share / (1 - share))
        cuts = np.maximum.accumulate(cuts + 1e-3 * np.arange(len(cuts)))
        steps = np.log(np.maximum(np.diff(cuts), 1e-3))
        return np.concatenate([np.zeros(self.n_features), cuts[:1], steps])

    def loss(self, parameters: np.ndarray) -> tuple[float, np.ndarray]:
        """Penalised negative log-likelihood per document, and its gradient."""
        n, at = len(self.grades), np.arange(len(self.grades))
        weights, raw = parameters[: self.n_features], parameters[self.n_features :]
        scores = np.bincount(self.owner, self.value * weights[self.column], minlength=n)
        below = _logistic(self.cuts(parameters)[None, :] - scores[:, None])
        edges = np.column_stack([np.zeros(n), below, np.ones(n)])
        slope = edges * (1 - edges)
        p = np.maximum(edges[at, self.grades + 1] - edges[at, self.grades], 1e-9)
        over = self.weight / p
        high, low = slope[at, self.grades + 1] * over, slope[at, self.grades] * over
        by_score = (high - low)[self.owner] * self.value
        g_weights = np.bincount(self.column, by_score, minlength=self.n_features)
        g_cuts = np.zeros(self.n_grades + 1)
        np.add.at(g_cuts, self.grades + 1, -high)
        np.add.at(g_cuts, self.grades, low)
        tail = np.cumsum(g_cuts[1:-1][::-1])[::-1]
        g_raw = np.concatenate([tail[:1], tail[1:] * np.exp(raw[1:])])
        total = RIDGE / 2 * float(weights @ weights) - float(self.weight @ np.log(p))
        return total / n, np.concatenate([g_weights + RIDGE * weights, g_raw]) / n


def _fitted(sample: _Sample, steps: int = 400) -> np.ndarray:
    """Parameters by Adam, the last quarter of the steps smaller; deterministic."""
    parameters = sample.start()
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, steps + 1):
        _, gradient = sample.loss(parameters)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = 0.1 if 4 * step <= 3 * steps else 0.02
        parameters -= (
            rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        )
    return parameters


def folds(toxic: np.ndarray) -> np.ndarray:
    """The fold of each document: toxic ones and others are dealt out in turn."""
    place = np.where(toxic, np.cumsum(toxic), np.cumsum(~toxic))
    return place % FOLDS


def left_out_scores(
    rows: list[np.ndarray], values: list[np.ndarray], toxic: np.ndarray, n_features: int
) -> np.ndarray:
    """Each document's score by a two-grade model of the other folds."""
    scores, own_fold = np.zeros(len(rows)), folds(toxic)
    for fold in range(FOLDS):
        seen = np.flatnonzero(own_fold != fold).tolist()
        own, flags = [rows[k] for k in seen], toxic[seen].astype(np.int64)
        sample = _Sample.of(own, [values[k] for k in seen], flags, n_features, 2)
        weights = _fitted(sample, 150)[:n_features]
        for k in np.flatnonzero(own_fold == fold).tolist():
            scores[k] = weights[rows[k]] @ values[k]
    return scores


def graded(
    rows: list[np.ndarray], values: list[np.ndarray], toxic: np.ndarray, n_features: int
) -> np.ndarray:
    """0 for documents that are not toxic, else 1 to 3 by left-out score and ``GRADE_BOUNDS``."""
    scores = left_out_scores(rows, values, toxic, n_features)
    low, high = np.quantile(scores[~toxic], USUAL), np.median(scores[toxic])
    bounds = low + max(high - low, 0.0) * np.array(GRADE_BOUNDS)
    return np.where(toxic, 1 + np.searchsorted(bounds, scores), 0)


def _features_of(words: Iterable[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def _encoded(words: Counter, column: dict[str, int]) -> Counter:
    """Occurrences by column."""
    tally: Counter = Counter()
    for word, n in words.items():
        for f in word_features(word):
            if f in column:
                tally[column[f]] += n
    return tally


def _model(names: list[str], rows: list[tuple[list[int], list[int], int]]) -> Model:
    """A model from (columns in order, occurrences, toxic 0 or 1) of each document."""
    columns = [np.array(c, dtype=np.int64) for c, _, _ in rows]
    values = [np.log1p(n) for _, n, _ in rows]
    toxic = np.array([flag for _, _, flag in rows], dtype=bool)
    grades = graded(columns, values, toxic, len(names))
    sample = _Sample.of(columns, values, grades, len(names), GRADES)
    parameters = _fitted(sample)
    kept = {f: float(w) for f, w in zip(names, parameters, strict=False) if abs(w) > 1e-6}
    return Model(kept, tuple(float(c) for c in sample.cuts(parameters)))


def _harmless() -> Model:
    return Model({}, tuple(20.0 + k for k in range(GRADES - 1)))


def train(examples: list[tuple[list[str], int]]) -> Model:
    """A model from (words of a document, toxic 0 or 1) pairs.

    Features are those seen in two toxic documents at least and at least four
    times as often there, by share of documents, as elsewhere.  Without both
    kinds of document the model calls nothing toxic.
    """
    counts = [Counter(words) for words, _ in examples]
    toxic = np.array([t for _, t in examples], dtype=bool)
    if not toxic.any() or toxic.all():
        return _harmless()
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for words, flag in zip(counts, toxic, strict=True):
        seen[int(flag)].update(_features_of(words))
    n_toxic, n_other = int(toxic.sum()), int((~toxic).sum())
    lift = {
        f: np.log((n + 0.1) / (n_toxic + 0.2)) - np.log((seen[0][f] + 0.1) / (n_other + 0.2))
        for f, n in seen[1].items()
        if n >= 2
    }
    names = sorted(f for f, x in lift.items() if x > np.log(4))
    column = {f: k for k, f in enumerate(names)}
    rows = []
    for words, flag in zip(counts, toxic, strict=True):
        tally = _encoded(words, column)
        rows.append((sorted(tally), [tally[k] for k in sorted(tally)], int(flag)))
    return _model(names, rows)


def labelled_texts(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """text and toxic of a bounded sample of labelled documents, the same in every run.

    Per class the rows of the ids with the smallest hashes are taken, their
    texts whole, ``MAX_TOXIC`` and ``MAX_OTHER`` rows at most, however many
    share an id.
    """
    marks = labels.select(F.col("doc_id").alias("of"), "toxic").where("toxic in (0, 1)")
    marks = marks.groupBy("of").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.withColumn("h", F.xxhash64("of"))
    chosen = (
        marks.where("toxic = 1").orderBy("h", "of").limit(MAX_TOXIC)
    ).union(marks.where("toxic = 0").orderBy("h", "of").limit(MAX_OTHER))
    rows = picked(docs, doc_id=id_col, text=text_col)
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
    order = Window.partitionBy("toxic").orderBy("h", "of", F.xxhash64("text"), "text")
    ranked = rows.withColumn("n", F.row_number().over(order))
    # The first bound is one number, so Spark cuts every task's rows before they are shuffled.
    ranked = ranked.where(F.col("n") <= max(MAX_TOXIC, MAX_OTHER))
    most = F.when(F.col("toxic") == 1, MAX_TOXIC).otherwise(MAX_OTHER)
    return ranked.where(F.col("n") <= most).select("text", "toxic")


def _peculiar(texts: DataFrame, n_toxic: int, n_other: int) -> list[str]:
    """``train``'s features, counted on the executors.

    What the bounded number of toxic documents have in common bounds them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(low, COUNTED) for b in batches for low in range(0, b.num_rows, COUNTED))
        for part in parts:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, flag in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                seen[flag].update(_features_of(set(chunk_words(text or ""))))
            names = list(seen[1].keys() | seen[0].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, type=pa.string())]
                + [pa.array([seen[k][f] for f in names], type=pa.int64()) for k in (1, 0)],
                names=["f", "toxic", "other"],
            )

    counts = texts.mapInArrow(count, "f string, toxic long, other long")
    counts = counts.groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    lift = F.log((F.col("toxic") + 0.1) / (n_toxic + 0.2)) - F.log(
        (F.col("other") + 0.1) / (n_other + 0.2)
    )
    kept = counts.where("toxic >= 2").where(lift > np.log(4)).select("f")
    return sorted(r["f"] for r in kept.collect())


def fit(docs: DataFrame, labels: DataFrame, **columns: str) -> Model:
    """``train`` on labelled documents; only kept features leave the executors.

    Labels other than 0 and 1 and null ids teach nothing, a repeated label
    counts once (1 wins), and of rows that share an id each teaches; null texts
    are empty.  Texts are read whole, whatever their length.
    """
    texts = materialized(labelled_texts(docs, labels, **columns), "labelled")
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return _harmless()
    names = _peculiar(texts, sizes[1], sizes[0])
    column = {f: k for k, f in enumerate(names)}

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [_encoded(Counter(chunk_words(t or "")), column) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([sorted(t) for t in out], type=pa.list_(pa.int64())),
                pa.array([[t[k] for k in sorted(t)] for t in out], type=pa.list_(pa.int64())),
                batch.column(1),
            ],
            names=["columns", "n", "toxic"],
        )

    fields = "columns array<long>, n array<long>, toxic int"
    return _model(names, sorted(tuple(r) for r in map_batches(texts, encode, fields).collect()))


class _Scorer:
    """Scores texts; remembers what a bounded number of chunks contribute."""

    def __init__(self, model: Model, memo: int = 150_000):
        self._names = list(model.weights)
        self._column = {f: k for k, f in enumerate(self._names)}
        self._weights = np.array([model.weights[f] for f in self._names])
        self._memo: dict[str, tuple[int, ...]] = {}
        self._most = memo

    def _columns(self, chunk: str) -> tuple[int, ...]:
        column = self._column
        found = tuple(
            column[f] for w in chunk_words(chunk) for f in word_features(w) if f in column
        )
        if len(self._memo) < self._most and len(chunk) <= 40:
            self._memo[chunk] = found
        return found

    def score(self, text: str) -> float:
        chunks = text.split()
        known = list(map(self._memo.get, chunks))
        hits: list[int] = []
        for k, found in enumerate(known):
            if found is None:
                found = self._columns(chunks[k])
            if found:
                hits += found
        if not hits:
            return 0.0
        which, n = np.unique(hits, return_counts=True)
        return float(self._weights[which] @ np.log1p(n))


def severity(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, severity (expected grade), grade (likeliest), p_toxic and toxic.

    ``toxic`` holds where grades above 0 are likelier than not.  Null and
    empty texts score 0; repeated rows and ids are scored each for itself, an
    empty table gives an empty one, other columns are ignored.  One narrow
    pass over whole texts; the model travels with the tasks.
    """
    rows = picked(df, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    held: list[_Scorer] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(_Scorer(model))
        scores = np.array([held[0].score(t) if t else 0.0 for t in batch.column(1).to_pylist()])
        grades = model.grades(scores)
        above = 1 - grades[:, 0]
        columns = [
            batch.column(0),
            pa.array(grades @ np.arange(GRADES)),
            pa.array(grades.argmax(axis=1).astype(np.int32)),
            pa.array(above),
            pa.array(above >= 0.5),
        ]
        names = ["doc_id", "severity", "grade", "p_toxic", "toxic"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(
        rows, work, f"doc_id {kind}, severity double, grade int, p_toxic double, toxic boolean"
    )


def without_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are not toxic, with all their columns, in one narrow pass.

    Null and empty texts stay; rows are judged one by one, whatever their ids,
    by their whole texts.  An empty table gives an empty one.
    """
    place = df.columns.index(text_col)
    held: list[_Scorer] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(_Scorer(model))
        texts = batch.column(place).to_pylist()
        scores = np.array([held[0].score(t) if t else 0.0 for t in texts])
        return batch.filter(pa.array(model.grades(scores)[:, 0] > 0.5))

    return map_batches(df, work, df.schema)
