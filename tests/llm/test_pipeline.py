"""The pipeline at the smallest size, each stage on what the one before kept."""

from __future__ import annotations

import corpus_pipeline
import pytest

from postpulse.llm import simhash, toxicity
from postpulse.llm.catalogue import queries
from postpulse.llm.common import table


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, kept = table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = kept[name] = spark.read.parquet(path)
    return kept


def test_order_and_columns(stages):
    assert list(stages) == [
        "toxicity",
        "simhash_near_dedup",
        "personal_data",
        "source_mix",
        "best_fit_packing",
    ]
    for name in list(stages)[:-1]:
        assert tuple(stages[name].columns) == corpus_pipeline.COLUMNS


def test_stages_take_effect(spark, sf_dir, stages):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rejected = {r.doc_id for r in toxicity.severity(docs, model).where("toxic").collect()}
    first = {r.doc_id for r in stages["toxicity"].collect()}
    assert first == {r.doc_id for r in docs.collect()} - rejected
    groups = simhash.near_duplicates(stages["toxicity"]).collect()
    second = [r.doc_id for r in stages["simhash_near_dedup"].collect()]
    assert sorted(second) == sorted({r.component_id for r in groups})
    third = stages["personal_data"]
    assert third.count() == len(second)
    assert third.where("text rlike '@mail[0-9]'").count() == 0
    words = third.selectExpr("sum(size(split(trim(text), '[ \\n\\t\\r]+')))").first()[0]
    mixed = stages["source_mix"].selectExpr("sum(size(split(trim(text), '[ \\n\\t\\r]+')))").first()[0]
    assert abs(mixed / words - 1) < 0.02
    packed = stages["best_fit_packing"]
    assert packed.where("piece = 0").count() == stages["source_mix"].count()


def test_every_operator_has_a_query(spark, sf_dir):
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]


@pytest.mark.parametrize("name", list(queries()))
def test_queries_run_whole(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0


def test_embedding_links_match_sql(spark, sf_dir):
    from tests.compare import canonical, connection

    from postpulse.llm.catalogue import oracle_sql

    frame = queries()["op10_embedding_links"](spark, sf_dir)
    answer = connection(sf_dir).execute(oracle_sql()["op10_embedding_links"])
    columns = [c[0] for c in answer.description]
    found = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    assert found == canonical(columns, answer.fetchall())


def odd_documents(spark, rows):
    """Documents with columns besides their own, named as those stages work with."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, rank int, times long"
    return spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], schema)


ODD = [
    (1, "one two three four five", "en", "a", 23),
    (1, "one two three four five", "en", "a", 23),
    (1, "some other words under this id", "en", "a", 30),
    (2, "one two three four five", None, "b", 23),
    (3, None, "en", "a", None),
    (4, "", "en", None, 0),
    (None, "a text of no id at all here", "en", None, 27),
    (None, "a text of no id at all here", "en", None, 27),
    (5, "write to x.y@mail.example.com or 10.0.0.1 today", "en", "b", 46),
    (6, "word " * 30_000, "en", "c", 150_000),
]


def test_stages_on_odd_documents(spark, sf_dir):
    """Nulls in every column, empty and very long texts, repeats, reused ids and clashing names."""
    found, docs = {}, odd_documents(spark, ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        found[name] = sorted(((r.doc_id or 0, r.text) for r in docs.collect()), key=str)
    assert len(found["toxicity"]) == len(ODD)
    kept = found["simhash_near_dedup"]
    assert [d for d, _ in kept] == [0, 0, 1, 1, 3, 5, 6]
    assert {t for d, t in kept if d == 1} == {ODD[0][1], ODD[2][1]}
    masked = dict(found["personal_data"])
    assert masked[5] == "write to <email> or <ip> today" and masked[3] is None
    assert not {3, 4} & {d for d, _ in found["source_mix"]}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.where("piece = 0").count() == len(found["source_mix"])


def test_stages_on_no_documents(spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_documents(spark, []), sf_dir).count() == 0


def test_run_leaves_only_what_its_result_needs(spark, sf_dir):
    from pathlib import Path

    from postpulse.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:")) / "postpulse"
    before = {p.name for p in folder.glob("*")}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    left = {p.name.rsplit("-", 1)[0] for p in folder.glob("*") if p.name not in before}
    assert rows and left == {"source_mix", "pieces"}
