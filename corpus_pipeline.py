"""A corpus pipeline of five stages, each over all that the one before kept.

``run`` applies them to ``documents``; every stage's result is written as
Parquet in the shared folder and read again as the next stage's documents,
then the tables it was made from are deleted.  All stages but the last return
the columns of ``documents``, whatever other columns they are given; an empty
table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm import mixing, packing, pii, simhash, toxicity
from postpulse.llm.common import cleared, drop_path, fresh_path, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go; all others stay unchanged.

    The model is fitted on labelled documents of the source table, so that it
    does not depend on what a stage was given.  Null and empty texts stay;
    rows that share an id are judged each by its own text.
    """
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the smallest id stays.

    Null and empty texts are one group.  Of repeated rows one stays; where one
    id has texts of several groups, each group is decided by itself.  Rows
    with a null id all stay.
    """
    return simhash.first_of_each(docs).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in angle brackets.

    Null texts stay null, with a null ``n_chars``; every row stays.
    """
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the source mix takes it: 0 to 3 rows.

    A null source is a source of its own.  Texts without a word, null ones
    among them, have size 0 and are not taken; rows are taken one by one,
    whether or not they share an id.
    """
    taken = mixing.copies(docs)
    return taken.select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, each with its place in a training sequence.

    A null text is empty: one piece with the end id.  Repeated rows and null
    ids are packed each for itself.
    """
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the model, the random field or byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        with cleared(spark):
            docs = written(stage(spark, docs, sf_dir), path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
