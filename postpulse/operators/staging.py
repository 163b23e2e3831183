"""Intermediate results that several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Estimated bytes (compressed, of the columns read) for a task; fewer tasks than this are left to
#: Spark; and most tasks, for sizes that are not known.
TASK_BYTES, LEAST_TASKS, MOST_TASKS = 2 << 20, 4, 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one of a local session's own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(frame: DataFrame) -> DataFrame:
    """``frame`` written down once in the checkpoint folder, cutting its lineage."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def tasks_for(frame: DataFrame) -> int | None:
    """Tasks that the estimated size of ``frame`` asks for; none if it is small."""
    size = int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = min(-(-size // TASK_BYTES), MOST_TASKS)
    return wanted if wanted > LEAST_TASKS else None


def dealt(frame: DataFrame, tasks: int | None, key: str) -> DataFrame:
    """``frame`` dealt by ``key`` to so many tasks, whatever their number of cores; as it is without a number.

    Shuffles that Spark adds for a join are merged into one task a core, whose
    sort and aggregation then grow with the input; these stay apart.  Both
    sides of a join are dealt alike.  Keys have to repeat evenly, since shuffles
    of a stated number are not split when skewed.
    """
    return frame.repartition(tasks, key) if tasks else frame
