"""Tables written in the shared folder, rows dealt over tasks, and joins on keys of which some may have very many rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that one task may join; the rows of a key beyond them are dealt over as many tasks as that takes.
ROWS_PER_KEY = 1 << 20
#: Rows that make much work, such as a fit each, of one task.
ROWS_PER_TASK = 1 << 13
#: Rows of whole groups of one task.
ROWS_PER_GROUP = 1 << 19


def dealt(rows: DataFrame, *keys: str, most: int = ROWS_PER_TASK) -> DataFrame:
    """``rows`` dealt over a task for every ``most`` of them, and one for each core at least; rows of equal ``keys`` meet, if any are given.

    For narrow rows of which each makes much work or many rows: however large the table, a task's share stays the same.
    ``rows`` are counted, so they should be a table.
    """
    return rows.repartition(tasks_for(rows, rows.count(), most), *keys)


def dealt_groups(rows: DataFrame, *keys: str, most: int = ROWS_PER_GROUP) -> tuple[DataFrame, int | None]:
    """``rows`` with those of equal ``keys`` in one task, about ``most`` of them a task, and the number of tasks.

    If some key has more than ``most`` rows itself they stay as they are, and the number is None: such a group is no work for one task.
    """
    if not keys:
        return rows, None
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.max("n").alias("largest")).first()
    if not sizes["total"] or sizes["largest"] > most:
        return rows, None
    tasks = tasks_for(rows, sizes["total"], most)
    return rows.repartition(tasks, *keys), tasks


def tasks_for(rows: DataFrame, n: int, most: int = ROWS_PER_GROUP) -> int:
    """A task for every ``most`` of ``n`` rows, and one for each core at least."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // most))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only in local mode, where all see one disk, a temporary one is made if it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="scanweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: an executor lost later costs no work done before. It goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended before the driver: the folder stays
        pass


def dealt_join(wide: DataFrame, narrow: DataFrame, keys: list[str], how: str = "inner", most: int = ROWS_PER_KEY) -> DataFrame:
    """``wide`` joined with ``narrow`` on ``keys``; the rows of ``wide`` of one key are dealt over one task for every ``most`` of them.

    The rows of ``narrow`` of such a key go to each of its tasks. ``how`` is inner, left, left_semi or left_anti; null keys don't meet.
    """
    tasks = F.ceil(F.count("*") / most).cast("int").alias("__tasks")
    hot = wide.groupBy(*keys).agg(tasks).filter("__tasks > 1")
    at = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in wide.columns]), F.coalesce("__tasks", F.lit(1))).cast("int")
    salted = wide.join(hot, keys, "left").withColumn("__salt", at).drop("__tasks")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("__tasks", F.lit(1)) - 1))
    copied = narrow.join(hot, keys, "left").withColumn("__salt", every).drop("__tasks")
    return salted.join(copied, [*keys, "__salt"], how).drop("__salt")
