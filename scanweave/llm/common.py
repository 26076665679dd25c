"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch: whole texts travel in batches, so this bounds a Python worker's memory.
ARROW_BYTES = 1 << 20
#: A key is hot that has more than ``HOT_LEAST`` rows and more than one in ``HOT_KEYS`` of all, so there are at most ``HOT_KEYS``.
HOT_KEYS, HOT_LEAST, SALTS = 4096, 128, 64
_tables: dict[int, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of ``ARROW_BYTES`` or one row, if that is longer; the session keeps this setting."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (null: empty), whatever else ``docs`` has."""
    bounded_batches(docs.sparkSession)
    return docs.select(
        col(id_col).cast("long").alias("doc_id"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset a temporary one is set, but only in local mode: on a cluster
    the machines would not see one another's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="scanweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path for a new table in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, path)
    return path


def written(df: DataFrame, label: str, replaces: DataFrame | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs no more than the tasks that
    run after the table. The table ``replaces``, which nothing else may need, goes then;
    all others go when the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    if replaces is not None and id(replaces) in _tables:
        _removed(spark, _tables.pop(id(replaces)))
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = path
    return out


def _removed(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended before the driver: the folder stays
        pass


def dealt_join(wide: DataFrame, narrow: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``wide`` joined with ``narrow`` on ``keys``, where some keys may have very many rows of ``wide``.

    Hot keys, at most ``HOT_KEYS`` by their definition, are counted in ``wide``, which should be a
    table, or taken from ``counts`` (keys, n), and broadcast. Their rows of ``wide`` are dealt over
    ``SALTS`` tasks, to each of which their rows of ``narrow`` go. Null keys don't meet.
    """
    spark = wide.sparkSession
    counted = wide.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    total = wide.count() if counts is None else counts.agg(F.sum("n")).first()[0] or 0
    hot = counted.filter(F.col("n") > max(HOT_LEAST, total // HOT_KEYS)).select(*keys).collect() if total > HOT_LEAST else []
    if not hot:
        return wide.join(narrow, keys, how)
    marked = F.broadcast(spark.createDataFrame(hot, counted.select(*keys).schema).withColumn("__hot", F.lit(True)))
    dealt = F.pmod(F.xxhash64(*[col(c) for c in wide.columns]), F.lit(SALTS)).cast("int")
    salted = wide.join(marked, keys, "left").withColumn("__salt", F.when(F.col("__hot"), dealt).otherwise(0)).drop("__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = narrow.join(marked, keys, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return salted.join(copied, [*keys, "__salt"], how).drop("__salt")


def signed(value: int) -> int:
    """A 64-bit pattern as Spark's signed long."""
    return value - (1 << 64) if value >> 63 else value
