"""Scan packages and cached results: Parquet folders named or checked by a fingerprint of what made them."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession


def fingerprint(parameters: dict) -> str:
    """The SHA-1 of parameters, whatever their order."""
    return hashlib.sha1(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()


def file_records(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, size and change time of the files below a folder, which identify data for a cache."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", "modificationTime")


def _manifest(spark: SparkSession, path: str) -> dict:
    try:
        rows = spark.read.text(f"{path}/manifest", wholetext=True).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    return json.loads(rows[0].value) if rows else {}


def write_package(tables: dict[str, DataFrame], path: str, parameters: dict, partition_by: dict[str, list[str]] | None = None) -> bool:
    """Tables as Parquet below ``path`` with a manifest written last; false, and nothing written, if the fingerprint is unchanged."""
    spark = next(iter(tables.values())).sparkSession
    made = fingerprint(parameters)
    if _manifest(spark, path).get("fingerprint") == made:
        return False
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{path}/{name}")
    text = json.dumps({"fingerprint": made, "tables": sorted(tables), "parameters": parameters}, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return True


def read_package(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    found = _manifest(spark, path)
    return {name: spark.read.parquet(f"{path}/{name}") for name in found.get("tables", [])}


def cached(df_maker, spark: SparkSession, root: str, parameters: dict) -> DataFrame:
    """The result of ``df_maker()``, kept as Parquet under the fingerprint of ``parameters`` and read again next time."""
    path = f"{root}/{fingerprint(parameters)}"
    if not _manifest(spark, path):
        write_package({"result": df_maker()}, path, parameters)
    return read_package(spark, path)["result"]
