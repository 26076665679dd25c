"""SPEC text files as tables: scans, columns and rows, parsed by DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

V = F.col
#: Commands with one interval count, a motor and its ends.
STEP_COMMANDS = r"^\s*(\w*scan)\s+(\S+)\s+(-?[\d.eE+]+)\s+(-?[\d.eE+]+)\s+(\d+)(?:\s+([\d.eE+-]+))?"


def scan_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``path, scan, command, lines`` for each ``#S`` block; of a scan number given twice in a file the later block holds."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), V("value").alias("text"))
    return blocks_of(files)


def blocks_of(files: DataFrame) -> DataFrame:
    """The same from ``path, text``."""
    parts = files.select("path", F.posexplode(F.split("text", r"(?m)^#S ")).alias("at", "block")).filter("at > 0")
    lines = F.split("block", r"\r?\n")
    head = F.regexp_extract(lines[0], r"^(\d+)\s*(.*)$", 1), F.regexp_extract(lines[0], r"^(\d+)\s*(.*)$", 2)
    found = parts.select("path", "at", head[0].cast("int").alias("scan"), head[1].alias("command"), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))).alias("lines"))
    last = F.row_number().over(Window.partitionBy("path", "scan").orderBy(F.desc("at")))
    return found.withColumn("__r", last).filter("__r = 1").drop("__r", "at")


def labels() -> F.Column:
    """The ``#L`` labels of a block, which two blanks part, or single ones if their number differs from ``#N``."""
    line = F.element_at(F.filter("lines", lambda x: x.startswith("#L ")), 1)
    n = F.regexp_extract(F.element_at(F.filter("lines", lambda x: x.startswith("#N ")), 1), r"#N\s+(\d+)", 1).try_cast("int")
    body = F.trim(F.substring(line, 4, 1 << 20))
    wide, narrow = F.split(body, r"\s{2,}"), F.split(body, r"\s+")
    return F.when(n.isNull() | (F.size(wide) == n), wide).otherwise(narrow)


def scan_rows(blocks: DataFrame) -> DataFrame:
    """``path, scan, row, values``: a map from label to number for each data row with as many numbers as labels."""
    data = F.filter("lines", lambda x: (F.length(F.trim(x)) > 0) & ~x.startswith("#"))
    rows = blocks.withColumn("labels", labels()).select("path", "scan", "labels", F.posexplode(data).alias("row", "line"))
    numbers = F.transform(F.split(F.trim("line"), r"\s+"), lambda s: s.try_cast("double"))
    return rows.withColumn("numbers", numbers).filter(F.size("numbers") == F.size("labels")).select(
        "path", "scan", "row", F.map_from_arrays("labels", "numbers").alias("values")
    )


def scan_table(blocks: DataFrame) -> DataFrame:
    """``path, scan, command, rows, planned, aborted, status``; only the last scan of a file can be running."""
    data = F.size(F.filter("lines", lambda x: (F.length(F.trim(x)) > 0) & ~x.startswith("#")))
    planned = F.regexp_extract("command", STEP_COMMANDS, 5).try_cast("int") + 1
    aborted = F.exists("lines", lambda x: x.startswith("#C ") & x.contains("aborted"))
    ended = aborted | F.exists("lines", lambda x: x.startswith("#R"))
    last = V("scan") == F.max("scan").over(Window.partitionBy("path"))
    out = blocks.select("path", "scan", "command", data.alias("rows"), planned.alias("planned"), aborted.alias("aborted"), ended.alias("ended"), last.alias("last"))
    short = F.coalesce(V("rows") < V("planned"), F.lit(False))
    status = (
        F.when(V("last") & ~V("ended") & short, "running").when(V("rows") == 0, "empty").when(V("aborted") | short, "aborted").otherwise("complete")
    )
    return out.withColumn("status", status).drop("ended", "last")


def parse_commands(titles: DataFrame, column: str = "command") -> DataFrame:
    """``titles`` with ``kind, motor, start, stop, points`` of a step command; null where it isn't one."""
    part = lambda k: F.nullif(F.regexp_extract(column, STEP_COMMANDS, k), F.lit(""))
    return titles.withColumns({
        "kind": part(1), "motor": part(2), "start": part(3).try_cast("double"), "stop": part(4).try_cast("double"), "points": part(5).try_cast("int") + 1,
    })
