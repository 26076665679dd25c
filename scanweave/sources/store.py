"""A store of result tables that grows part by part and is read only as far as it was committed.

Each part of a table is a Parquet folder of its own. A commit writes a manifest with the list of all parts under a
temporary name and renames it, so a reader sees the parts of one commit, all or none. A job that runs again writes its part again, in the
same place.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_PART = re.compile(r"[A-Za-z0-9_-]+")


class Store:
    """The store below ``path``, on any file system that Spark reads and that renames files."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._pending: dict[str, list[str]] = {}

    def _place(self, name: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at, system = self._place("manifests")
        if not system.exists(at):
            return []
        names = [status.getPath().getName() for status in system.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        return max(self._versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """``tables``, each with its parts in order, and ``attributes``."""
        number = self.version() if version is None else version
        if not number:
            return {"tables": {}, "attributes": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{number}.json", wholetext=True).first()[0])

    def append(self, table: str, part: str, rows: DataFrame) -> None:
        """The rows of one part, such as a scan's, which readers see after the next commit. A part that was written but not committed is replaced."""
        if not (_PART.fullmatch(table) and _PART.fullmatch(part)):
            raise ValueError(f"{table!r} and {part!r} must be letters, digits, - and _")
        if part in self.manifest()["tables"].get(table, []):
            raise ValueError(f"part {part} of {table} has been committed")
        rows.write.mode("overwrite").parquet(f"{self.path}/tables/{table}/{part}")
        own = self._pending.setdefault(table, [])
        if part not in own:
            own.append(part)

    def commit(self, attributes: dict | None = None) -> int:
        """Everything appended since the last commit becomes visible; the new version's number.

        If another writer has committed in between, this is an error and nothing becomes visible; try again.
        """
        before = self.version()
        known = self.manifest(before)
        tables = known["tables"] | {t: known["tables"].get(t, []) + parts for t, parts in self._pending.items()}
        text = json.dumps({"tables": tables, "attributes": known["attributes"] | (attributes or {})})
        draft, system = self._place(f"manifests/.{before + 1}-{id(self)}.partial")
        final, _ = self._place(f"manifests/{before + 1}.json")
        out = system.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if system.exists(final) or not system.rename(draft, final):
            system.delete(draft, False)
            raise ValueError(f"version {before + 1} has been committed by another writer")
        self._pending = {}
        return before + 1

    def abort(self) -> None:
        """What was appended and not committed goes."""
        for table, parts in self._pending.items():
            for part in parts:
                at, system = self._place(f"tables/{table}/{part}")
                system.delete(at, True)
        self._pending = {}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """All committed parts of a table, of the last version or an earlier one; columns that a part lacks are null."""
        parts = self.manifest(version)["tables"].get(table)
        if not parts:
            raise KeyError(f"the store has no table {table!r}")
        frames = [self.spark.read.parquet(f"{self.path}/tables/{table}/{p}") for p in parts]
        if len({f.schema.simpleString() for f in frames}) == 1:
            return self.spark.read.schema(frames[0].schema).parquet(*[f"{self.path}/tables/{table}/{p}" for p in parts])
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
