"""Runs processed once each: attempts, failures and a ledger that survives restarts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

V = F.col
RECORD = "status string, attempts int, output string, error string"
FINAL = ("ok", "failed")


def attempted(rows: DataFrame, run: str, work: Callable[[pd.DataFrame], str], retries: int = 1) -> DataFrame:
    """``run, status, attempts, output, error``: ``work`` done on the rows of each run, in the tasks that hold them.

    ``work`` gets a run's rows and returns a text. An error is caught and the run tried again ``retries`` times; then its status is
    ``failed`` with the last error, and the other runs go on.
    """

    def one(part: pd.DataFrame) -> pd.DataFrame:
        error = ""
        for attempt in range(1, retries + 2):
            try:
                record = ("ok", attempt, work(part), None)
                break
            except Exception as reason:  # one bad run must not stop the others
                error = f"{type(reason).__name__}: {reason}"
        else:
            record = ("failed", retries + 1, None, error)
        return pd.DataFrame([(part[run].iloc[0], *record)], columns=[run, "status", "attempts", "output", "error"])

    return rows.groupBy(run).applyInPandas(one, f"`{run}` {rows.schema[run].dataType.simpleString()}, {RECORD}")


class Ledger:
    """The records of all runs, in one folder for each batch, below a path that all machines share.

    A batch's folder is written whole or not at all, and a batch whose folder is there is not done again.
    """

    def __init__(self, spark: SparkSession, path: str, run: str, kind: str = "string") -> None:
        self.spark, self.path, self.run, self.kind = spark, path.rstrip("/"), run, kind

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def done(self, batch: int) -> bool:
        return self._exists(f"{self.path}/batch={batch}/_SUCCESS")

    def records(self) -> DataFrame:
        """``run, status, attempts, output, error, batch`` of all runs so far."""
        schema = f"`{self.run}` {self.kind}, {RECORD}, batch long"
        if not self._exists(self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)

    def skip_list(self) -> DataFrame:
        """The runs that failed; they are not tried again until they are forgiven."""
        last = self.records().groupBy(self.run).agg(F.max_by("status", "batch").alias("status"))
        return last.filter("status = 'failed'").select(self.run)

    def pending(self, rows: DataFrame, only: list | None = None) -> DataFrame:
        """The rows of runs that are neither done nor on the skip list, and among ``only`` if that is given."""
        last = self.records().groupBy(self.run).agg(F.max_by("status", "batch").alias("status"))
        out = rows.join(last.filter(V("status").isin(*FINAL)).select(self.run), self.run, "left_anti")
        return out.filter(V(self.run).isin(only)) if only is not None else out

    def process(self, rows: DataFrame, batch: int, work: Callable[[pd.DataFrame], str], retries: int = 1, only: list | None = None) -> None:
        """The pending runs of a batch done and recorded; nothing if the batch has been recorded before."""
        if not self.done(batch):
            attempted(self.pending(rows, only), self.run, work, retries).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def forgive(self, runs: list, batch: int) -> None:
        """Failed runs become pending again, by a record of their own under a batch number not yet used."""
        if self.done(batch):
            raise ValueError(f"batch {batch} has been recorded")
        rows = self.spark.createDataFrame([(r, "pending", 0, None, None) for r in runs], f"`{self.run}` {self.kind}, {RECORD}")
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def watch_runs(stream: DataFrame, ledger: Ledger, work: Callable[[pd.DataFrame], str], checkpoint: str, retries: int = 1, once: bool = True, interval: str = "60 seconds") -> StreamingQuery:
    """Runs that arrive in a stream of rows are processed once each; ``once`` ends when all there are done.

    A run's rows should arrive in one batch, as one file does. After a crash the stream repeats its last batch; the ledger knows whether it was done.
    """
    writer = stream.writeStream.foreachBatch(lambda rows, batch: ledger.process(rows, batch, work, retries)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
