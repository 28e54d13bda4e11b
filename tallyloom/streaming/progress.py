"""Every micro-batch's figures as a table, however long a stream runs.

A query keeps its latest batches only (``spark.sql.streaming.numRecentProgressUpdates``). The listener
here writes each batch's figures to a shared folder as they come, so totals stay complete, survive the
driver, and can be read by another session.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from tallyloom.operators.ordered import first_by

FIGURES = (
    "query string, query_id string, run_id string, batch long, at timestamp, rows_in long, rows_per_second double, "
    "dropped_late long, state_rows long, watermark timestamp"
)
#: Batches whose figures share a file.
BATCHES_PER_FILE = 500


class ProgressLog(StreamingQueryListener):
    """Appends one row per micro-batch below ``path``: a JSON line in the file of its query and range of batches.

    A file is written anew, under a passing name, with each of its batches and then renamed, so readers
    see whole lines only. A run that goes on from a checkpoint takes up the file it finds. A batch that
    is repeated after a failure is a line of its own; ``figures`` counts the last one.
    """

    def __init__(self, spark: SparkSession, path: str, names: set[str] | None = None):
        self.spark, self.path, self.names = spark, path.rstrip("/"), names
        self.ended: set[str] = set()
        self.failure: Exception | None = None
        self.changed = threading.Condition()
        self.open: dict[str, tuple[str, list[str]]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if self.names is not None and p.name not in self.names:
            return
        states = p.stateOperators or []
        row = {
            "query": p.name,
            "query_id": str(p.id),
            "run_id": str(p.runId),
            "batch": int(p.batchId),
            "at": p.timestamp,
            "rows_in": int(p.numInputRows),
            "rows_per_second": float(p.processedRowsPerSecond or 0.0),
            "dropped_late": sum(int(s.numRowsDroppedByWatermark) for s in states),
            "state_rows": sum(int(s.numRowsTotal) for s in states),
            "watermark": (p.eventTime or {}).get("watermark"),
        }
        try:
            self._append(row)
        except Exception as failure:  # told to whoever waits for the figures, not to the bus
            self.failure = failure

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def _append(self, row: dict) -> None:
        name = f"{row['query_id']}-{row['batch'] // BATCHES_PER_FILE:08d}"
        at, lines = self.open.get(row["query_id"], ("", []))
        if at != name:
            lines = self._read(name)
        lines.append(json.dumps(row))
        self.open[row["query_id"]] = (name, lines)
        self._write(name, lines)

    def _files(self, name: str):
        jvm = self.spark.sparkContext._jvm
        final, passing = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}") for n in (f"{name}.json", f"_{name}.tmp"))
        return final.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), final, passing

    def _read(self, name: str) -> list[str]:
        fs, final, _ = self._files(name)
        if not fs.exists(final):
            return []
        return [r.value for r in self.spark.read.text(final.toString()).collect()]

    def _write(self, name: str, lines: list[str]) -> None:
        fs, final, passing = self._files(name)
        out = fs.create(passing, True)
        out.write(bytearray(("\n".join(lines) + "\n").encode()))
        out.close()
        if fs.exists(final):
            fs.delete(final, False)
        if not fs.rename(passing, final):
            raise OSError(f"could not rename {passing.toString()}")

    def settle(self, queries: Iterable[StreamingQuery], timeout: float = 60.0) -> None:
        """Waits until the figures of stopped ``queries`` have all arrived; the bus delivers them with a delay."""
        wanted = {str(q.runId) for q in queries}
        with self.changed:
            if not self.changed.wait_for(lambda: wanted <= self.ended, timeout):
                raise TimeoutError(f"no end of {sorted(wanted - self.ended)} within {timeout} s")
        if self.failure is not None:
            raise self.failure


@contextmanager
def recorded(spark: SparkSession, path: str, names: set[str] | None = None) -> Iterator[ProgressLog]:
    """Records the batches of the queries started inside, or of those ``names`` alone."""
    log = ProgressLog(spark, path, names)
    spark.streams.addListener(log)
    try:
        yield log
    finally:
        spark.streams.removeListener(log)


def figures(spark: SparkSession, path: str) -> DataFrame:
    """One row per query and micro-batch; of a repeated batch the last attempt."""
    rows = spark.read.schema(FIGURES).json(path)
    return first_by(rows, ["query_id", "batch"], [F.col("at").desc(), F.col("run_id")])


def summary(rows: DataFrame) -> DataFrame:
    """Totals per query over its micro-batches, with the largest state and the lowest rate met."""
    return rows.groupBy("query").agg(
        F.count("*").alias("batches"),
        F.sum("rows_in").alias("rows_in"),
        F.sum("dropped_late").alias("dropped_late"),
        F.max("state_rows").alias("most_state_rows"),
        F.min("rows_per_second").alias("slowest"),
    )
