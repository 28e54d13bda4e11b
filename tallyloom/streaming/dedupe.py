"""De-duplication of a stream at the pace of each broker partition.

A watermark follows the latest event time of the whole stream, so a partition that lags behind loses
rows whose ids are new. Here every partition has a watermark of its own: its rows are late, and its ids
are given up, when that partition has moved on by the delay, whatever the others do.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Groups of ids, by hash; each is a key of the state and one call per micro-batch.
BUCKETS = 64
#: Processing time between two sweeps of a bucket's given-up ids, where timers run.
SWEEP_MS = 60_000
#: Without timers a bucket is swept whenever a partition has moved on by this share of the delay.
SWEEPS_PER_DELAY = 4

_UNITS = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}


def delay_ms(delay: str) -> int:
    """Milliseconds of a delay such as ``3 days``."""
    number, unit = delay.split()
    return int(number) * _UNITS[unit.lower().rstrip("s")]


class FirstDelivery(StatefulProcessor):
    """Lets the first row of an id pass and holds the id for the delay, by its own partition's event time.

    State per bucket of ids: ``heads``, the latest event time per broker partition, and ``seen``, the
    partition and event time of each id held. Whether an id is still held is decided by the heads at
    the start of the micro-batch, so the answer depends on the data alone; sweeps only free what is
    no longer asked for. They come with the data, or by a timer (``sweep``, milliseconds) as well.
    """

    def __init__(self, delay: int, sweep: int | None):
        self.delay, self.sweep = delay, sweep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heads = handle.getMapState("heads", "partition long", "at long, swept long")
        self.seen = handle.getMapState("seen", "id string", "partition long, at long")

    def _held(self, heads: dict[int, tuple[int, int]], partition: int, at: int) -> bool:
        return partition not in heads or at >= heads[partition][0] - self.delay

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        heads = {k[0]: (v[0], v[1]) for k, v in self.heads.iterator()}
        latest, first = {}, {}
        for row in rows:
            latest[row["_part"]] = max(latest.get(row["_part"], row["_at"]), row["_at"])
            known = first.get(row["_id"])
            if known is None or (row["_part"], row["_offset"]) < (known["_part"], known["_offset"]):
                first[row["_id"]] = row
        for name, row in first.items():
            if not self._held(heads, row["_part"], row["_at"]):
                continue  # behind its own partition: its id may have been given up
            held = self.seen.getValue((name,)) if self.seen.containsKey((name,)) else None
            if held is not None and self._held(heads, held[0], held[1]):
                continue
            self.seen.updateValue((name,), (row["_part"], row["_at"]))
            yield Row(row=row["row"])
        moved = False
        for partition, at in latest.items():
            before, swept = heads.get(partition, (at - 1, at))
            if at > before:
                due = at >= swept + self.delay // SWEEPS_PER_DELAY
                moved |= due
                heads[partition] = (at, at if due else swept)
                self.heads.updateValue((partition,), heads[partition])
        if moved:
            self._sweep(heads)
        if self.sweep is not None and next(iter(self.handle.listTimers()), None) is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.sweep)

    def _sweep(self, heads: dict[int, tuple[int, int]]) -> bool:
        """Gives ids up; is one held still?"""
        kept, gone = False, []
        for name, held in self.seen.iterator():
            if self._held(heads, held[0], held[1]):
                kept = True
            else:
                gone.append(name)
        for name in gone:
            self.seen.removeKey(name)
        return kept

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self._sweep({k[0]: (v[0], v[1]) for k, v in self.heads.iterator()}):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.sweep)
        return iter(())

    def close(self) -> None:
        pass


def dedupe_by_partition(
    df: DataFrame,
    key: str,
    *,
    partition: str = "kafka_partition",
    offset: str = "kafka_offset",
    event_time: str = "event_time",
    delay: str = "3 days",
    buckets: int = BUCKETS,
    sweep_ms: int | None = None,
) -> DataFrame:
    """One row per ``key`` of a stream: the first delivered, by partition and offset inside a micro-batch.

    A row is late when its partition brought events more than ``delay`` later, in an earlier
    micro-batch, to the row's bucket. Late rows are dropped, as their ids may have been given up, so a
    redelivery never passes with the event time it had; a partition that lags loses nothing. Rows without
    an id all pass as one; rows without an event time are held until their partition moves on from
    time 0. Ids are dealt into ``buckets`` by a hash, so neither a hot id nor a hot partition decides a
    task's share. ``sweep_ms`` (``SWEEP_MS``, say) sets timers that also free buckets which get no more
    rows; a query with timers never runs dry, so a drain (``availableNow``) goes without. Needs the
    RocksDB state store, see ``with_state_store``.
    """
    packed = df.select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id"),
        F.coalesce(F.col(partition).cast("long"), F.lit(-1)).alias("_part"),
        F.coalesce(F.col(offset).cast("long"), F.lit(-1)).alias("_offset"),
        F.coalesce(F.unix_millis(F.col(event_time)), F.lit(0)).alias("_at"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
    )
    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType)])
    first = packed.groupBy("_bucket").transformWithState(FirstDelivery(delay_ms(delay), sweep_ms), schema, "append", "none" if sweep_ms is None else "processingTime")
    return first.select("row.*")


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; a query holds on to its store by itself."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
