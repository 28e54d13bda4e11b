"""Progress of long streams, and de-duplication by the pace of each broker partition."""

import pytest
from pyspark.sql import functions as F

from tallyloom.streaming import dedupe, jobs, progress

ROWS = "id long, event_time timestamp"


def land_files(spark, folder, files, rows=4):
    """Small files in order; the last holds rows far behind the others."""
    for i in range(files):
        hours = [i * 24 + j for j in range(rows)] if i < files - 1 else [j for j in range(rows)]
        data = spark.createDataFrame([(i * 100 + j, h) for j, h in enumerate(hours)], "id long, h long")
        data.select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("h") * 3600).alias("event_time")).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def few_remembered(spark):
    name = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(name, "3")
    yield
    spark.conf.unset(name)


def test_progress_keeps_every_batch_and_the_late_rows(spark, scratch_dir, few_remembered, monkeypatch):
    monkeypatch.setattr(progress, "BATCHES_PER_FILE", 4)
    land_files(spark, f"{scratch_dir}/in", 10)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{scratch_dir}/in")
    once = stream.withWatermark("event_time", "1 day").dropDuplicatesWithinWatermark(["id"])
    targets = jobs.Targets(f"{scratch_dir}/out")
    with progress.recorded(spark, f"{scratch_dir}/progress", {"kept"}) as log:
        run = {"kept": jobs.to_parquet(once, targets, "kept"), "other": jobs.to_parquet(stream, targets, "other")}
        jobs.drain(run)
        log.settle(run.values())
    rows = progress.figures(spark, f"{scratch_dir}/progress")
    total = progress.summary(rows).first()
    dropped = 40 - jobs.written(spark, targets, "kept").count()
    assert dropped == 4 and (total.query, total.rows_in, total.dropped_late) == ("kept", 40, 4)
    assert total.batches >= 10 and sorted(r.batch for r in rows.collect()) == list(range(total.batches))
    assert total.most_state_rows > 0 and rows.filter("watermark > timestamp'2001-01-01'").count() > 0
    assert jobs.progress(spark, {"kept": run["kept"]}).count() <= 3

    # A second run goes on from the checkpoint and in the same files.
    land_files(spark, f"{scratch_dir}/in", 2)
    with progress.recorded(spark, f"{scratch_dir}/progress", {"kept"}) as log:
        run = {"kept": jobs.to_parquet(once, targets, "kept")}
        jobs.drain(run)
        log.settle(run.values())
    again = progress.summary(progress.figures(spark, f"{scratch_dir}/progress")).collect()
    assert [(r.rows_in, r.batches > total.batches) for r in again] == [(48, True)]


def test_progress_of_more_batches_than_a_query_remembers(spark, scratch_dir):
    spark.range(420).repartition(105).write.parquet(f"{scratch_dir}/in")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{scratch_dir}/in")
    with progress.recorded(spark, f"{scratch_dir}/progress") as log:
        run = stream.writeStream.format("noop").queryName("many").option("checkpointLocation", f"{scratch_dir}/c").trigger(availableNow=True).start()
        run.awaitTermination()
        log.settle([run])
    total = progress.summary(progress.figures(spark, f"{scratch_dir}/progress")).first()
    assert (total.batches, total.rows_in, total.dropped_late) == (105, 420, 0)
    assert len(run.recentProgress) <= 100


def test_a_failing_figure_is_told(spark, scratch_dir):
    log = progress.ProgressLog(spark, f"{scratch_dir}/progress")
    log.failure = OSError("disk")
    with pytest.raises(OSError):
        log.settle([])
    with pytest.raises(TimeoutError):
        progress.ProgressLog(spark, scratch_dir).settle([type("Q", (), {"runId": "x"})()], timeout=0.01)


SCHEMA = "event_id string, event_time timestamp, kafka_partition int, kafka_offset long, amount long"


def deliver(spark, folder, rows):
    """One landing: ``(id, day, partition, offset)``; ``amount`` is null or beyond what a double holds."""
    data = [(i, d * 86400, p, o, None if o % 2 else 2**60 + o) for i, d, p, o in rows]
    df = spark.createDataFrame(data, "event_id string, s long, kafka_partition int, kafka_offset long, amount long")
    df.select("event_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("event_time"), "kafka_partition", "kafka_offset", "amount").coalesce(1).write.mode("append").parquet(folder)


def drained(spark, folder, name="once", **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    targets = jobs.Targets(f"{folder}/out")
    with dedupe.with_state_store(spark):
        run = jobs.to_parquet(dedupe.dedupe_by_partition(stream, "event_id", delay="2 days", **{"buckets": 1, **options}), targets, name)
    jobs.drain({name: run})
    return [(r.event_id, r.kafka_partition, r.kafka_offset, r.amount) for r in jobs.written(spark, targets, name).collect()]


def test_a_lagging_partition_loses_nothing_and_redeliveries_end(spark, scratch_dir):
    folder = f"{scratch_dir}/in"
    deliver(spark, folder, [("a1", 0, 0, 2), ("a1", 0, 0, 1), ("a2", 1, 0, 3)])
    deliver(spark, folder, [(f"a{i}", i, 0, 10 + i) for i in range(3, 9)] + [("a2", 1, 0, 30)])
    # Partition 1 lands seven days behind; some of its rows come twice, one of them in another partition.
    deliver(spark, folder, [(f"b{i}", i, 1, i) for i in range(4)] + [("b3", 3, 1, 9)])
    deliver(spark, folder, [("b3", 3, 2, 1), ("b0", 0, 1, 11), ("c", 20, 1, 12)])
    # a8 is held still; a1, b0 and the second b3 are behind their own partitions by more than the delay.
    deliver(spark, folder, [("a8", 8, 0, 40), ("a1", 0, 0, 41), ("b3", 3, 1, 13)])
    got = drained(spark, scratch_dir)
    want = [("a1", 0, 1), ("a2", 0, 3), *[(f"a{i}", 0, 10 + i) for i in range(3, 9)], *[(f"b{i}", 1, i) for i in range(4)], ("c", 1, 12)]
    assert sorted(got) == sorted((i, p, o, None if o % 2 else 2**60 + o) for i, p, o in want)
    assert sorted(drained(spark, scratch_dir, "dealt", buckets=5)) == sorted(got)
    # A second run goes on with the ids held in the checkpoint.
    deliver(spark, folder, [("a8", 8, 0, 50), ("d", 8, 0, 51)])
    assert len(drained(spark, scratch_dir)) == len(want) + 1


def test_sweeps_free_the_ids_that_are_given_up(spark, scratch_dir):
    folder = f"{scratch_dir}/in"
    for day in range(0, 40, 4):
        deliver(spark, folder, [(f"e{day}-{i}", day, 0, day * 10 + i) for i in range(20)])
    with progress.recorded(spark, f"{scratch_dir}/progress") as log:
        got = drained(spark, scratch_dir)
        log.settle([])
    assert len(got) == 200
    held = spark.read.format("statestore").option("stateVarName", "seen").load(jobs.Targets(f"{scratch_dir}/out").checkpoint("once")).count()
    assert held <= 60


def test_a_timer_frees_a_bucket_without_rows():
    class Held(dict):
        def iterator(self):
            return iter(list(self.items()))

        def removeKey(self, key):  # noqa: N802
            del self[key]

    timers = []
    processor = dedupe.FirstDelivery(1_000, 60)
    processor.handle = type("Handle", (), {"registerTimer": lambda _, at: timers.append(at)})()
    processor.heads, processor.seen = Held({(0,): (5_000, 0), (1,): (100, 0)}), Held({("old",): (0, 3_999), ("young",): (0, 4_000), ("other",): (1, 0)})
    clock = type("Clock", (), {"getCurrentProcessingTimeInMs": lambda _: 7})()
    assert list(processor.handleExpiredTimer((0,), clock, None)) == [] and set(processor.seen) == {("young",), ("other",)} and timers == [67]


def test_delay_in_words():
    assert dedupe.delay_ms("3 days") == 259_200_000 and dedupe.delay_ms("1 hour") == 3_600_000
    with pytest.raises(KeyError):
        dedupe.delay_ms("3 moons")
