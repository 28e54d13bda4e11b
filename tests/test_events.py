import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import events as ev
from tallyloom.operators import funnel, items, parity
from tallyloom.sources import readers
from tallyloom.streaming import jobs

GOOD = {"event_id": "e1", "event_time": 1433221332117, "visitor_id": "7", "event_type": "view", "item_id": "5"}
SCHEMA = readers.BROKER_SCHEMA


def message(offset, body, partition=0, at="2015-06-02 05:03:00"):
    value = body if body is None or isinstance(body, str) else json.dumps(body)
    return (None, None if value is None else bytearray(value, "utf-8"), "t", partition, offset, datetime.fromisoformat(at))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


CASES = [
    (GOOD, None),
    (GOOD | {"event_type": "addtocart"}, None),
    (GOOD | {"transaction_id": "abc", "ingested_at": "soon"}, None),
    (GOOD | {"item_id": None}, "missing_item_id"),
    (GOOD | {"item_id": "x"}, "item_id_not_numeric"),
    (GOOD | {"item_id": "99999999999"}, "item_id_not_numeric"),
    (GOOD | {"event_time": "2015-06-02T05:02:12"}, "event_time_not_numeric"),
    (GOOD | {"event_time": 0}, "event_time_implausible"),
    (GOOD | {"event_time": "99999999999999999999"}, "event_time_implausible"),
    ({k: v for k, v in GOOD.items() if k != "event_type"}, "missing_event_type"),
    (GOOD | {"event_type": "wish"}, "unknown_event_type"),
    (GOOD | {"visitor_id": None}, "missing_visitor_id"),
    (GOOD | {"visitor_id": "u7"}, "visitor_id_not_numeric"),
    (GOOD | {"event_id": None}, "missing_event_id"),
    (GOOD | {"event_time": None}, "missing_event_time"),
    (json.dumps(GOOD)[:30], "unparseable_json"),
    ("[1, 2]", "unparseable_json"),
    ("", "empty_payload"),
    ("   ", "empty_payload"),
    (None, "empty_payload"),
    ("{}", "missing_event_id"),
]


def test_every_reason(spark):
    df = frame(spark, [message(i, body) for i, (body, _) in enumerate(CASES)])
    got = {r.kafka_offset: r.dq_reason for r in ev.classify(ev.parse(df)).select("kafka_offset", "dq_reason").collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_cast_keeps_rows_with_bad_optional_numbers(spark):
    df = frame(spark, [message(0, GOOD | {"transaction_id": "abc", "ingested_at": "soon"})])
    row = ev.cast_valid(ev.split(ev.classify(ev.parse(df)))[0]).collect()[0]
    assert row.transaction_id is None and row.ingested_at is None and row.item_id == 5


def test_payload_is_parsed_once(spark):
    df = frame(spark, [message(0, GOOD)])
    valid, rejected = ev.split(ev.classify(ev.parse(df)))
    plan = valid._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") <= 2


def dim(spark):
    return spark.createDataFrame([(5, 1, 2, 3, True), (6, 9, None, None, False)], "item_id int, category_id int, parent_category_id int, root_category_id int, is_available boolean")


def test_dedupe_is_deterministic_and_enrich_uses_unknown_member(spark):
    rows = [message(9, GOOD), message(3, GOOD | {"producer_id": "first"}), message(4, GOOD | {"event_id": "e2", "item_id": "77"}), message(5, GOOD | {"event_id": "e3", "item_id": "6"})]
    clean = {r.event_id: r for r in ev.clean_events(frame(spark, rows), dim(spark)).clean.collect()}
    assert clean["e1"].kafka_offset == 3 and clean["e1"].producer_id == "first"
    assert (clean["e2"].item_id, clean["e2"].category_id, clean["e2"].has_item_metadata) == (77, -1, False)
    # An orphan category keeps its id; the unknown parents become -1 in the event.
    assert (clean["e3"].category_id, clean["e3"].root_category_id, clean["e3"].has_item_metadata) == (9, -1, True)


def test_out_of_order_blocks_agree_with_one_window(spark):
    rows = [(i % 3, i, (i * 7919) % 101) for i in range(300)]
    df = spark.createDataFrame(rows, "p int, o long, t long")
    small = funnel.out_of_order(df, partition="p", offset="o", event_time="t", block=10)
    whole = funnel.out_of_order(df, partition="p", offset="o", event_time="t", block=10_000)
    assert sorted(small.collect()) == sorted(whole.collect())
    assert small.agg(F.sum("out_of_order")).first()[0] > 0


def test_tree_roots_with_cycle_and_depth(spark):
    chain = [(i, i + 1) for i in range(100, 130)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, None), (10, 11), (11, 10), (20, 99), *chain], "category_id int, parent_category_id int")
    roots = {r.category_id: r.root_category_id for r in items.resolve_roots(edges).collect()}
    assert roots[1] == roots[2] == roots[3] == 3
    assert roots[10] == 10 and roots[11] == 11
    assert roots[20] == 99
    assert roots[100] == roots[129] == 130


def test_latest_value_breaks_ties_by_value_and_ignores_text(spark):
    log = spark.createDataFrame(
        [(1, 5, "categoryid", "3"), (1, 5, "categoryid", "4"), (2, 6, "categoryid", "n1"), (1, 6, "available", "1"), (1, 7, "available", "0"), (9, 5, "name", "z"), (1, None, "available", "1")],
        "timestamp long, itemid int, property string, value string",
    )
    wide = {r.item_id: r for r in items.pivot_latest(items.latest_values(items.wanted_properties(log))).collect()}
    assert wide[5].category_id == 4 and wide[5].is_available is None
    assert wide[6].category_id is None and wide[6].is_available is True
    assert wide[7].is_available is False


@pytest.fixture
def landed(spark, scratch_dir):
    hour = 3_600_000
    base = GOOD["event_time"]
    first = [message(i, GOOD | {"event_id": f"a{i}", "event_time": base + i * hour}, at="2015-06-03 00:00:00") for i in range(12)]
    again = [message(20 + i, GOOD | {"event_id": f"a{i}", "event_time": base + i * hour}, at="2015-06-03 00:00:00") for i in range(4)]
    late = [message(40, GOOD | {"event_id": "late", "event_time": base}, at="2015-06-20 00:00:00"), message(41, "{broken")]
    for i, part in enumerate((first, again, late)):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{scratch_dir}/in")
    return scratch_dir


def test_stream_agrees_with_batch_and_late_rows_are_kept(spark, landed):
    targets = jobs.Targets(f"{landed}/out")
    stream = readers.landed_stream(spark, f"{landed}/in")
    run = jobs.start_cleaning(stream, dim(spark), targets, "3 days", "_t")
    jobs.drain(run)
    clean, late, bad = (jobs.written(spark, targets, f"{n}_t") for n in ("clean", "late", "quarantine"))
    assert late.count() == 1 and bad.count() == 1
    batch = ev.clean_events(readers.landed_batch(spark, f"{landed}/in"), dim(spark)).clean
    report = parity.parity(batch.filter("event_id <> 'late'"), clean, "event_id", ["event_time_ms", "item_id", "category_id"]).first()
    assert report.verdict == "PASS" and report.stream_rows == 12
    figures = jobs.progress(spark, run)
    assert figures.agg(F.sum("dropped_late")).first()[0] == 0
    jobs.reset(spark, targets, ["clean_t"])
    jobs.drain({"clean": jobs.to_parquet(ev.clean_events(readers.landed_stream(spark, f"{landed}/in"), dim(spark)).clean, targets, "clean_t", "event_date")})
    assert jobs.written(spark, targets, "clean_t").count() == 12


def test_rows_of_a_lagging_partition_are_recovered(spark, scratch_dir):
    day, base = 86_400_000, GOOD["event_time"]

    def batch(ids, first_day):
        rows = []
        for i, name in enumerate(ids):
            at = base + (first_day + i) * day
            stamp = str(datetime.fromtimestamp(at / 1000, timezone.utc).replace(tzinfo=None))
            rows.append(message(len(rows), GOOD | {"event_id": name, "event_time": at}, at=stamp))
        return rows

    landings = [batch([f"a{k}{i}" for i in range(8)], 4 * k) for k in range(3)] + [batch([f"b{i}" for i in range(9)], 0)]
    for part in landings:
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{scratch_dir}/in")
    targets = jobs.Targets(f"{scratch_dir}/out")
    run = jobs.start_cleaning(readers.landed_stream(spark, f"{scratch_dir}/in"), dim(spark), targets, "1 day", "_g")
    jobs.drain(run)
    assert jobs.progress(spark, run).filter("query = 'clean'").agg(F.sum("dropped_late")).first()[0] > 0
    for _ in range(2):  # a second pass changes nothing
        jobs.recover_dropped(readers.landed_batch(spark, f"{scratch_dir}/in"), targets, "_g")
    kept = [r.event_id for r in jobs.written(spark, targets, "clean_g").select("event_id").collect()]
    late = [r.event_id for r in jobs.late_rows(spark, targets, "_g").select("event_id").collect()]
    assert late and sorted(kept + late) == sorted({f"a{k}{i}" for k in range(3) for i in range(8)} | {f"b{i}" for i in range(9)})


def test_parity_fails_on_stream_only_rows(spark):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    assert parity.parity(a, b, "id", ["v"]).first().verdict == "FAIL"
    assert parity.parity(a, a, "id", ["v"]).first().verdict == "PASS"
