"""Quality assertions, run parity, file round trips and streaming runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import events as ev
from tallyloom.operators import parity, quality
from tallyloom.plans.clickstream import classified, clean
from tallyloom.plans.messages import BASE_SQL, CLEAN_SQL, ITEMS_SQL, dim_items, messages
from tallyloom.plans.registry import query
from tallyloom.plans.shop import SHOP_SQL, Shop, plain
from tallyloom.session import scratch
from tallyloom.sources import readers, sinks
from tallyloom.sources.tables import Tables
from tallyloom.streaming import jobs, progress

# --- assertions ----------------------------------------------------------------------------------


@query("dq_not_null", f"""WITH {ITEMS_SQL} SELECT 'category_id' AS "column", count(*) AS rows FROM dim WHERE category_id IS NULL HAVING count(*) > 0
UNION ALL SELECT 'root_category_id', count(*) FROM dim WHERE root_category_id IS NULL HAVING count(*) > 0
UNION ALL SELECT 'is_available', count(*) FROM dim WHERE is_available IS NULL HAVING count(*) > 0""")
def dq_not_null(t: Tables) -> DataFrame:
    return quality.not_null(dim_items(t), ["item_id", "category_id", "root_category_id", "is_available"])


@query("dq_unique", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_unique(t: Tables) -> DataFrame:
    return quality.unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("dq_accepted_values", "SELECT event_type, count(*) AS rows FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY 1")
def dq_accepted_values(t: Tables) -> DataFrame:
    return quality.accepted_values(t.events, "event_type", ["view", "click", "purchase"])


@query("dq_relationships", "SELECT user_id, count(*) AS rows FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def dq_relationships(t: Tables) -> DataFrame:
    dim = t.customer.filter("c_acctbal > 0").select("c_custkey")
    return quality.relationships(t.events, "user_id", dim, "c_custkey")


@query("dq_freshness", "SELECT round((epoch(TIMESTAMP '2024-02-02 00:00:00') - epoch(date_trunc('second', max(ts)))) / 3600.0, 4) AS age_hours, 'warn' AS level FROM events")
def dq_freshness(t: Tables) -> DataFrame:
    out = quality.freshness(t.events.select(F.date_trunc("second", "ts").alias("ts")), "ts", "2024-02-02 00:00:00")
    return out.select(F.round("age_hours", 4).alias("age_hours"), "level")


@query("dq_line_count", """SELECT count(*) AS modeled_rows, (SELECT count(*) FROM lineitem) AS source_rows FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderstatus <> 'P' HAVING count(*) <> (SELECT count(*) FROM lineitem)""")
def dq_line_count(t: Tables) -> DataFrame:
    kept = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return quality.line_count(t.lineitem.join(kept, "l_orderkey"), t.lineitem)


@query("dq_line_count_fact", f"WITH {SHOP_SQL} SELECT count(*) AS modeled_rows, (SELECT count(*) FROM li) AS source_rows FROM f HAVING count(*) <> (SELECT count(*) FROM li)")
def dq_line_count_fact(t: Tables) -> DataFrame:
    """The order-line fact keeps every source line: no failing row."""
    s = Shop(t)
    return quality.line_count(s.fct_orders(), s.lines)


@query("join_cross_scalar", "SELECT (SELECT count(*) FROM orders) AS modeled_rows, (SELECT count(*) FROM lineitem) AS source_rows")
def join_cross_scalar(t: Tables) -> DataFrame:
    """Two one-row counts side by side."""
    return quality.line_count(t.orders, t.lineitem)


@query("dq_payment_reconcile", f"""WITH {SHOP_SQL}, a AS (SELECT order_id, sum(item_revenue) AS line_total FROM f WHERE order_status NOT IN ('canceled', 'unavailable') GROUP BY 1),
b AS (SELECT order_id, sum(payment_value) AS payment_total FROM pay GROUP BY 1)
SELECT order_id, CAST(line_total AS DOUBLE) AS line_total, CAST(payment_total AS DOUBLE) AS payment_total, CAST(payment_total - line_total AS DOUBLE) AS difference
FROM a JOIN b USING (order_id) WHERE abs(payment_total - line_total) > 0.02 * line_total""")
def dq_payment_reconcile(t: Tables) -> DataFrame:
    s = Shop(t)
    return plain(quality.payment_reconcile(s.sales(), s.payments))


@query("dq_orphan_bound", f"WITH {ITEMS_SQL} SELECT count(DISTINCT category_id) AS orphan_categories FROM dim WHERE category_id IS NOT NULL AND root_category_id IS NULL HAVING count(DISTINCT category_id) > 2")
def dq_orphan_bound(t: Tables) -> DataFrame:
    return quality.orphan_bound(dim_items(t), 2)


@query("dq_unknown_rate", f"""WITH {CLEAN_SQL} SELECT round(count(CASE WHEN NOT has_item_metadata THEN 1 END) / count(*), 8) AS share, count(*) AS rows FROM clean
HAVING count(CASE WHEN NOT has_item_metadata THEN 1 END) / count(*) NOT BETWEEN 0.07 AND 0.12""")
def dq_unknown_rate(t: Tables) -> DataFrame:
    out = quality.share_within(clean(t), ~F.col("has_item_metadata"), 0.07, 0.12)
    return out.select(F.round("share", 8).alias("share"), "rows")


@query("dq_reconcile_counts", f"""WITH {CLEAN_SQL}, x AS (SELECT (SELECT count(*) FROM msgs) AS "read", (SELECT count(*) FROM msgs WHERE reason IS NOT NULL) AS quarantined, (SELECT count(*) FROM clean) AS clean)
SELECT "read", quarantined, clean, "read" - quarantined - clean AS duplicates_removed, round(100.0 * quarantined / "read", 4) AS quarantined_pct FROM x""")
def dq_reconcile_counts(t: Tables) -> DataFrame:
    return quality.reconcile_counts(classified(t))


@query("dq_overlap", """SELECT (SELECT CAST(min(o_orderdate) AS DATE) FROM orders) AS a_first, (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) AS a_last,
  (SELECT CAST(min(ts) AS DATE) FROM events) AS b_first, (SELECT CAST(max(ts) AS DATE) FROM events) AS b_last""")
def dq_overlap(t: Tables) -> DataFrame:
    orders = t.orders.select(F.to_date("o_orderdate").alias("d"))
    return quality.overlap(orders, t.events.select(F.to_date("ts").alias("d")), "d", "d")


@query("dq_observed_write", """WITH q AS (SELECT 1 AS i, 'l_partkey is present' AS "check", 'error' AS severity, count(CASE WHEN l_partkey IS NULL THEN 1 END) AS failing, 0 AS w, 0 AS e FROM lineitem
UNION ALL SELECT 2, 'flag is known', 'error', count(CASE WHEN l_returnflag NOT IN ('N', 'R') THEN 1 END), 0, 100 FROM lineitem
UNION ALL SELECT 3, 'quantity is plausible', 'warn', count(CASE WHEN l_quantity NOT BETWEEN 1 AND 45 THEN 1 END), 0, 0 FROM lineitem
UNION ALL SELECT 4, 'discount is moderate', 'error', count(CASE WHEN l_discount > 0.09 THEN 1 END), 10, 1000000000 FROM lineitem)
SELECT "check", severity, (SELECT count(*) FROM lineitem) AS rows, failing, CASE WHEN failing <= w THEN 'pass' WHEN severity = 'warn' OR failing <= e THEN 'warn' ELSE 'error' END AS outcome FROM q""")
def dq_observed_write(t: Tables) -> DataFrame:
    """Row-level rules counted while the order lines are written, without a pass of their own."""
    rules = [
        *quality.null_rules(["l_partkey"]),
        quality.RowRule("flag is known", ~F.col("l_returnflag").isin("N", "R"), error_above=100),
        quality.RowRule("quantity is plausible", ~F.col("l_quantity").between(1, 45), "warn"),
        quality.RowRule("discount is moderate", F.col("l_discount") > 0.09, warn_above=10, error_above=1_000_000_000),
    ]
    return quality.write_observed(t.lineitem, lambda df: df.write.parquet(scratch(t.spark, "observed")), rules)


@query("dq_all", f"""WITH {SHOP_SQL}, a AS (SELECT order_id, sum(item_revenue) AS lt FROM f WHERE order_status NOT IN ('canceled', 'unavailable') GROUP BY 1),
b AS (SELECT order_id, sum(payment_value) AS pt FROM pay GROUP BY 1), q AS (
SELECT 'line key unique' AS "check", 'warn' AS severity, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) z) AS failing, 0 AS w, 0 AS e
UNION ALL SELECT 'payments match lines', 'error', (SELECT count(*) FROM a JOIN b USING (order_id) WHERE abs(pt - lt) > 0.02 * lt), 0, 500
UNION ALL SELECT 'order has customer', 'error', (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) y), 0, 0)
SELECT "check", severity, failing, CASE WHEN failing <= w THEN 'pass' WHEN severity = 'warn' OR failing <= e THEN 'warn' ELSE 'error' END AS outcome FROM q""")
def dq_all(t: Tables) -> DataFrame:
    s = Shop(t)
    return quality.report(
        [
            quality.Check("line key unique", quality.unique(t.lineitem, ["l_orderkey", "l_linenumber"]), "warn"),
            quality.Check("payments match lines", quality.payment_reconcile(s.sales(), s.payments), "error", 0, 500),
            quality.Check("order has customer", quality.relationships(t.orders, "o_custkey", t.customer, "c_custkey")),
        ]
    )


# --- parity --------------------------------------------------------------------------------------


def replayed(t: Tables) -> DataFrame:
    """A second run that lost early purchases, repeats some sign-ups and differs in some values."""
    base = t.events.filter(~((F.col("event_type") == "purchase") & (F.col("value") < 5)))
    bent = base.withColumn("value", F.when((F.col("event_type") == "view") & (F.col("value") > 100), F.col("value") + 1).otherwise(F.col("value")))
    return bent.unionAll(bent.filter((F.col("event_type") == "signup") & (F.col("value") < 3)))


REPLAY_SQL = """b0 AS (SELECT event_id, user_id, event_type, CASE WHEN event_type = 'view' AND value > 100 THEN value + 1 ELSE value END AS value FROM events WHERE NOT (event_type = 'purchase' AND value < 5)),
rp AS (SELECT * FROM b0 UNION ALL SELECT * FROM b0 WHERE event_type = 'signup' AND value < 3)"""


@query("set_except_ids", f"WITH {REPLAY_SQL} SELECT event_id, 'a_only' AS side FROM (SELECT event_id FROM events EXCEPT SELECT event_id FROM rp) x")
def set_except_ids(t: Tables) -> DataFrame:
    return parity.except_ids(t.events, replayed(t), "event_id")


@query("join_nullsafe_compare", f"""WITH {REPLAY_SQL}, j AS (SELECT e.*, r.user_id AS u2, r.event_type AS t2, r.value AS v2 FROM events e JOIN (SELECT DISTINCT * FROM rp) r USING (event_id))
SELECT 'user_id' AS "column", count(CASE WHEN user_id IS DISTINCT FROM u2 THEN 1 END) AS differing FROM j
UNION ALL SELECT 'event_type', count(CASE WHEN event_type IS DISTINCT FROM t2 THEN 1 END) FROM j UNION ALL SELECT 'value', count(CASE WHEN value IS DISTINCT FROM v2 THEN 1 END) FROM j""")
def join_nullsafe_compare(t: Tables) -> DataFrame:
    return parity.column_agreement(t.events, replayed(t), "event_id", ["user_id", "event_type", "value"])


@query("parity_report", f"""WITH {REPLAY_SQL} SELECT (SELECT count(*) FROM events) AS batch_rows, (SELECT count(*) FROM rp) AS stream_rows, 0 AS batch_duplicates,
  (SELECT count(*) - count(DISTINCT event_id) FROM rp) AS stream_duplicates, (SELECT count(*) FROM events WHERE event_id NOT IN (SELECT event_id FROM rp)) AS batch_only, 0 AS stream_only,
  (SELECT count(*) FROM events e JOIN (SELECT DISTINCT * FROM rp) r USING (event_id) WHERE e.value <> r.value) AS differing_cells, 'FAIL' AS verdict""")
def parity_report(t: Tables) -> DataFrame:
    return parity.parity(t.events, replayed(t), "event_id", ["user_id", "event_type", "value"])


# --- files ---------------------------------------------------------------------------------------


@query("src_parquet", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def src_parquet(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("src_csv_schema", "SELECT p_type AS property, count(*) AS n, sum(p_partkey) AS keys FROM part GROUP BY 1")
def src_csv_schema(t: Tables) -> DataFrame:
    path = scratch(t.spark, "csv")
    sinks.write_csv(t.part.select("p_partkey", "p_type"), path)
    back = readers.csv_with_schema(t.spark, [path], "p_partkey long, p_type string")
    return back.groupBy(F.col("p_type").alias("property")).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


@query("src_csv_union", "SELECT o_orderstatus, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS with_priority FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def src_csv_union(t: Tables) -> DataFrame:
    """Three CSV folders: one lacks an optional column, one the required one and is skipped."""
    paths = [scratch(t.spark, f"union-{i}") for i in range(3)]
    done = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    sinks.write_csv(done, paths[0])
    sinks.write_csv(t.orders.filter("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus"), paths[1])
    sinks.write_csv(t.orders.filter("o_orderstatus = 'P'").select("o_orderkey"), paths[2])
    both = readers.csv_union(t.spark, paths, ["o_orderkey", "o_orderstatus"])
    return both.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("o_orderpriority").alias("with_priority"))


@query("src_csv_null_vs_empty", """SELECT count(*) AS n, count(CASE WHEN p_size <= 10 THEN 1 END) AS nulls, count(CASE WHEN p_size > 10 AND p_size <= 20 THEN 1 END) AS empties,
  count(CASE WHEN p_size > 20 THEN 1 END) AS with_newline FROM part""")
def src_csv_null_vs_empty(t: Tables) -> DataFrame:
    path = scratch(t.spark, "nulls")
    note = F.when(F.col("p_size") <= 10, F.lit(None).cast("string")).when(F.col("p_size") <= 20, "").otherwise(F.concat("p_name", F.lit('\n"x"')))
    table = t.part.select("p_partkey", note.alias("note"))
    table.write.option("header", True).option("quoteAll", False).option("escape", '"').option("nullValue", "\\N").option("emptyValue", '""').csv(path)
    back = readers.csv_null_vs_empty(t.spark, path, "p_partkey long, note string")
    return back.agg(
        F.count("*").alias("n"), F.count_if(F.col("note").isNull()).alias("nulls"), F.count_if(F.col("note") == "").alias("empties"), F.count_if(F.col("note").contains('\n"x"')).alias("with_newline")
    )


@query("src_jdbc_tables", " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}" for n in ("orders", "lineitem", "customer", "supplier", "part", "nation", "region")))
def src_jdbc_tables(t: Tables) -> DataFrame:
    """Row counts of the extracted tables; Parquet stands in for the database."""
    return readers.extract_counts({n: getattr(t, n) for n in ("orders", "lineitem", "customer", "supplier", "part", "nation", "region")})


@query("src_load_projection", "SELECT CAST(ts AS DATE) AS event_date, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total FROM events GROUP BY 1")
def src_load_projection(t: Tables) -> DataFrame:
    landed = t.events.select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("string").alias("event_time"), F.col("value").cast("string").alias("value"))
    types = {"event_id": "bigint", "event_time": "timestamp_ntz", "value": "decimal(12,2)"}
    typed = readers.load_projection(landed, types, ("event_date", "event_time"))
    return plain(typed.groupBy("event_date").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query("src_kafka_batch", "SELECT CAST(user_id % 4 AS INTEGER) AS partition, count(*) + count(CASE WHEN event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN 1 END) AS messages FROM events GROUP BY 1")
def src_kafka_batch(t: Tables) -> DataFrame:
    """A bounded read of landed broker rows; the connector is not on this class path."""
    path = scratch(t.spark, "landed")
    messages(t).write.parquet(path)
    return readers.landed_batch(t.spark, path).groupBy("partition").agg(F.count("*").alias("messages"))


DAY_SQL = "SELECT CAST(ts AS DATE) AS event_date, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1"


@query("sink_parquet_compact", DAY_SQL)
def sink_parquet_compact(t: Tables) -> DataFrame:
    path = scratch(t.spark, "compact")
    sinks.write_compact(t.events.withColumn("event_date", F.to_date("ts")), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("event_date").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))


@query("sink_full_refresh", DAY_SQL)
def sink_full_refresh(t: Tables) -> DataFrame:
    """Written twice, read once: the second load replaces the first."""
    path = scratch(t.spark, "refresh")
    table = t.events.withColumn("event_date", F.to_date("ts"))
    for _ in range(2):
        sinks.full_refresh(table, path)
    back = t.spark.read.parquet(path)
    return back.groupBy("event_date").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))


@query("sink_upsert_daily", "SELECT CAST(ts AS DATE) AS date, count(*) * CASE WHEN CAST(ts AS DATE) >= DATE '2024-01-15' THEN 2 ELSE 1 END AS n FROM events GROUP BY CAST(ts AS DATE)")
def sink_upsert_daily(t: Tables) -> DataFrame:
    """Daily counts, then a second load that replaces the later half."""
    path = scratch(t.spark, "upsert")
    daily = t.events.groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    sinks.upsert_daily(daily, path)
    sinks.upsert_daily(daily.filter("date >= date'2024-01-15'").withColumn("n", F.col("n") * 2), path)
    return t.spark.read.parquet(path).select("date", "n")


@query("sink_csv_outputs", "SELECT o_orderpriority AS grade, count(*) AS n FROM orders GROUP BY 1")
def sink_csv_outputs(t: Tables) -> DataFrame:
    path = scratch(t.spark, "csv-out")
    sinks.write_csv(t.orders.groupBy(F.col("o_orderpriority").alias("grade")).agg(F.count("*").alias("n")), path)
    return readers.csv_with_schema(t.spark, [path], "grade string, n long")


# --- streams -------------------------------------------------------------------------------------


LAGGING = 3
LANDINGS = 3


def land(t: Tables, root: str) -> None:
    """Lands three partitions in offset order, a third at a time, and the fourth after all of them."""
    rows = messages(t)
    last = t.events.agg(F.max("event_id")).first()[0] or 0
    third = F.least(F.floor(F.col("offset") * LANDINGS / (last + 1)), F.lit(LANDINGS - 1))
    dealt = rows.withColumn("_landing", F.when(F.col("partition") == LAGGING, LANDINGS).otherwise(third))
    for landing in range(LANDINGS + 1):
        part = dealt.filter(F.col("_landing") == landing).drop("_landing")
        part.repartition(FILES_PER_LANDING).sortWithinPartitions("offset").write.mode("append").parquet(f"{root}/landed")


FILES_PER_LANDING = 2


def stream_run(t: Tables, by_partition: bool = False) -> tuple[jobs.Targets, dict]:
    """Lands the messages with one lagging partition, cleans them as a stream with the default watermark, recovers what it dropped."""
    root = scratch(t.spark, "stream")
    land(t, root)
    targets = jobs.Targets(root)
    stream = readers.landed_stream(t.spark, f"{root}/landed", files_per_trigger=FILES_PER_LANDING)
    suffix = "_" + root.rsplit("-", 1)[-1]
    items_path = f"{root}/items"
    dim_items(t).write.parquet(items_path)
    with progress.recorded(t.spark, f"{root}/progress", {f"{name}{suffix}" for name in jobs.SINKS}) as log:
        running = jobs.start_cleaning(stream, t.spark.read.parquet(items_path), targets, suffix=suffix, by_partition=by_partition)
        jobs.drain(running)
        log.settle(running.values())
    jobs.recover_dropped(readers.landed_batch(t.spark, f"{root}/landed"), targets, suffix)
    return targets, running | {"_suffix": suffix}


def streamed(t: Tables, targets: jobs.Targets, suffix: str) -> DataFrame:
    """The clean sink together with the late rows, enriched alike."""
    done = jobs.written(t.spark, targets, f"clean{suffix}")
    late = ev.enrich(jobs.late_rows(t.spark, targets, suffix), t.spark.read.parquet(f"{targets.root}/items"))
    return done.unionByName(late.withColumn("event_date", F.to_date("event_time")).select(*done.columns))


CLEAN_COUNT = f"WITH {CLEAN_SQL} SELECT event_type, count(*) AS events, count(CASE WHEN has_item_metadata THEN 1 END) AS with_metadata FROM clean GROUP BY 1"

#: Rows of the lagging partition at or behind the watermark that holds when it lands. Late rows are judged by the
#: watermark of the batch before: three days before the latest event of all landings but the last on-time one.
LATE_SQL = f"""{CLEAN_SQL}, seen AS (
  SELECT max(event_time_ms) AS latest FROM clean
  WHERE kafka_partition <> {LAGGING} AND kafka_offset * {LANDINGS} // (SELECT max(event_id) + 1 FROM events) < {LANDINGS - 1}),
tagged AS (
  SELECT c.*, kafka_partition = {LAGGING} AND event_time_ms <= (SELECT latest FROM seen) - 3 * 86400000 AS is_late FROM clean c)"""


@query("sink_stream_parquet", CLEAN_COUNT.replace(CLEAN_SQL, LATE_SQL).replace("FROM clean GROUP", "FROM tagged WHERE NOT is_late GROUP"))
def sink_stream_parquet(t: Tables) -> DataFrame:
    targets, run = stream_run(t)
    out = jobs.written(t.spark, targets, f"clean{run['_suffix']}")
    return out.groupBy("event_type").agg(F.count("*").alias("events"), F.count_if("has_item_metadata").alias("with_metadata"))


@query("sink_stream_quarantine", f"WITH {BASE_SQL} SELECT reason AS dq_reason, count(*) AS messages FROM msgs WHERE reason IS NOT NULL GROUP BY 1")
def sink_stream_quarantine(t: Tables) -> DataFrame:
    targets, run = stream_run(t)
    return jobs.written(t.spark, targets, f"quarantine{run['_suffix']}").groupBy("dq_reason").agg(F.count("*").alias("messages"))


@query("st_batch_parity", f"""WITH {CLEAN_SQL} SELECT count(*) AS batch_rows, count(*) AS stream_rows, 0 AS batch_duplicates, 0 AS stream_duplicates, 0 AS batch_only, 0 AS stream_only, 0 AS differing_cells, 'PASS' AS verdict FROM clean""")
def st_batch_parity(t: Tables) -> DataFrame:
    """Clean and late rows of the stream against the batch job on the same messages."""
    targets, run = stream_run(t)
    columns = ["event_time_ms", "visitor_id", "event_type", "item_id", "transaction_id", "category_id", "root_category_id", "has_item_metadata"]
    return parity.parity(clean(t), streamed(t, targets, run["_suffix"]), "event_id", columns)


@query("st_watermark_dedupe", f"WITH {LATE_SQL} SELECT count(*) AS rows, count(DISTINCT event_id) AS ids FROM tagged WHERE NOT is_late")
def st_watermark_dedupe(t: Tables) -> DataFrame:
    targets, run = stream_run(t)
    out = jobs.written(t.spark, targets, f"clean{run['_suffix']}")
    return out.agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("ids"))


@query("st_partition_dedupe", f"WITH {CLEAN_SQL} SELECT kafka_partition, count(*) AS rows, count(DISTINCT event_id) AS ids, 0 AS rows_recovered FROM clean GROUP BY 1")
def st_partition_dedupe(t: Tables) -> DataFrame:
    """A watermark per broker partition: the lagging one keeps all its rows in the stream itself."""
    targets, run = stream_run(t, by_partition=True)
    suffix = run["_suffix"]
    out = jobs.written(t.spark, targets, f"clean{suffix}").groupBy("kafka_partition")
    lost = jobs.late_rows(t.spark, targets, suffix).groupBy("kafka_partition").agg(F.count("*").cast("int").alias("lost"))
    kept = out.agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("ids")).join(lost, "kafka_partition", "left")
    return kept.select("kafka_partition", "rows", "ids", F.coalesce("lost", F.lit(0)).alias("rows_recovered"))


@query("st_static_enrich", f"""WITH {CLEAN_SQL} SELECT root_category_id, count(*) AS events FROM clean GROUP BY 1""")
def st_static_enrich(t: Tables) -> DataFrame:
    targets, run = stream_run(t)
    return streamed(t, targets, run["_suffix"]).groupBy("root_category_id").agg(F.count("*").alias("events"))


@query("st_two_sinks", f"""WITH {LATE_SQL} SELECT 'clean' AS sink, count(*) AS rows FROM tagged WHERE NOT is_late
UNION ALL SELECT 'quarantine', count(*) FROM msgs WHERE reason IS NOT NULL UNION ALL SELECT 'late', count(*) FROM tagged WHERE is_late""")
def st_two_sinks(t: Tables) -> DataFrame:
    targets, run = stream_run(t)
    suffix = run["_suffix"]
    sinks = {name: jobs.written(t.spark, targets, f"{name}{suffix}") for name in ("clean", "quarantine")}
    sinks["late"] = jobs.late_rows(t.spark, targets, suffix)
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("sink"), "rows") for name, df in sinks.items()]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@query("st_late_metrics", f"""WITH {LATE_SQL}, sums AS (SELECT (SELECT count(*) FROM msgs) AS rows_in, (SELECT count(*) FROM tagged WHERE NOT is_late) AS kept,
  (SELECT count(*) FROM msgs WHERE reason IS NOT NULL) AS bad, (SELECT count(*) FROM tagged WHERE is_late) AS lost)
SELECT 'clean' AS query, rows_in, kept AS rows_kept, lost AS rows_recovered FROM sums UNION ALL SELECT 'quarantine', rows_in, bad, 0 FROM sums
UNION ALL SELECT 'late', rows_in, 0, 0 FROM sums""")
def st_late_metrics(t: Tables) -> DataFrame:
    """Rows in and kept per query, and how many dropped behind the watermark had to be recovered."""
    targets, run = stream_run(t)
    suffix = run.pop("_suffix")
    totals = progress.summary(progress.figures(t.spark, f"{targets.root}/progress"))
    figures = totals.withColumn("query", F.regexp_replace("query", f"{suffix}$", ""))
    kept = [
        jobs.written(t.spark, targets, f"{name}{suffix}").agg(F.count("*").alias("rows_kept")).select(F.lit(name).alias("query"), "rows_kept") for name in run
    ]
    found = jobs.written(t.spark, targets, f"recovered{suffix}").agg(F.count("*").alias("n")).select(F.lit("clean").alias("query"), "n")
    joined = figures.join(kept[0].unionAll(kept[1]).unionAll(kept[2]), "query").join(found, "query", "left")
    return joined.select("query", "rows_in", "rows_kept", F.coalesce("n", F.lit(0)).alias("rows_recovered"))


@query("st_reset", f"WITH {LATE_SQL} SELECT count(*) AS events FROM tagged WHERE NOT is_late")
def st_reset(t: Tables) -> DataFrame:
    """Resets a finished clean query and drains it again from the start: nothing is doubled."""
    targets, run = stream_run(t)
    name = f"clean{run['_suffix']}"
    jobs.reset(t.spark, targets, [name])
    root = targets.root
    again = ev.clean_events(readers.landed_stream(t.spark, f"{root}/landed", FILES_PER_LANDING), t.spark.read.parquet(f"{root}/items")).clean
    jobs.drain({"clean": jobs.to_parquet(again, targets, name, "event_date")})
    return jobs.written(t.spark, targets, name).agg(F.count("*").alias("events"))


def landed_stream(t: Tables, name: str):
    """Lands the messages and copies them through a bounded stream; returns the run and its output."""
    root = scratch(t.spark, name)
    messages(t).repartitionByRange(4, "offset").write.parquet(f"{root}/landed")
    targets = jobs.Targets(root)
    with progress.recorded(t.spark, f"{root}/progress", {root.rsplit("/", 1)[-1]}) as log:
        run = {"copy": jobs.to_parquet(readers.landed_stream(t.spark, f"{root}/landed", 2), targets, root.rsplit("/", 1)[-1])}
        jobs.drain(run)
        log.settle(run.values())
    return targets, run, t.spark.read.schema(readers.BROKER_SCHEMA).parquet(targets.data(root.rsplit("/", 1)[-1]))


@query("src_kafka_stream", f"WITH {BASE_SQL} SELECT CAST(user_id % 4 AS INTEGER) AS partition, count(*) AS messages, max(off) AS last_offset FROM msgs GROUP BY 1")
def src_kafka_stream(t: Tables) -> DataFrame:
    """An unbounded read with bounded micro-batches; landed files stand in for the broker."""
    _, _, out = landed_stream(t, "stream-read")
    return out.groupBy("partition").agg(F.count("*").alias("messages"), F.max("offset").alias("last_offset"))


@query("st_drain_idle", f"WITH {BASE_SQL} SELECT false AS active, count(*) AS rows_in FROM msgs")
def st_drain_idle(t: Tables) -> DataFrame:
    """A drained query has read everything there was and has stopped by itself."""
    targets, run, _ = landed_stream(t, "stream-drain")
    figures = progress.figures(t.spark, f"{targets.root}/progress")
    return figures.agg(F.sum("rows_in").alias("rows_in")).select(F.lit(run["copy"].isActive).alias("active"), "rows_in")
