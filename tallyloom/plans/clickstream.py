"""Event cleaning, item dimension and funnel queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import events as ev
from tallyloom.operators import funnel, items
from tallyloom.plans.messages import (
    BASE_SQL,
    CLEAN_SQL,
    ITEMS_SQL,
    category_edges,
    dim_items,
    item_changes,
    messages,
)
from tallyloom.plans.registry import query
from tallyloom.sources.tables import Tables

RAW_STEPS = ["view", "click", "purchase"]
STEPS = list(ev.EVENT_TYPES)


def classified(t: Tables) -> DataFrame:
    return ev.classify(ev.parse(messages(t)))


def clean(t: Tables) -> DataFrame:
    return ev.clean_events(messages(t), dim_items(t)).clean


@query("ev_parse", f"""WITH {BASE_SQL}
SELECT CAST(user_id % 4 AS INTEGER) AS kafka_partition, count(*) AS messages,
  count(CASE WHEN fault IN ('null_value') THEN 1 END) AS null_values,
  count(CASE WHEN coalesce(fault, '') NOT IN ('truncated', 'blank', 'no_event_id', 'hollow', 'null_value') THEN 1 END) AS with_event_id,
  count(DISTINCT user_id) AS keys
FROM msgs GROUP BY 1""")
def ev_parse(t: Tables) -> DataFrame:
    return ev.parse(messages(t)).groupBy("kafka_partition").agg(
        F.count("*").alias("messages"),
        F.count_if(F.col("raw_value").isNull()).alias("null_values"),
        F.count("e.event_id").alias("with_event_id"),
        F.countDistinct("kafka_key").alias("keys"),
    )


@query("ev_classify", f"""WITH {BASE_SQL}
SELECT coalesce(reason, 'valid') AS dq_reason, reason IS NULL AS is_valid, count(*) AS messages FROM msgs GROUP BY 1, 2""")
def ev_classify(t: Tables) -> DataFrame:
    return (
        classified(t)
        .groupBy(F.coalesce("dq_reason", F.lit("valid")).alias("dq_reason"), "is_valid")
        .agg(F.count("*").alias("messages"))
    )


@query("ev_split", f"""WITH {BASE_SQL}
SELECT 'valid' AS side, count(*) AS messages, min(off) AS first_offset FROM msgs WHERE reason IS NULL
UNION ALL SELECT 'rejected', count(*), min(off) FROM msgs WHERE reason IS NOT NULL""")
def ev_split(t: Tables) -> DataFrame:
    valid, rejected = ev.split(classified(t))
    sides = [
        part.agg(F.count("*").alias("messages"), F.min("kafka_offset").alias("first_offset")).select(
            F.lit(name).alias("side"), "messages", "first_offset"
        )
        for name, part in (("valid", valid), ("rejected", rejected))
    ]
    return sides[0].unionByName(sides[1])


@query("ev_quarantine", f"""WITH {BASE_SQL}
SELECT reason AS dq_reason, CAST(user_id % 4 AS INTEGER) AS kafka_partition, off AS kafka_offset, 'events' AS kafka_topic,
  CASE WHEN fault IN ('blank', 'hollow', 'null_value', 'truncated') THEN NULL ELSE fault END AS injected_fault,
  TIMESTAMP '2024-02-01 00:00:00' AS quarantined_at
FROM msgs WHERE reason IS NOT NULL""")
def ev_quarantine(t: Tables) -> DataFrame:
    stamp = F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))
    dead = ev.quarantine(ev.split(classified(t))[1], at=stamp)
    return dead.select("dq_reason", "kafka_partition", "kafka_offset", "kafka_topic", "injected_fault", "quarantined_at")


@query("ev_cast", f"""WITH {BASE_SQL}
SELECT 'e' || event_id AS event_id, ms AS event_time_ms, user_id AS visitor_id, etype AS event_type, k AS item_id,
  CASE WHEN etype = 'transaction' THEN event_id END AS transaction_id, ms + 1000 AS ingested_ms, off AS kafka_offset
FROM msgs WHERE reason IS NULL""")
def ev_cast(t: Tables) -> DataFrame:
    return ev.cast_valid(ev.split(classified(t))[0]).select(
        "event_id", "event_time_ms", "visitor_id", "event_type", "item_id", "transaction_id",
        F.unix_millis("ingested_at").alias("ingested_ms"), "kafka_offset",
    )


@query("dedupe_global", f"""WITH {BASE_SQL}
SELECT 'e' || event_id AS event_id, min(off) AS kafka_offset, CAST(min(user_id) % 4 AS INTEGER) AS kafka_partition
FROM msgs WHERE reason IS NULL GROUP BY event_id""")
def dedupe_global(t: Tables) -> DataFrame:
    typed = ev.cast_valid(ev.split(classified(t))[0])
    return ev.dedupe(typed, ["event_id"], ["kafka_partition", "kafka_offset"]).select(
        "event_id", "kafka_offset", "kafka_partition"
    )


@query("join_enrich_broadcast", f"""WITH {CLEAN_SQL} SELECT * FROM clean""")
def join_enrich_broadcast(t: Tables) -> DataFrame:
    return clean(t).select(
        "event_id", "event_time_ms", F.to_date(F.timestamp_millis("event_time_ms")).alias("event_date"), "visitor_id",
        "event_type", "item_id", "transaction_id", "category_id", "parent_category_id", "root_category_id",
        "is_available", "has_item_metadata", "kafka_partition", "kafka_offset",
    )


@query("flt_property_in", f"""WITH {ITEMS_SQL}
SELECT property, count(*) AS rows, count(DISTINCT itemid) AS items FROM changes
WHERE property IN ('categoryid', 'available') AND itemid IS NOT NULL GROUP BY 1""")
def flt_property_in(t: Tables) -> DataFrame:
    return (
        items.wanted_properties(item_changes(t))
        .groupBy("property")
        .agg(F.count("*").alias("rows"), F.countDistinct("itemid").alias("items"))
    )


@query("win_latest_attr", f"WITH {ITEMS_SQL} SELECT itemid, property, value, ts AS timestamp FROM latest")
def win_latest_attr(t: Tables) -> DataFrame:
    return items.latest_values(items.wanted_properties(item_changes(t))).select("itemid", "property", "value", "timestamp")


@query("agg_pivot_latest", f"WITH {ITEMS_SQL} SELECT item_id, category_id, is_available FROM wide")
def agg_pivot_latest(t: Tables) -> DataFrame:
    return items.pivot_latest(items.latest_values(items.wanted_properties(item_changes(t))))


@query("join_self_attr", f"WITH {ITEMS_SQL} SELECT item_id, category_id, is_available, category_valid_from FROM wide")
def join_self_attr(t: Tables) -> DataFrame:
    current = items.latest_values(items.wanted_properties(item_changes(t)))
    return items.with_category_since(items.pivot_latest(current), current)


@query("tree_roots", f"WITH {ITEMS_SQL} SELECT * FROM tree")
def tree_roots(t: Tables) -> DataFrame:
    return items.resolve_roots(category_edges(t))


@query("join_tree_broadcast", f"WITH {ITEMS_SQL} SELECT * FROM dim WHERE item_id <> -1")
def join_tree_broadcast(t: Tables) -> DataFrame:
    current = items.latest_values(items.wanted_properties(item_changes(t)))
    wide = items.with_category_since(items.pivot_latest(current), current)
    return items.join_tree(wide, items.resolve_roots(category_edges(t)))


@query("set_union_unknown", f"WITH {ITEMS_SQL} SELECT * FROM dim")
def set_union_unknown(t: Tables) -> DataFrame:
    return dim_items(t)


@query("item_hierarchy_flags", f"""WITH {ITEMS_SQL}
SELECT item_id, category_id, root_category_id IS NOT NULL AS has_category_hierarchy, item_id = -1 AS is_unknown_item FROM dim""")
def item_hierarchy_flags(t: Tables) -> DataFrame:
    return items.hierarchy_flags(dim_items(t)).select(
        "item_id", "category_id", "has_category_hierarchy", "is_unknown_item"
    )


@query("funnel_step", f"""WITH {CLEAN_SQL}
SELECT event_type, CASE event_type WHEN 'view' THEN 1 WHEN 'addtocart' THEN 2 WHEN 'transaction' THEN 3 END AS funnel_step,
  count(*) AS events FROM clean GROUP BY 1, 2""")
def funnel_step(t: Tables) -> DataFrame:
    return ev.fct_events(clean(t)).groupBy("event_type", "funnel_step").agg(F.count("*").alias("events"))


@query("item_key_unknown", f"""WITH {CLEAN_SQL}
SELECT CASE WHEN has_item_metadata THEN item_id ELSE -1 END AS item_key, count(*) AS events FROM clean GROUP BY 1""")
def item_key_unknown(t: Tables) -> DataFrame:
    return ev.fct_events(clean(t)).groupBy("item_key").agg(F.count("*").alias("events"))


@query("agg_funnel_event", """SELECT a AS view, b AS click, c AS purchase, round(b * 100.0 / a, 4) AS view_to_click_pct,
  round(c * 100.0 / b, 4) AS click_to_purchase_pct
FROM (SELECT count(CASE WHEN event_type = 'view' THEN 1 END) AS a, count(CASE WHEN event_type = 'click' THEN 1 END) AS b,
  count(CASE WHEN event_type = 'purchase' THEN 1 END) AS c FROM events) x""")
def agg_funnel_event(t: Tables) -> DataFrame:
    return funnel.event_funnel(t.events, RAW_STEPS)


VISITOR_FLAGS = """SELECT user_id, count(*) AS n, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS a,
  max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS b, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS c
FROM events GROUP BY user_id"""


@query("agg_funnel_visitor", f"""SELECT count(*) AS visitors, CAST(sum(a) AS BIGINT) AS view, CAST(sum(b) AS BIGINT) AS click,
  CAST(sum(c) AS BIGINT) AS purchase, round(sum(b) * 100.0 / sum(a), 4) AS view_to_click_pct,
  round(sum(c) * 100.0 / sum(b), 4) AS click_to_purchase_pct FROM ({VISITOR_FLAGS}) f""")
def agg_funnel_visitor(t: Tables) -> DataFrame:
    return funnel.visitor_funnel(t.events, "user_id", RAW_STEPS)


@query("agg_funnel_kpi", """SELECT count(*) AS total_events, count(DISTINCT user_id) AS visitors,
  count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS view_visitors,
  count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS click_visitors,
  count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS purchase_visitors FROM events""")
def agg_funnel_kpi(t: Tables) -> DataFrame:
    return funnel.funnel_kpis(t.events, "user_id", RAW_STEPS)


@query("agg_funnel_category", f"""WITH {CLEAN_SQL}
SELECT root_category_id, a AS view, b AS addtocart, c AS transaction, round(b * 100.0 / a, 4) AS addtocart_pct,
  round(c * 100.0 / a, 4) AS transaction_pct
FROM (SELECT root_category_id, count(CASE WHEN event_type = 'view' THEN 1 END) AS a,
  count(CASE WHEN event_type = 'addtocart' THEN 1 END) AS b, count(CASE WHEN event_type = 'transaction' THEN 1 END) AS c
  FROM clean WHERE root_category_id <> -1 GROUP BY 1) x WHERE a >= 20""")
def agg_funnel_category(t: Tables) -> DataFrame:
    return funnel.category_funnel(clean(t), "root_category_id", STEPS, min_first=20)


@query("funnel_by_k_bucket", """SELECT k_bucket, a AS view, b AS click, c AS purchase, round(b * 100.0 / a, 4) AS click_pct,
  round(c * 100.0 / a, 4) AS purchase_pct
FROM (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS k_bucket,
  count(CASE WHEN event_type = 'view' THEN 1 END) AS a, count(CASE WHEN event_type = 'click' THEN 1 END) AS b,
  count(CASE WHEN event_type = 'purchase' THEN 1 END) AS c FROM events GROUP BY 1) x""")
def funnel_by_k_bucket(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return funnel.category_funnel(t.events.withColumn("k_bucket", F.floor(k / 10)), "k_bucket", RAW_STEPS, exclude=None)


@query("agg_unknown_rate", f"""WITH {CLEAN_SQL}
SELECT event_type, count(*) AS events, count(CASE WHEN has_item_metadata THEN 1 END) AS with_metadata,
  round(100.0 * (count(*) - count(CASE WHEN has_item_metadata THEN 1 END)) / count(*), 2) AS pct_unknown
FROM clean GROUP BY 1""")
def agg_unknown_rate(t: Tables) -> DataFrame:
    return funnel.unknown_rate(clean(t), ["event_type"])


@query("agg_quarantine_matrix", f"""WITH {BASE_SQL}
SELECT reason AS dq_reason, CASE WHEN fault IN ('blank', 'hollow', 'null_value', 'truncated') THEN NULL ELSE fault END AS injected_fault,
  count(*) AS rows FROM msgs WHERE reason IS NOT NULL GROUP BY 1, 2""")
def agg_quarantine_matrix(t: Tables) -> DataFrame:
    return funnel.fault_matrix(ev.quarantine(ev.split(classified(t))[1]))


DAILY_SQL = "SELECT CAST(ts AS DATE) AS event_date, count(*) AS events FROM events GROUP BY 1"


@query("events_daily_volume", DAILY_SQL)
def events_daily_volume(t: Tables) -> DataFrame:
    return funnel.daily_volume(t.events, F.to_date("ts"))


@query("agg_daily_volume", f"""SELECT count(*) AS days, min(event_date) AS first_day, max(event_date) AS last_day,
  arg_min(events, event_date) AS first_day_events, arg_max(events, event_date) AS last_day_events,
  CAST(median(events) AS DOUBLE) AS median_day_events FROM ({DAILY_SQL}) d""")
def agg_daily_volume(t: Tables) -> DataFrame:
    return funnel.daily_volume_summary(funnel.daily_volume(t.events, F.to_date("ts")))


@query("agg_orphans", f"""WITH {ITEMS_SQL}
SELECT count(*) AS dim_rows, count(CASE WHEN category_id IS NOT NULL AND root_category_id IS NULL THEN 1 END) AS orphan_items,
  count(DISTINCT CASE WHEN root_category_id IS NULL THEN category_id END) AS orphan_categories FROM dim""")
def agg_orphans(t: Tables) -> DataFrame:
    return items.orphan_summary(dim_items(t))


@query("win_out_of_order", f"""WITH {BASE_SQL},
seen AS (SELECT CAST(user_id % 4 AS INTEGER) AS kafka_partition, ms,
  max(ms) OVER (PARTITION BY user_id % 4 ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM msgs WHERE reason IS NULL)
SELECT kafka_partition, count(*) AS messages, count(CASE WHEN top > ms THEN 1 END) AS out_of_order,
  coalesce(max(CASE WHEN top > ms THEN top - ms END), 0) AS max_lateness_ms FROM seen GROUP BY 1""")
def win_out_of_order(t: Tables) -> DataFrame:
    typed = ev.cast_valid(ev.split(classified(t))[0])
    return funnel.out_of_order(
        typed, partition="kafka_partition", offset="kafka_offset", event_time="event_time_ms", block=1_000
    )


@query("st_stream_quality", f"""WITH {BASE_SQL}
SELECT count(*) AS total, count(CASE WHEN reason IS NULL THEN 1 END) AS valid,
  count(CASE WHEN reason IN ('unparseable_json', 'empty_payload') THEN 1 END) AS unparseable,
  count(CASE WHEN reason NOT IN ('unparseable_json', 'empty_payload') THEN 1 END) AS invalid,
  count(CASE WHEN reason NOT IN ('unparseable_json', 'empty_payload') AND (fault IS NULL OR fault = 'hollow') THEN 1 END)
    AS detected_but_unmarked,
  count(CASE WHEN reason IS NULL THEN 1 END) - count(DISTINCT CASE WHEN reason IS NULL THEN event_id END) AS duplicates
FROM msgs""")
def st_stream_quality(t: Tables) -> DataFrame:
    return funnel.stream_quality(classified(t))
