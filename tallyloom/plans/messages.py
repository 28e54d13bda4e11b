"""Broker messages, an attribute change-log and a category tree derived from the tables.

Every event becomes a message. Events of type ``error`` carry one planted defect,
chosen by their ``k``; part of the purchases are delivered twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.items import item_dimension
from tallyloom.sources.tables import Tables, epoch_millis

FAULTS = [
    (8, "truncated"),
    (16, "null_item"),
    (24, "iso_time"),
    (32, "no_type"),
    (40, "epoch_zero"),
    (48, "blank"),
    (56, "huge_time"),
    (64, "visitor_text"),
    (72, "no_event_id"),
    (80, "no_visitor"),
    (88, "no_time"),
    (96, "item_text"),
    (98, "hollow"),
    (1000, "null_value"),
]
REDELIVERY_GAP = 1_000_000_000


def event_fields(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    fault = F.coalesce(*[F.when(k < upto, F.lit(name)) for upto, name in FAULTS])
    renamed = F.when(F.col("event_type") == "click", "addtocart").when(F.col("event_type") == "purchase", "transaction")
    return t.events.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        k.alias("k"),
        epoch_millis("ts").alias("ms"),
        renamed.when(F.col("event_type") == "error", "view").otherwise(F.col("event_type")).alias("etype"),
        F.when(F.col("event_type") == "error", fault).alias("fault"),
    )


def messages(t: Tables) -> DataFrame:
    """Seven-column broker rows for all events."""
    fault = F.col("fault")

    def unless(*names: str):
        return ~F.coalesce(fault.isin(*names), F.lit(False))

    time_text = (
        F.when(fault == "iso_time", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(fault == "epoch_zero", F.lit("0"))
        .when(fault == "huge_time", F.lit("99999999999999999999"))
        .when(unless("no_time"), F.col("ms").cast("string"))
    )
    visitor = F.when(fault == "visitor_text", F.concat(F.lit("u"), "user_id")).when(
        unless("no_visitor"), F.col("user_id").cast("string")
    )
    item = F.when(fault == "item_text", F.lit("none")).when(unless("null_item"), F.col("k").cast("string"))
    body = F.to_json(
        F.struct(
            F.when(unless("no_event_id"), F.concat(F.lit("e"), "event_id")).alias("event_id"),
            time_text.alias("event_time"),
            visitor.alias("visitor_id"),
            F.when(unless("no_type"), F.col("etype")).alias("event_type"),
            item.alias("item_id"),
            F.when(F.col("etype") == "transaction", F.col("event_id").cast("string")).alias("transaction_id"),
            (F.col("ms") + 1000).cast("string").alias("ingested_at"),
            F.lit("p1").alias("producer_id"),
            fault.alias("_fault"),
        )
    )
    value = (
        F.when(fault == "truncated", F.substring(body, 1, 40))
        .when(fault == "blank", F.lit("   "))
        .when(fault == "hollow", F.lit("{}"))
        .when(fault == "null_value", F.lit(None).cast("string"))
        .otherwise(body)
    )
    copies = F.when(
        (F.col("event_type") == "purchase") & (F.col("k") < 50), F.array(F.lit(0), F.lit(REDELIVERY_GAP))
    ).otherwise(F.array(F.lit(0)))
    return (
        event_fields(t)
        .withColumn("_gap", F.explode(copies))
        .select(
            F.col("user_id").cast("string").cast("binary").alias("key"),
            value.cast("binary").alias("value"),
            F.lit("events").alias("topic"),
            F.pmod("user_id", F.lit(4)).cast("int").alias("partition"),
            (F.col("event_id") + F.col("_gap")).alias("offset"),
            F.timestamp_millis(F.col("ms") + 60_000).alias("timestamp"),
        )
    )


def item_changes(t: Tables) -> DataFrame:
    """Attribute change-log ``(timestamp, itemid, property, value)``; the item is the part's size."""
    brand = F.regexp_replace("p_brand", "Brand#", "")
    rows = F.array(
        F.struct(
            F.lit("categoryid").alias("property"),
            F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("n"), brand)).otherwise(brand).alias("value"),
        ),
        F.struct(
            F.lit("available").alias("property"),
            F.when(F.col("p_type") == "PROMO", "0").otherwise("1").alias("value"),
        ),
        F.struct(F.lit("name").alias("property"), F.col("p_name").alias("value")),
    )
    return t.part.select(
        (F.col("p_partkey") * 1000).alias("timestamp"), F.col("p_size").alias("itemid"), F.explode(rows).alias("r")
    ).select("timestamp", "itemid", "r.property", "r.value")


def category_edges(t: Tables) -> DataFrame:
    """Three-level category tree over the brands below 20; the others are orphans."""
    brand = F.regexp_replace("p_brand", "Brand#", "").cast("int")
    leaf = t.part.select(brand.alias("category_id")).distinct().filter("category_id < 20")
    leaf = leaf.select("category_id", (F.lit(100) + F.floor(F.col("category_id") / 5)).cast("int").alias("parent_category_id"))
    middle = leaf.select(F.col("parent_category_id").alias("category_id")).distinct()
    middle = middle.select("category_id", (F.lit(200) + F.floor((F.col("category_id") - 100) / 2)).cast("int").alias("parent_category_id"))
    top = middle.select(F.col("parent_category_id").alias("category_id")).distinct()
    top = top.select("category_id", F.lit(None).cast("int").alias("parent_category_id"))
    return leaf.unionByName(middle).unionByName(top)


def dim_items(t: Tables) -> DataFrame:
    return item_dimension(item_changes(t), category_edges(t))


FAULT_CASE = "CASE " + " ".join(f"WHEN k < {upto} THEN '{name}'" for upto, name in FAULTS) + " END"

BASE_SQL = f"""base AS (
  SELECT *, CASE WHEN event_type = 'error' THEN {FAULT_CASE} END AS fault FROM (
    SELECT event_id, ts, user_id, event_type, value,
      CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) // 1000 AS ms,
      CASE event_type WHEN 'click' THEN 'addtocart' WHEN 'purchase' THEN 'transaction'
        WHEN 'error' THEN 'view' ELSE event_type END AS etype
    FROM events) b0),
reasoned AS (
  SELECT *, CASE WHEN fault IS NULL THEN CASE WHEN etype = 'signup' THEN 'unknown_event_type' END
    ELSE CASE fault WHEN 'truncated' THEN 'unparseable_json' WHEN 'null_item' THEN 'missing_item_id'
      WHEN 'iso_time' THEN 'event_time_not_numeric' WHEN 'no_type' THEN 'missing_event_type'
      WHEN 'epoch_zero' THEN 'event_time_implausible' WHEN 'blank' THEN 'empty_payload'
      WHEN 'huge_time' THEN 'event_time_implausible' WHEN 'visitor_text' THEN 'visitor_id_not_numeric'
      WHEN 'no_event_id' THEN 'missing_event_id' WHEN 'no_visitor' THEN 'missing_visitor_id'
      WHEN 'no_time' THEN 'missing_event_time' WHEN 'item_text' THEN 'item_id_not_numeric'
      WHEN 'hollow' THEN 'missing_event_id' ELSE 'empty_payload' END END AS reason
  FROM base),
msgs AS (
  SELECT *, event_id AS off FROM reasoned
  UNION ALL SELECT *, event_id + {REDELIVERY_GAP} AS off FROM reasoned WHERE event_type = 'purchase' AND k < 50)"""

ITEMS_SQL = """changes AS (
  SELECT p_partkey * 1000 AS ts, p_size AS itemid, 'categoryid' AS property,
    CASE WHEN p_type = 'ECONOMY' THEN 'n' ELSE '' END || replace(p_brand, 'Brand#', '') AS value FROM part
  UNION ALL SELECT p_partkey * 1000, p_size, 'available', CASE WHEN p_type = 'PROMO' THEN '0' ELSE '1' END FROM part
  UNION ALL SELECT p_partkey * 1000, p_size, 'name', p_name FROM part),
latest AS (
  SELECT itemid, property, value, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY itemid, property ORDER BY ts DESC, value DESC) AS rn
    FROM changes WHERE property IN ('categoryid', 'available')) l WHERE rn = 1),
wide AS (
  SELECT itemid AS item_id, TRY_CAST(max(CASE WHEN property = 'categoryid' THEN value END) AS INTEGER) AS category_id,
    TRY_CAST(max(CASE WHEN property = 'available' THEN value END) AS INTEGER) = 1 AS is_available,
    max(CASE WHEN property = 'categoryid' THEN ts END) AS category_valid_from
  FROM latest GROUP BY itemid),
leafs AS (
  SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS c FROM part
  WHERE CAST(replace(p_brand, 'Brand#', '') AS INTEGER) < 20),
tree AS (
  SELECT c AS category_id, 100 + c // 5 AS parent_category_id, 200 + (c // 5) // 2 AS root_category_id FROM leafs
  UNION ALL SELECT DISTINCT 100 + c // 5, 200 + (c // 5) // 2, 200 + (c // 5) // 2 FROM leafs
  UNION ALL SELECT DISTINCT 200 + (c // 5) // 2, NULL, 200 + (c // 5) // 2 FROM leafs),
dim AS (
  SELECT w.item_id, w.category_id, t.parent_category_id, t.root_category_id, w.is_available, w.category_valid_from
  FROM wide w LEFT JOIN tree t ON t.category_id = w.category_id
  UNION ALL SELECT -1, -1, -1, -1, NULL, NULL)"""

CLEAN_SQL = f"""{BASE_SQL},
{ITEMS_SQL},
clean AS (
  SELECT 'e' || r.event_id AS event_id, r.ms AS event_time_ms, CAST(r.ts AS DATE) AS event_date, r.user_id AS visitor_id,
    r.etype AS event_type, r.k AS item_id, CASE WHEN r.etype = 'transaction' THEN r.event_id END AS transaction_id,
    coalesce(d.category_id, -1) AS category_id, coalesce(d.parent_category_id, -1) AS parent_category_id,
    coalesce(d.root_category_id, -1) AS root_category_id, d.is_available, d.item_id IS NOT NULL AS has_item_metadata,
    CAST(r.user_id % 4 AS INTEGER) AS kafka_partition, r.event_id AS kafka_offset
  FROM reasoned r LEFT JOIN dim d ON d.item_id = r.k WHERE r.reason IS NULL)"""
