"""Shop-shaped source tables derived from the driver tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import marts
from tallyloom.sources.tables import Tables


def plain(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Decimals as doubles at the edge; optionally doubles rounded."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(name)
        if kind.startswith("decimal"):
            col = col.cast("double")
        if digits is not None and (kind == "double" or kind == "float"):
            col = F.round(col, digits)
        out.append(col.alias(name))
    return df.select(*out)


def raw_orders(t: Tables) -> DataFrame:
    status = (
        F.when(F.col("o_orderstatus") == "F", " Delivered ")
        .when(F.col("o_orderstatus") == "P", "SHIPPED")
        .when(F.col("o_orderpriority") == "5-LOW", "canceled")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "unavailable")
        .otherwise("processing")
    )
    delivered = F.col("o_orderdate") + F.make_dt_interval(F.lit(40) + F.col("o_custkey") % 41, F.col("o_orderkey") % 24)
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        status.alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        F.lit(None).cast("timestamp_ntz").alias("order_approved_at"),
        F.lit(None).cast("timestamp_ntz").alias("order_delivered_carrier_date"),
        F.when(F.col("o_orderstatus").isin("F", "P"), delivered).alias("order_delivered_customer_date"),
        (F.col("o_orderdate") + F.expr("interval 60 days")).alias("order_estimated_delivery_date"),
    )


def raw_items(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("freight_value"),
    )


def raw_reviews(t: Tables) -> DataFrame:
    score = F.least(F.lit(5), F.lit(1) + F.floor(F.col("l_discount") * 50))
    return t.lineitem.filter("l_returnflag <> 'N'").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("review_id"),
        F.col("l_orderkey").alias("order_id"),
        score.alias("review_score"),
        F.concat(F.lit(" "), "l_returnflag", F.lit(" ")).alias("review_comment_title"),
        F.when(F.col("l_returnflag") == "A", F.lit("  ")).otherwise(F.col("l_linestatus")).alias("review_comment_message"),
        F.col("l_shipdate").alias("review_creation_date"),
        F.col("l_shipdate").alias("review_answer_timestamp"),
    )


def raw_payments(t: Tables) -> DataFrame:
    kind = (
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "Credit_Card ")
        .when(F.col("o_orderpriority") == "5-LOW", "boleto")
        .otherwise("debit_card")
    )
    first = F.struct(
        F.lit(1).alias("payment_sequential"),
        kind.alias("payment_type"),
        F.when(F.col("o_custkey") % 12 != 7, F.col("o_custkey") % 12).alias("payment_installments"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("payment_value"),
    )
    second = F.struct(
        F.lit(2).alias("payment_sequential"),
        F.lit("voucher").alias("payment_type"),
        F.lit(0).cast("bigint").alias("payment_installments"),
        F.lit(10).cast("decimal(12,2)").alias("payment_value"),
    )
    parts = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(first, second)).otherwise(F.array(first))
    return t.orders.select(F.col("o_orderkey").alias("order_id"), F.inline(parts))


def raw_customers(t: Tables) -> DataFrame:
    nation = t.nation.select("n_nationkey", "n_name")
    return t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"),
        F.floor(F.col("c_custkey") / 2).alias("customer_unique_id"),
        (F.col("c_nationkey") * 37).alias("customer_zip_code_prefix"),
        F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" city ")).alias("customer_city"),
        F.lower("n_name").alias("customer_state"),
    )


def raw_products(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_size") == 50, F.lit(" ")).otherwise(F.col("p_type")).alias("product_category_name"),
        F.length("p_name").cast("string").alias("product_name_lenght"),
        F.lit("n/a").alias("product_description_lenght"),
        F.col("p_size").cast("string").alias("product_photos_qty"),
        F.col("p_retailprice").cast("string").alias("product_weight_g"),
        F.col("p_size").cast("string").alias("product_length_cm"),
        F.lit("2").alias("product_height_cm"),
        F.when(F.col("p_size") % 5 != 0, F.lit("3.5")).otherwise(F.lit("?")).alias("product_width_cm"),
    )


def raw_translation(t: Tables) -> DataFrame:
    """Names for all part types but two."""
    return (
        t.part.filter(~F.col("p_type").isin("PROMO", "ECONOMY"))
        .select(F.col("p_type").alias("product_category_name"), F.concat(F.initcap("p_type"), F.lit(" goods ")).alias("product_category_name_english"))
        .distinct()
    )


def raw_geolocation(t: Tables) -> DataFrame:
    nation = t.nation.select("n_nationkey", "n_name")
    return t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_nationkey").alias("geolocation_zip_code_prefix"),
        (F.col("c_acctbal") / 500 - 10).alias("geolocation_lat"),
        (F.lit(0) - F.col("c_acctbal") / 200).alias("geolocation_lng"),
        F.col("n_name").alias("geolocation_state"),
        F.col("c_mktsegment").alias("geolocation_city"),
    )


def raw_weather(t: Tables) -> DataFrame:
    """One weather row per state and order day, values a fixed function of both."""
    seed = F.col("c_nationkey") * 7 + F.dayofyear("d") * 3
    days = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "c_nationkey", F.to_date("o_orderdate").alias("d")
    )
    nation = t.nation.select("n_nationkey", "n_name")
    return days.distinct().join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.lower("n_name").alias("state"),
        F.col("d").alias("weather_date"),
        F.lit(1).alias("latitude"),
        F.lit(2).alias("longitude"),
        (seed % 35).alias("temperature_2m_mean"),
        (seed % 35 + 5).alias("temperature_2m_max"),
        (seed % 35 - 5).alias("temperature_2m_min"),
        (seed % 29).alias("precipitation_sum"),
        (seed % 29).alias("rain_sum"),
        (seed % 60).alias("wind_speed_10m_max"),
        (seed % 101).alias("weather_code"),
    )


class Shop:
    """Staged tables and facts over one set of driver tables, built on demand."""

    def __init__(self, t: Tables):
        self.t = t
        self.orders = marts.stg_orders(raw_orders(t))
        self.lines = marts.stg_order_items(raw_items(t))
        self.customers = marts.stg_customers(raw_customers(t))
        self.payments = marts.stg_order_payments(raw_payments(t))
        self.reviews = marts.stg_order_reviews(raw_reviews(t))
        self.products = marts.stg_products(raw_products(t))

    def fct_orders(self) -> DataFrame:
        return marts.fct_orders(self.lines, self.orders, self.customers, self.reviews)

    def lines_only(self) -> DataFrame:
        """Lines with order attributes but without reviews, for measures that do not read them."""
        heads = self.orders.join(self.customers.select("customer_id", "customer_unique_id", "customer_state"), "customer_id")
        return marts.order_line_measures(marts.delivery_metrics(self.lines.join(heads, "order_id")))

    def sales(self) -> DataFrame:
        """Lines with their order only: no customer join."""
        return marts.order_line_measures(self.lines.join(self.orders, "order_id"))

    def fct_order_payments(self) -> DataFrame:
        return marts.fct_order_payments(self.payments, self.orders)

    def dim_customers(self) -> DataFrame:
        return marts.dim_customers(self.customers, self.orders)

    def dim_products(self) -> DataFrame:
        return marts.dim_products(self.products, marts.stg_translation(raw_translation(self.t)))

    def dim_weather(self) -> DataFrame:
        return marts.dim_weather(marts.stg_weather(raw_weather(self.t)))


SHOP_SQL = """o AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
    CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'P' THEN 'shipped' WHEN o_orderpriority = '5-LOW' THEN 'canceled'
      WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unavailable' ELSE 'processing' END AS order_status,
    o_orderdate AS ordered_at, CAST(o_orderdate AS DATE) AS order_date,
    CASE WHEN o_orderstatus IN ('F', 'P') THEN o_orderdate + to_days(CAST(40 + o_custkey % 41 AS INTEGER)) + to_hours(o_orderkey % 24) END
      AS delivered_at, o_orderdate + INTERVAL 60 DAY AS estimated_at
  FROM orders),
li AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS item_price, CAST(l_quantity AS DECIMAL(12,2)) AS freight_value,
    CAST(l_extendedprice AS DECIMAL(12,2)) + CAST(l_quantity AS DECIMAL(12,2)) AS item_revenue FROM lineitem),
cu AS (
  SELECT c_custkey AS customer_id, c_custkey // 2 AS customer_unique_id, lpad(CAST(c_nationkey * 37 AS VARCHAR), 5, '0') AS zip,
    CASE WHEN true THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' City' END AS city,
    n_name AS state FROM customer JOIN nation ON n_nationkey = c_nationkey),
rv AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS review_id, l_orderkey AS order_id,
    CAST(least(5, 1 + floor(l_discount * 50)) AS INTEGER) AS review_score, l_shipdate AS created, l_returnflag, l_linestatus
  FROM lineitem WHERE l_returnflag <> 'N'),
lr AS (
  SELECT order_id, review_score, review_id FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY created DESC, review_id DESC) AS rn FROM rv) r WHERE rn = 1),
f AS (
  SELECT li.*, o.customer_id, cu.customer_unique_id, cu.state AS customer_state, o.order_status, o.ordered_at, o.order_date,
    o.delivered_at, o.estimated_at, lr.review_score,
    date_diff('day', o.ordered_at, o.delivered_at) AS days_to_deliver,
    date_diff('day', o.delivered_at, o.estimated_at) AS days_early, o.delivered_at > o.estimated_at AS is_late,
    CASE WHEN date_diff('day', o.delivered_at, o.estimated_at) > 10 THEN 1 WHEN date_diff('day', o.delivered_at, o.estimated_at) > 3 THEN 2
      WHEN date_diff('day', o.delivered_at, o.estimated_at) >= 0 THEN 3 WHEN date_diff('day', o.delivered_at, o.estimated_at) >= -3 THEN 4
      WHEN date_diff('day', o.delivered_at, o.estimated_at) >= -10 THEN 5 WHEN o.delivered_at IS NOT NULL THEN 6 END AS band_sort
  FROM li JOIN o ON o.order_id = li.order_id JOIN cu ON cu.customer_id = o.customer_id LEFT JOIN lr ON lr.order_id = li.order_id),
fb AS (
  SELECT *, CASE band_sort WHEN 1 THEN '>10d early' WHEN 2 THEN '4-10d early' WHEN 3 THEN '0-3d early' WHEN 4 THEN '1-3d late'
    WHEN 5 THEN '4-10d late' WHEN 6 THEN '>10d late' END AS band FROM f),
pay AS (
  SELECT o_orderkey AS order_id, 1 AS payment_sequential, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'credit_card'
      WHEN o_orderpriority = '5-LOW' THEN 'boleto' ELSE 'debit_card' END AS payment_type,
    CASE WHEN o_custkey % 12 <> 7 THEN greatest(CAST(o_custkey % 12 AS INTEGER), 1) END AS payment_installments,
    CAST(o_totalprice AS DECIMAL(12,2)) AS payment_value FROM orders
  UNION ALL SELECT o_orderkey, 2, 'voucher', 1, CAST(10 AS DECIMAL(12,2)) FROM orders WHERE o_orderpriority = '1-URGENT'),
pr AS (
  SELECT p_partkey AS product_id, CASE WHEN p_size = 50 THEN NULL ELSE p_type END AS category_name,
    CASE WHEN p_size = 50 THEN 'unknown' WHEN p_type IN ('PROMO', 'ECONOMY') THEN p_type
      ELSE upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' goods' END AS category,
    p_size, p_name, CASE WHEN p_size % 5 <> 0 THEN p_size * 2 * 3.5 END AS volume FROM part),
we AS (
  SELECT n_name AS state, d AS weather_date, CAST(s % 29 AS DOUBLE) AS rain_mm, s % 101 AS code, s % 35 AS temp FROM (
    SELECT DISTINCT c_nationkey, CAST(o_orderdate AS DATE) AS d, c_nationkey * 7 + dayofyear(o_orderdate) * 3 AS s
    FROM orders JOIN customer ON o_custkey = c_custkey) x JOIN nation ON n_nationkey = c_nationkey)"""
