"""Order-star queries: staging, dimensions, facts and the measures over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import bands, calendar, text
from tallyloom.operators import marts
from tallyloom.operators import metrics as m
from tallyloom.plans import shop
from tallyloom.plans.registry import query
from tallyloom.plans.shop import SHOP_SQL, Shop, plain
from tallyloom.sources.tables import Tables

def month():
    return F.date_format("ordered_at", "yyyy-MM").alias("year_month")

DENSE = ("1996-01-01", "2001-01-01")


# --- staging -------------------------------------------------------------------------------------


@query("stg_clean_text", f"""WITH {SHOP_SQL}
SELECT order_status, NULL AS title, NULL AS message, count(*) AS n FROM o GROUP BY 1
UNION ALL SELECT 'review', trim(l_returnflag), CASE WHEN l_returnflag <> 'A' THEN l_linestatus END, count(*) FROM rv GROUP BY 2, 3""")
def stg_clean_text(t: Tables) -> DataFrame:
    s = Shop(t)
    none = F.lit(None).cast("string")
    status = s.orders.groupBy("order_status").agg(F.count("*").alias("n"))
    reviews = s.reviews.groupBy("review_comment_title", "review_comment_message").agg(F.count("*").alias("n"))
    return status.select("order_status", none.alias("title"), none.alias("message"), "n").unionByName(
        reviews.select(
            F.lit("review").alias("order_status"),
            F.col("review_comment_title").alias("title"),
            F.col("review_comment_message").alias("message"),
            "n",
        )
    )


@query("stg_lpad_zip", f"""WITH {SHOP_SQL}
SELECT customer_id, zip, lpad(CAST(customer_id AS VARCHAR), 9, '0') AS ein, city, upper(state) AS state FROM cu""")
def stg_lpad_zip(t: Tables) -> DataFrame:
    return Shop(t).customers.select(
        "customer_id",
        F.col("customer_zip_code_prefix").alias("zip"),
        text.zero_pad("customer_id", 9).alias("ein"),
        F.col("customer_city").alias("city"),
        F.col("customer_state").alias("state"),
    )


@query("stg_surrogate_concat", f"""WITH {SHOP_SQL}
SELECT l_orderkey || '-' || l_linenumber AS row_key, count(*) AS n FROM lineitem GROUP BY 1
UNION ALL SELECT 'p' || order_id || '-' || payment_sequential, 1 FROM pay""")
def stg_surrogate_concat(t: Tables) -> DataFrame:
    s = Shop(t)
    lines = s.lines.groupBy(F.col("order_line_key").alias("row_key")).agg(F.count("*").alias("n"))
    pays = s.payments.select(F.concat(F.lit("p"), "order_payment_key").alias("row_key"), F.lit(1).cast("bigint").alias("n"))
    return lines.unionByName(pays)


@query("stg_installments_floor", f"""WITH {SHOP_SQL}
SELECT payment_type, payment_installments, count(*) AS n, CAST(sum(payment_value) AS DOUBLE) AS value FROM pay GROUP BY 1, 2""")
def stg_installments_floor(t: Tables) -> DataFrame:
    return plain(
        Shop(t).payments.groupBy("payment_type", "payment_installments").agg(
            F.count("*").alias("n"), F.sum("payment_value").alias("value")
        )
    )


@query("stg_geo_bounds", """SELECT n_name AS state, c_acctbal / 500 - 10 BETWEEN -34 AND 5.5 AND -c_acctbal / 200 BETWEEN -74 AND -34 AS is_within_bounds,
  count(*) AS n, CAST(min(CAST(c_acctbal / 500 - 10 AS DECIMAL(11,7))) AS DOUBLE) AS min_lat
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def stg_geo_bounds(t: Tables) -> DataFrame:
    geo = marts.stg_geolocation(shop.raw_geolocation(t))
    return plain(geo.groupBy("state", "is_within_bounds").agg(F.count("*").alias("n"), F.min("latitude").alias("min_lat")))


@query("stg_rename_typo", """SELECT p_partkey AS product_id, CAST(length(p_name) AS INTEGER) AS product_name_length,
  CAST(NULL AS INTEGER) AS product_description_length, p_size AS product_photos_qty,
  CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS product_weight_g FROM part""")
def stg_rename_typo(t: Tables) -> DataFrame:
    return plain(
        Shop(t).products.select(
            "product_id", "product_name_length", "product_description_length", "product_photos_qty", "product_weight_g"
        )
    )


@query("stg_coerce_numeric", """SELECT p_size % 5 = 0 AS was_text, count(*) AS rows, count(CASE WHEN p_size % 5 <> 0 THEN 1 END) AS numeric_rows
FROM part GROUP BY 1""")
def stg_coerce_numeric(t: Tables) -> DataFrame:
    width = text.numeric_or_null("product_width_cm")
    return (
        shop.raw_products(t)
        .groupBy((F.col("product_width_cm") == "?").alias("was_text"))
        .agg(F.count("*").alias("rows"), F.count(width).alias("numeric_rows"))
    )


# --- facts and dimensions ------------------------------------------------------------------------


@query("order_line_measures", f"""WITH {SHOP_SQL}
SELECT order_item_id = 1 AS is_order_header_line, order_status = 'delivered' AS is_delivered, count(*) AS lines,
  CAST(sum(item_revenue) AS DOUBLE) AS revenue FROM f GROUP BY 1, 2""")
def order_line_measures(t: Tables) -> DataFrame:
    return plain(
        Shop(t).sales().groupBy("is_order_header_line", "is_delivered").agg(
            F.count("*").alias("lines"), F.sum("item_revenue").alias("revenue")
        )
    )


@query("delivery_metrics", f"""WITH {SHOP_SQL}
SELECT order_id, date_diff('day', ordered_at, delivered_at) AS days_to_deliver,
  date_diff('day', delivered_at, estimated_at) AS days_early_vs_estimate, delivered_at > estimated_at AS is_late_delivery FROM o""")
def delivery_metrics(t: Tables) -> DataFrame:
    return marts.delivery_metrics(Shop(t).orders).select(
        "order_id",
        F.col("days_to_deliver").cast("bigint"),
        F.col("days_early_vs_estimate").cast("bigint"),
        "is_late_delivery",
    )


@query("delivery_band", f"""WITH {SHOP_SQL}
SELECT band AS delivery_timeliness_band, band_sort AS delivery_timeliness_sort, is_late AS is_late_delivery, count(*) AS lines
FROM fb GROUP BY 1, 2, 3""")
def delivery_band(t: Tables) -> DataFrame:
    return (
        Shop(t)
        .lines_only()
        .groupBy("delivery_timeliness_band", "delivery_timeliness_sort", "is_late_delivery")
        .agg(F.count("*").alias("lines"))
    )


@query("weather_flags", f"""WITH {SHOP_SQL}
SELECT state || '-' || strftime(weather_date, '%Y-%m-%d') AS weather_key, rain_mm, rain_mm >= 1 AS is_rainy_day, rain_mm >= 20 AS is_heavy_rain_day,
  CASE WHEN code <= 3 THEN 'clear_or_cloudy' WHEN code >= 45 AND code <= 48 THEN 'fog' WHEN code >= 51 AND code <= 57 THEN 'drizzle'
    WHEN code >= 61 AND code <= 67 THEN 'rain' WHEN code >= 71 AND code <= 77 THEN 'snow' WHEN code >= 80 AND code <= 82 THEN 'rain_showers'
    WHEN code >= 95 AND code <= 99 THEN 'thunderstorm' ELSE 'other' END AS weather_condition FROM we""")
def weather_flags(t: Tables) -> DataFrame:
    return plain(
        Shop(t).dim_weather().select("weather_key", "rain_mm", "is_rainy_day", "is_heavy_rain_day", "weather_condition")
    )


@query("product_attrs", f"""WITH {SHOP_SQL}
SELECT product_id, coalesce(category_name, 'unknown') AS product_category_name, category AS product_category,
  category_name IS NULL AS is_uncategorised, CAST(volume AS DOUBLE) AS product_volume_cm3 FROM pr""")
def product_attrs(t: Tables) -> DataFrame:
    return plain(
        Shop(t).dim_products().select(
            "product_id", "product_category_name", "product_category", "is_uncategorised", "product_volume_cm3"
        )
    )


@query("join_translation", f"""WITH {SHOP_SQL} SELECT category AS product_category, count(*) AS products FROM pr GROUP BY 1""")
def join_translation(t: Tables) -> DataFrame:
    return Shop(t).dim_products().groupBy("product_category").agg(F.count("*").alias("products"))


@query("calendar_date_dim", """SELECT CAST(d AS DATE) AS date_day, CAST(year(d) AS INTEGER) AS calendar_year, CAST(quarter(d) AS INTEGER) AS calendar_quarter,
  CAST(month(d) AS INTEGER) AS calendar_month, strftime(d, '%b') AS month_name, strftime(d, '%Y-%m') AS year_month,
  CAST(day(d) AS INTEGER) AS day_of_month, CAST(isodow(d) AS INTEGER) AS day_of_week, strftime(d, '%a') AS day_name,
  CAST(weekofyear(d) AS INTEGER) AS week_of_year, CAST(dayofyear(d) AS INTEGER) AS day_of_year, isodow(d) >= 6 AS is_weekend,
  CAST(d AS DATE) = last_day(d) AS is_month_end, CAST(date_trunc('week', d) AS DATE) AS week_start_date,
  CAST(date_trunc('month', d) AS DATE) AS month_start_date, (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) = CAST(d AS DATE)) AS orders
FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2002-01-01', INTERVAL 1 DAY) r(d)""")
def calendar_date_dim(t: Tables) -> DataFrame:
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("date_day")).agg(F.count("*").alias("orders"))
    return calendar.date_dim(t.spark, "1995-01-01", "2001-12-31").join(daily, "date_day", "left").na.fill(0, ["orders"])


@query("calendar_date_dim_ext", """WITH s AS (
  SELECT least((SELECT min(o_orderdate) FROM orders), (SELECT min(ts) FROM events)) AS a,
    greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(ts) FROM events)) AS b),
d AS (SELECT d FROM s, range(date_trunc('year', CAST(a AS TIMESTAMP)), date_trunc('year', CAST(b AS TIMESTAMP)) + INTERVAL 1 YEAR, INTERVAL 1 DAY) r(d))
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS date_day, CAST(year(d) AS INTEGER) AS year,
  CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day_of_month,
  CAST(dayofyear(d) AS INTEGER) AS day_of_year, CAST(weekofyear(d) AS INTEGER) AS week_of_year, CAST(isoyear(d) AS INTEGER) AS iso_year,
  CAST(isodow(d) AS INTEGER) AS day_of_week, strftime(d, '%A') AS day_name, strftime(d, '%a') AS day_abbr, strftime(d, '%B') AS month_name,
  strftime(d, '%b') AS month_abbr, strftime(d, '%Y-%m') AS year_month, year(d) || '-Q' || quarter(d) AS year_quarter,
  CAST(date_trunc('month', d) AS DATE) AS first_day_of_month, last_day(d) AS last_day_of_month, isodow(d) >= 6 AS is_weekend,
  day(d) = 1 AS is_month_start, CAST(d AS DATE) = last_day(d) AS is_month_end,
  CAST(d AS DATE) = last_day(d) AND month(d) IN (3, 6, 9, 12) AS is_quarter_end, strftime(d, '%m%d') = '1231' AS is_year_end FROM d
UNION ALL SELECT -1, NULL, -1, -1, -1, -1, -1, -1, -1, -1, 'Unknown', 'Unknown', 'Unknown', 'Unknown', 'Unknown', 'Unknown', NULL, NULL,
  false, false, false, false, false""")
def calendar_date_dim_ext(t: Tables) -> DataFrame:
    def span(df: DataFrame, ts: str) -> DataFrame:
        return df.agg(F.to_date(F.min(ts)).alias("first_day"), F.to_date(F.max(ts)).alias("last_day"))

    return calendar.date_dim_ext(span(t.orders, "o_orderdate").unionByName(span(t.events, "ts")))


@query("win_latest_review", f"WITH {SHOP_SQL} SELECT order_id, review_score, review_id FROM lr")
def win_latest_review(t: Tables) -> DataFrame:
    return marts.latest_reviews(Shop(t).reviews).select("order_id", "review_score", "review_id")


@query("win_distinct_on", f"""WITH {SHOP_SQL}
SELECT DISTINCT ON (order_id) order_id, review_score FROM rv ORDER BY order_id, created DESC, review_id DESC""")
def win_distinct_on(t: Tables) -> DataFrame:
    return marts.latest_reviews(Shop(t).reviews).select("order_id", "review_score")


@query("join_star_lines", f"""WITH {SHOP_SQL}
SELECT order_id, order_item_id, product_id, seller_id, customer_id, customer_state, order_date,
  customer_state || '-' || strftime(order_date, '%Y-%m-%d') AS weather_key, order_status, review_score, CAST(item_revenue AS DOUBLE) AS item_revenue,
  is_late AS is_late_delivery, band AS delivery_timeliness_band FROM fb""")
def join_star_lines(t: Tables) -> DataFrame:
    return plain(
        Shop(t).fct_orders().select(
            "order_id", "order_item_id", "product_id", "seller_id", "customer_id", "customer_state", "order_date", "weather_key",
            "order_status", "review_score", "item_revenue", "is_late_delivery", "delivery_timeliness_band",
        )
    )


@query("join_payments_orders", f"""WITH {SHOP_SQL}
SELECT order_id || '-' || payment_sequential AS order_payment_key, order_date, customer_id, payment_type, payment_installments,
  CAST(payment_value AS DOUBLE) AS payment_value FROM pay JOIN o USING (order_id)""")
def join_payments_orders(t: Tables) -> DataFrame:
    return plain(
        Shop(t).fct_order_payments().select(
            "order_payment_key", "order_date", "customer_id", "payment_type", "payment_installments", "payment_value"
        )
    )


PERSON_SQL = f"""{SHOP_SQL},
person AS (SELECT customer_unique_id, count(DISTINCT order_id) AS n, min(ordered_at) AS first_at, max(ordered_at) AS last_at
  FROM cu JOIN o USING (customer_id) GROUP BY 1)"""


@query("agg_person", f"WITH {PERSON_SQL} SELECT customer_unique_id, n AS orders_by_person, first_at AS first_ordered_at, last_at AS last_ordered_at FROM person")
def agg_person(t: Tables) -> DataFrame:
    s = Shop(t)
    return marts.person_rollup(s.customers, s.orders)


@query("join_person_rollup", f"""WITH {PERSON_SQL}
SELECT customer_id, cu.customer_unique_id, city AS customer_city, state AS customer_state, coalesce(n, 0) AS orders_by_person,
  coalesce(n, 0) > 1 AS is_repeat_customer, first_at AS first_ordered_at FROM cu LEFT JOIN person USING (customer_unique_id)""")
def join_person_rollup(t: Tables) -> DataFrame:
    return Shop(t).dim_customers().select(
        "customer_id", "customer_unique_id", "customer_city", "customer_state", "orders_by_person", "is_repeat_customer",
        "first_ordered_at",
    )


@query("join_weather_composite", f"""WITH {SHOP_SQL}
SELECT weather_date IS NOT NULL AS has_weather, coalesce(rain_mm >= 1, false) AS rainy, count(*) AS lines, CAST(sum(item_revenue) AS DOUBLE) AS revenue
FROM f LEFT JOIN we ON we.state = f.customer_state AND we.weather_date = f.order_date GROUP BY 1, 2""")
def join_weather_composite(t: Tables) -> DataFrame:
    s = Shop(t)
    weather = s.dim_weather().select(F.col("state").alias("customer_state"), F.col("weather_date").alias("order_date"), "is_rainy_day")
    lines = s.lines_only().withColumn("order_date", F.to_date("ordered_at"))
    # Both sides go down to state and day first, so the join sees days, not lines.
    daily = lines.groupBy("customer_state", "order_date").agg(F.count("*").alias("n"), F.sum("item_revenue").alias("rev"))
    joined = daily.join(weather.withColumn("_hit", F.lit(True)), ["customer_state", "order_date"], "left")
    return plain(
        joined.groupBy(F.col("_hit").isNotNull().alias("has_weather"), F.coalesce("is_rainy_day", F.lit(False)).alias("rainy")).agg(
            F.sum("n").alias("lines"), F.sum("rev").alias("revenue")
        )
    )


# --- filters -------------------------------------------------------------------------------------


@query("flt_date_window", f"""SELECT count(*) AS orders, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day
FROM orders WHERE o_orderdate >= TIMESTAMP '{DENSE[0]}' AND o_orderdate < TIMESTAMP '{DENSE[1]}'""")
def flt_date_window(t: Tables) -> DataFrame:
    return m.date_window(t.orders, "o_orderdate", *DENSE).agg(
        F.count("*").alias("orders"), F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day")
    )


@query("flt_status_exclude", f"""WITH {SHOP_SQL}
SELECT order_status, count(*) AS orders FROM o WHERE order_status NOT IN ('canceled', 'unavailable') GROUP BY 1""")
def flt_status_exclude(t: Tables) -> DataFrame:
    return m.exclude_status(Shop(t).orders, ("canceled", "unavailable")).groupBy("order_status").agg(F.count("*").alias("orders"))


@query("flt_header_line", "SELECT l_linestatus, count(*) AS lines FROM lineitem WHERE l_linenumber = 1 GROUP BY 1")
def flt_header_line(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumn("is_order_header_line", F.col("l_linenumber") == 1)
    return m.header_lines(lines).groupBy("l_linestatus").agg(F.count("*").alias("lines"))


# --- measures ------------------------------------------------------------------------------------


@query("agg_revenue_kpi", f"""WITH {SHOP_SQL}, po AS (SELECT order_id, sum(item_revenue) AS rev, max(review_score) AS score FROM f
  WHERE order_status <> 'canceled' GROUP BY 1)
SELECT CAST(sum(rev) AS DOUBLE) AS total_revenue, count(*) AS total_orders, round(CAST(sum(rev) AS DOUBLE) / count(*), 6) AS avg_order_value,
  round(avg(score), 6) AS avg_review_score FROM po""")
def agg_revenue_kpi(t: Tables) -> DataFrame:
    return plain(m.revenue_kpis(m.exclude_status(Shop(t).fct_orders(), ("canceled",))), 6)


@query("agg_revenue_month", f"""WITH {SHOP_SQL}
SELECT strftime(order_date, '%Y-%m') AS year_month, CAST(sum(item_revenue) AS DOUBLE) AS revenue, count(*) AS lines, count(DISTINCT order_id) AS orders
FROM f GROUP BY 1""")
def agg_revenue_month(t: Tables) -> DataFrame:
    return plain(m.revenue_by(Shop(t).sales(), month()))


@query("agg_growth_drivers", f"""WITH {SHOP_SQL}
SELECT strftime(order_date, '%Y-%m') AS year_month, count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS unique_customers,
  count(DISTINCT seller_id) AS active_sellers, round(CAST(sum(item_revenue) AS DOUBLE) / count(DISTINCT order_id), 2) AS avg_order_value
FROM f GROUP BY 1""")
def agg_growth_drivers(t: Tables) -> DataFrame:
    return m.growth_drivers(Shop(t).sales(), month())


@query("agg_revenue_day_peak", f"""WITH {SHOP_SQL},
dd AS (SELECT order_date AS day, sum(item_revenue) AS revenue, count(DISTINCT order_id) AS orders FROM f
  WHERE order_date >= DATE '{DENSE[0]}' AND order_date < DATE '{DENSE[1]}' GROUP BY 1)
SELECT day, CAST(revenue AS DOUBLE) AS revenue, orders, round(CAST(revenue AS DOUBLE) / (SELECT avg(CAST(revenue AS DOUBLE)) FROM dd), 4) AS x_mean
FROM dd ORDER BY revenue DESC, day LIMIT 5""")
def agg_revenue_day_peak(t: Tables) -> DataFrame:
    return plain(m.day_peaks(m.date_window(Shop(t).sales(), "ordered_at", *DENSE), F.to_date("ordered_at")))


def category_totals(t: Tables) -> DataFrame:
    """Revenue by brand: lines shrink to one row per part before they meet the part table."""
    per_part = t.lineitem.groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).alias("rev"))
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("category"))
    return per_part.join(parts, "l_partkey").groupBy("category").agg(F.sum("rev").alias("revenue"))


CATEGORY_SQL = """cat AS (SELECT p_brand AS category, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS revenue
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)"""


@query("agg_category_top10", f"""WITH {CATEGORY_SQL}
SELECT category, CAST(revenue AS DOUBLE) AS revenue,
  round(CAST(revenue AS DOUBLE) * 100 / CAST((SELECT sum(revenue) FROM cat) AS DOUBLE), 4) AS share_pct
FROM cat ORDER BY cat.revenue DESC, category LIMIT 10""")
def agg_category_top10(t: Tables) -> DataFrame:
    totals = category_totals(t).withColumn("revenue", F.col("revenue").cast("double"))
    return m.top_n_share(totals, "category", "revenue", 10)


@query("agg_topn_other", f"""WITH {CATEGORY_SQL}, rk AS (SELECT *, row_number() OVER (ORDER BY revenue DESC, category) AS r FROM cat WHERE category <> 'Brand#7')
SELECT category, CAST(revenue AS DOUBLE) AS revenue FROM rk WHERE r <= 10
UNION ALL SELECT 'Other (' || count(*) || ')', CAST(sum(revenue) AS DOUBLE) FROM rk WHERE r > 10
UNION ALL SELECT category, CAST(revenue AS DOUBLE) FROM cat WHERE category = 'Brand#7'""")
def agg_topn_other(t: Tables) -> DataFrame:
    return plain(m.top_n_other(category_totals(t), "category", "revenue", 10, unknown="Brand#7"))


@query("agg_state_top10", f"""WITH {SHOP_SQL}
SELECT customer_state, CAST(sum(item_revenue) AS DOUBLE) AS revenue FROM f GROUP BY 1 ORDER BY sum(item_revenue) DESC, 1 LIMIT 10""")
def agg_state_top10(t: Tables) -> DataFrame:
    revenue = Shop(t).lines_only().groupBy("customer_state").agg(F.sum("item_revenue").alias("revenue"))
    return plain(revenue.orderBy(F.desc("revenue"), "customer_state").limit(10))


@query("agg_thin_periods", f"""WITH {SHOP_SQL}
SELECT strftime(order_date, '%Y-%m') AS year_month, count(DISTINCT order_id) AS orders, count(DISTINCT order_id) < 180 AS is_thin
FROM f GROUP BY 1""")
def agg_thin_periods(t: Tables) -> DataFrame:
    months = m.revenue_by(Shop(t).sales(), month()).select("year_month", "orders")
    return m.thin_periods(months, minimum=180)


@query("agg_status_mix", f"""WITH {SHOP_SQL}, s AS (SELECT order_status, count(DISTINCT order_id) AS orders, sum(item_revenue) AS revenue FROM f GROUP BY 1)
SELECT order_status, orders, CAST(revenue AS DOUBLE) AS revenue,
  round(CAST(revenue AS DOUBLE) * 100 / CAST((SELECT sum(revenue) FROM s) AS DOUBLE), 4) AS share_pct FROM s""")
def agg_status_mix(t: Tables) -> DataFrame:
    return plain(m.status_mix(Shop(t).sales().withColumn("item_revenue", F.col("item_revenue"))), 4)


@query("agg_band_distribution", f"WITH {SHOP_SQL} SELECT band AS delivery_timeliness_band, band_sort AS delivery_timeliness_sort, count(*) AS lines FROM fb WHERE band IS NOT NULL GROUP BY 1, 2")
def agg_band_distribution(t: Tables) -> DataFrame:
    s = Shop(t)
    # The band is an order attribute: count lines per order first, then band the orders.
    per_order = s.lines.groupBy("order_id").agg(F.count("*").alias("n"))
    banded = marts.delivery_metrics(s.orders).filter("delivery_timeliness_band is not null")
    return per_order.join(banded, "order_id").groupBy("delivery_timeliness_band", "delivery_timeliness_sort").agg(F.sum("n").alias("lines"))


@query("agg_review_by_band", f"""WITH {SHOP_SQL}
SELECT band_sort AS delivery_timeliness_sort, band AS delivery_timeliness_band, count(*) AS orders, count(review_score) AS reviewed,
  round(avg(review_score), 6) AS avg_score FROM fb WHERE band IS NOT NULL AND order_item_id = 1 GROUP BY 1, 2""")
def agg_review_by_band(t: Tables) -> DataFrame:
    return plain(m.review_by_band(Shop(t).fct_orders()), 6)


@query("agg_state_delivery", f"""WITH {SHOP_SQL}
SELECT customer_state, count(*) AS delivered, round(avg(days_to_deliver), 6) AS avg_days,
  round(100.0 * count(CASE WHEN is_late THEN 1 END) / count(*), 4) AS late_pct
FROM f WHERE order_item_id = 1 AND days_to_deliver IS NOT NULL GROUP BY 1 HAVING count(*) >= 200""")
def agg_state_delivery(t: Tables) -> DataFrame:
    return plain(m.state_delivery(Shop(t).lines_only(), "customer_state", 200), 6)


def reviewed_lines(t: Tables) -> DataFrame:
    s = Shop(t)
    parts = t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("product_category"))
    return s.fct_orders().join(parts, "product_id")


REVIEW_CATEGORY_SQL = f"""{SHOP_SQL}, rc AS (
  SELECT p_brand AS product_category, round(avg(review_score), 2) AS avg_review, count(*) AS n_reviews FROM f JOIN part ON p_partkey = product_id
  WHERE review_score IS NOT NULL AND order_item_id = 1 AND p_brand <> 'Brand#7' GROUP BY 1 HAVING count(*) >= 30)"""


@query("category_avg_min_n", f"WITH {REVIEW_CATEGORY_SQL} SELECT * FROM rc")
def category_avg_min_n(t: Tables) -> DataFrame:
    return m.review_by_category(reviewed_lines(t), "product_category", 30, "Brand#7")


@query("agg_review_category", f"""WITH {REVIEW_CATEGORY_SQL}
SELECT * FROM (SELECT 'Top' AS grp, product_category, avg_review FROM rc ORDER BY avg_review DESC, product_category LIMIT 10) a
UNION ALL SELECT * FROM (SELECT 'Bottom', product_category, avg_review FROM rc ORDER BY avg_review, product_category LIMIT 10) b""")
def agg_review_category(t: Tables) -> DataFrame:
    return m.best_and_worst(m.review_by_category(reviewed_lines(t), "product_category", 30, "Brand#7"), "product_category", "avg_review")


@query("agg_payment_mix", f"""WITH {SHOP_SQL}
SELECT payment_type, count(*) AS payments, CAST(sum(payment_value) AS DOUBLE) AS value, round(avg(payment_installments), 4) AS avg_installments,
  round(CAST(sum(payment_value) AS DOUBLE) * 100 / CAST((SELECT sum(payment_value) FROM pay) AS DOUBLE), 4) AS share_pct FROM pay GROUP BY 1""")
def agg_payment_mix(t: Tables) -> DataFrame:
    return plain(m.payment_mix(Shop(t).payments), 4)


@query("agg_installment_ladder", f"""WITH {SHOP_SQL}
SELECT payment_installments, count(*) AS payments, round(avg(CAST(payment_value AS DOUBLE)), 4) AS avg_value FROM pay
WHERE payment_type = 'credit_card' GROUP BY 1""")
def agg_installment_ladder(t: Tables) -> DataFrame:
    return plain(m.installment_ladder(Shop(t).payments, "credit_card"), 4)


@query("agg_repeat_rate", f"""WITH {PERSON_SQL}
SELECT count(*) AS people, count(CASE WHEN n > 1 THEN 1 END) AS repeat_people, round(100.0 * count(CASE WHEN n > 1 THEN 1 END) / count(*), 4) AS repeat_pct
FROM person""")
def agg_repeat_rate(t: Tables) -> DataFrame:
    s = Shop(t)
    return plain(m.repeat_rate(marts.person_rollup(s.customers, s.orders)))


@query("agg_order_count_histogram", f"WITH {PERSON_SQL} SELECT n AS orders_by_person, count(*) AS people FROM person GROUP BY 1")
def agg_order_count_histogram(t: Tables) -> DataFrame:
    s = Shop(t)
    return m.order_count_histogram(marts.person_rollup(s.customers, s.orders))


@query("join_anti_lineless", """SELECT o_orderstatus, count(*) AS orders FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1""")
def join_anti_lineless(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(lines, "o_orderkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


@query("agg_grain_facts", f"""WITH {SHOP_SQL}
SELECT 'orders' AS label, count(*) AS n FROM o UNION ALL SELECT 'order lines', count(*) FROM li
UNION ALL SELECT 'orders without lines', count(*) FROM o WHERE NOT EXISTS (SELECT 1 FROM li WHERE li.order_id = o.order_id)
UNION ALL SELECT 'multi-line orders', count(*) FROM (SELECT order_id FROM li GROUP BY 1 HAVING count(*) > 1) a
UNION ALL SELECT 'split-payment orders', count(*) FROM (SELECT order_id FROM pay GROUP BY 1 HAVING count(*) > 1) b
UNION ALL SELECT 'orders with several reviews', count(*) FROM (SELECT order_id FROM rv GROUP BY 1 HAVING count(*) > 1) c
UNION ALL SELECT 'products without category', count(*) FROM pr WHERE category_name IS NULL""")
def agg_grain_facts(t: Tables) -> DataFrame:
    s = Shop(t)
    return m.labelled_counts(
        {
            "orders": s.orders,
            "order lines": s.lines,
            "orders without lines": s.orders.join(s.lines.select("order_id"), "order_id", "left_anti"),
            "multi-line orders": m.groups_with_many(s.lines, "order_id"),
            "split-payment orders": m.groups_with_many(s.payments, "order_id"),
            "orders with several reviews": m.groups_with_many(s.reviews, "order_id"),
            "products without category": s.products.filter("product_category_name is null"),
        }
    )


@query("agg_revenue_gap", f"""WITH {SHOP_SQL}, x AS (SELECT (SELECT sum(item_revenue) FROM li) AS a, (SELECT sum(payment_value) FROM pay) AS b)
SELECT CAST(a AS DOUBLE) AS line_revenue, CAST(b AS DOUBLE) AS payment_total, CAST(b - a AS DOUBLE) AS gap,
  round(CAST(b - a AS DOUBLE) * 100 / CAST(a AS DOUBLE), 4) AS gap_pct FROM x""")
def agg_revenue_gap(t: Tables) -> DataFrame:
    s = Shop(t)
    lines = s.lines.withColumn("item_revenue", F.col("item_price") + F.col("freight_value"))
    return plain(m.revenue_gap(lines, s.payments))


@query("agg_freshness", """SELECT 'lines' AS fact, CAST(min(l_shipdate) AS DATE) AS first_date, CAST(max(l_shipdate) AS DATE) AS last_date FROM lineitem
UNION ALL SELECT 'orders', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE) FROM orders
UNION ALL SELECT 'events', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) FROM events""")
def agg_freshness(t: Tables) -> DataFrame:
    return m.freshness(
        {
            "lines": (t.lineitem, F.to_date("l_shipdate")),
            "orders": (t.orders, F.to_date("o_orderdate")),
            "events": (t.events, F.to_date("ts")),
        }
    )


COUNTED = ("orders", "lineitem", "customer", "part", "supplier", "nation", "region", "events", "documents", "pages")
COUNT_SQL = " UNION ALL ".join(f"SELECT '{name}' AS label, count(*) AS n FROM {name}" for name in COUNTED)


@query("agg_rowcounts", COUNT_SQL)
def agg_rowcounts(t: Tables) -> DataFrame:
    return m.labelled_counts({name: getattr(t, name) for name in COUNTED})


@query("set_union_all", """SELECT 'orders' AS src, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'lines', l_linestatus, count(*) FROM lineitem GROUP BY 2""")
def set_union_all(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    b = t.lineitem.groupBy(F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"))
    return a.select(F.lit("orders").alias("src"), "status", "n").unionAll(b.select(F.lit("lines").alias("src"), "status", "n"))


@query("set_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def set_distinct(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_type").distinct()


@query("agg_state_centroid", """WITH g AS (SELECT n_name AS state, CAST(c_acctbal / 500 - 10 AS DECIMAL(11,7)) AS lat, CAST(-c_acctbal / 200 AS DECIMAL(11,7)) AS lng
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
c AS (SELECT state, median(CAST(lat AS DOUBLE)) AS lat, median(CAST(lng AS DOUBLE)) AS lng FROM g WHERE lat BETWEEN -34 AND 5.5 AND lng BETWEEN -74 AND -34 GROUP BY 1),
v AS (SELECT n_name AS state, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
SELECT c.state, round(lat, 6) AS lat, round(lng, 6) AS lng, coalesce(orders, 0) AS orders FROM c LEFT JOIN v USING (state)""")
def agg_state_centroid(t: Tables) -> DataFrame:
    points = plain(marts.stg_geolocation(shop.raw_geolocation(t)))
    s = Shop(t)
    volumes = s.orders.join(s.customers, "customer_id").groupBy(F.col("customer_state").alias("state")).agg(F.count("*").alias("orders"))
    return m.state_centroids(points, volumes, digits=6)


MATCHED_SQL = f"""{SHOP_SQL},
daily AS (SELECT customer_state, order_date, CAST(sum(item_revenue) AS DOUBLE) AS rev FROM f GROUP BY 1, 2),
cells AS (SELECT customer_state, strftime(order_date, '%Y-%m') AS ym, isodow(order_date) AS dow, avg(CASE WHEN rain_mm >= 20 THEN rev END) AS wet,
  avg(CASE WHEN rain_mm < 20 THEN rev END) AS dry FROM daily JOIN we ON we.state = customer_state AND weather_date = order_date GROUP BY 1, 2, 3)"""


def weather_revenue(t: Tables) -> DataFrame:
    s = Shop(t)
    lines = s.lines_only().withColumn("order_date", F.to_date("ordered_at"))
    daily = lines.groupBy("customer_state", "order_date").agg(F.sum("item_revenue").cast("double").alias("rev"))
    weather = s.dim_weather().select(F.col("state").alias("customer_state"), F.col("weather_date").alias("order_date"), "is_heavy_rain_day")
    return daily.join(weather, ["customer_state", "order_date"])


def rain_cells() -> list:
    return [F.col("customer_state"), F.date_format("order_date", "yyyy-MM"), F.weekday("order_date")]


@query("agg_matched_cells", f"""WITH {MATCHED_SQL}
SELECT count(*) AS cells, round(sum(wet - dry), 2) AS delta, round(sum(dry), 2) AS baseline, round(100 * sum(wet - dry) / sum(dry), 4) AS effect_pct
FROM cells WHERE wet IS NOT NULL AND dry IS NOT NULL""")
def agg_matched_cells(t: Tables) -> DataFrame:
    out = m.matched_cells(weather_revenue(t), rain_cells(), "is_heavy_rain_day", "rev")
    return out.select("cells", F.round("delta", 2).alias("delta"), F.round("baseline", 2).alias("baseline"), F.round("effect_pct", 4).alias("effect_pct"))


@query("agg_matched_cells_by_state", f"""WITH {MATCHED_SQL}
SELECT customer_state, count(*) AS cells, round(100 * sum(wet - dry) / sum(dry), 4) AS effect_pct
FROM cells WHERE wet IS NOT NULL AND dry IS NOT NULL GROUP BY 1""")
def agg_matched_cells_by_state(t: Tables) -> DataFrame:
    out = m.matched_cells(weather_revenue(t), rain_cells(), "is_heavy_rain_day", "rev", by=["customer_state"])
    return out.select("customer_state", "cells", F.round("effect_pct", 4).alias("effect_pct"))


@query("dim_sellers", """SELECT s_suppkey AS seller_id, upper(substr(s_name, 1, 1)) || lower(substr(s_name, 2)) AS seller_city, 'N' || s_nationkey AS seller_state,
  lpad(CAST(s_suppkey * 37 % 100000 AS VARCHAR), 5, '0') AS seller_zip_code_prefix FROM supplier""")
def dim_sellers(t: Tables) -> DataFrame:
    """The seller dimension over the suppliers: padded zip, trimmed names."""
    raw = t.supplier.select(
        F.col("s_suppkey").alias("seller_id"),
        F.concat(F.lit(" "), F.lower("s_name"), F.lit(" ")).alias("seller_city"),
        F.concat(F.lit(" n"), "s_nationkey").alias("seller_state"),
        (F.col("s_suppkey") * 37 % 100000).cast("string").alias("seller_zip_code_prefix"),
    )
    return marts.stg_sellers(raw)
