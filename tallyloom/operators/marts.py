"""Staging clean-up, dimensions and facts of the order star."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.bands import HEAVY_RAIN_MM, is_rainy, timeliness, weather_condition
from tallyloom.functions.text import blank_to_null, joined_key, numeric_or_null, zero_pad
from tallyloom.operators.ordered import first_by

# Bounding box (latitude, longitude) of valid coordinates.
LAT_BOUNDS = (-34.0, 5.5)
LNG_BOUNDS = (-74.0, -34.0)


def _ntz(*names: tuple[str, str]) -> list[Column]:
    return [F.col(src).cast("timestamp_ntz").alias(out) for src, out in names]


def stg_orders(raw: DataFrame) -> DataFrame:
    return raw.select(
        "order_id",
        "customer_id",
        F.lower(F.trim("order_status")).alias("order_status"),
        *_ntz(
            ("order_purchase_timestamp", "ordered_at"),
            ("order_approved_at", "approved_at"),
            ("order_delivered_carrier_date", "delivered_to_carrier_at"),
            ("order_delivered_customer_date", "delivered_to_customer_at"),
            ("order_estimated_delivery_date", "estimated_delivery_at"),
        ),
    )


def stg_order_items(raw: DataFrame) -> DataFrame:
    return raw.select(
        joined_key("order_id", "order_item_id").alias("order_line_key"),
        "order_id",
        F.col("order_item_id").cast("int").alias("order_item_id"),
        "product_id",
        "seller_id",
        *_ntz(("shipping_limit_date", "shipping_limit_at")),
        F.col("price").cast("decimal(12,2)").alias("item_price"),
        F.col("freight_value").cast("decimal(12,2)").alias("freight_value"),
    )


def floor_installments(value: Column | str) -> Column:
    """At least one instalment; an unknown number stays unknown."""
    n = (F.col(value) if isinstance(value, str) else value).cast("int")
    return F.when(n.isNotNull(), F.greatest(n, F.lit(1)))


def stg_order_payments(raw: DataFrame) -> DataFrame:
    return raw.select(
        joined_key("order_id", "payment_sequential").alias("order_payment_key"),
        "order_id",
        F.col("payment_sequential").cast("int").alias("payment_sequential"),
        F.lower(F.trim("payment_type")).alias("payment_type"),
        floor_installments("payment_installments").alias("payment_installments"),
        F.col("payment_value").cast("decimal(12,2)").alias("payment_value"),
    )


def stg_order_reviews(raw: DataFrame) -> DataFrame:
    return raw.select(
        "review_id",
        "order_id",
        F.col("review_score").cast("int").alias("review_score"),
        blank_to_null("review_comment_title").alias("review_comment_title"),
        blank_to_null("review_comment_message").alias("review_comment_message"),
        *_ntz(("review_creation_date", "review_created_at"), ("review_answer_timestamp", "review_answered_at")),
    )


def stg_customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "customer_id",
        "customer_unique_id",
        zero_pad("customer_zip_code_prefix", 5).alias("customer_zip_code_prefix"),
        F.initcap(F.trim("customer_city")).alias("customer_city"),
        F.upper(F.trim("customer_state")).alias("customer_state"),
    )


def stg_sellers(raw: DataFrame) -> DataFrame:
    """Also the seller dimension: it needs nothing beyond the clean-up."""
    return raw.select(
        "seller_id",
        F.initcap(F.trim("seller_city")).alias("seller_city"),
        F.upper(F.trim("seller_state")).alias("seller_state"),
        zero_pad("seller_zip_code_prefix", 5).alias("seller_zip_code_prefix"),
    )


def stg_geolocation(raw: DataFrame) -> DataFrame:
    lat = F.col("geolocation_lat").cast("decimal(11,7)")
    lng = F.col("geolocation_lng").cast("decimal(11,7)")
    return raw.select(
        zero_pad("geolocation_zip_code_prefix", 5).alias("zip_code_prefix"),
        lat.alias("latitude"),
        lng.alias("longitude"),
        F.initcap(F.trim("geolocation_city")).alias("city"),
        F.upper(F.trim("geolocation_state")).alias("state"),
        within_bounds(lat, lng).alias("is_within_bounds"),
    )


def within_bounds(
    lat: Column, lng: Column, lat_bounds: tuple = LAT_BOUNDS, lng_bounds: tuple = LNG_BOUNDS
) -> Column:
    """Whether a coordinate lies inside the box."""
    return lat.between(*lat_bounds) & lng.between(*lng_bounds)


def stg_products(raw: DataFrame) -> DataFrame:
    """Repairs two misspelt source headers and types the measures."""
    named = raw.withColumnsRenamed(
        {
            "product_name_lenght": "product_name_length",
            "product_description_lenght": "product_description_length",
        }
    )
    whole = ("product_name_length", "product_description_length", "product_photos_qty")
    measures = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
    return named.select(
        "product_id",
        blank_to_null("product_category_name").alias("product_category_name"),
        *[numeric_or_null(c, "int").alias(c) for c in whole],
        *[numeric_or_null(c, "decimal(12,2)").alias(c) for c in measures],
    )


def stg_translation(raw: DataFrame) -> DataFrame:
    return raw.select(*[F.trim(c).alias(c) for c in ("product_category_name", "product_category_name_english")])


def stg_weather(raw: DataFrame) -> DataFrame:
    typed = {
        "latitude": "decimal(11,7)", "longitude": "decimal(11,7)", "temp_mean_c": "decimal(6,2)",
        "temp_max_c": "decimal(6,2)", "temp_min_c": "decimal(6,2)", "precipitation_mm": "decimal(8,2)",
        "rain_mm": "decimal(8,2)", "wind_speed_max_kmh": "decimal(6,2)", "weather_code": "int",
    }
    source = {
        "temp_mean_c": "temperature_2m_mean", "temp_max_c": "temperature_2m_max", "temp_min_c": "temperature_2m_min",
        "precipitation_mm": "precipitation_sum", "rain_mm": "rain_sum", "wind_speed_max_kmh": "wind_speed_10m_max",
    }
    return raw.select(
        F.upper(F.trim("state")).alias("state"),
        F.to_date("weather_date").alias("weather_date"),
        *[F.col(source.get(c, c)).cast(kind).alias(c) for c, kind in typed.items()],
    )


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The newest review of each order; equal times go to the larger review id."""
    return first_by(reviews, ["order_id"], [F.col("review_created_at").desc(), F.col("review_id").desc()])


def delivery_metrics(df: DataFrame) -> DataFrame:
    """Calendar-day delivery measures, nullable lateness, timeliness band and rank."""
    days_early = F.datediff("estimated_delivery_at", "delivered_to_customer_at")
    label, rank = timeliness("days_early_vs_estimate")
    return df.withColumns(
        {
            "days_to_deliver": F.datediff("delivered_to_customer_at", "ordered_at"),
            "days_early_vs_estimate": days_early,
            "is_late_delivery": F.when(
                F.col("delivered_to_customer_at").isNotNull(),
                F.col("delivered_to_customer_at") > F.col("estimated_delivery_at"),
            ),
        }
    ).withColumns({"delivery_timeliness_band": label, "delivery_timeliness_sort": rank})


def order_line_measures(df: DataFrame) -> DataFrame:
    """Line revenue, header-line flag and delivered flag."""
    return df.withColumns(
        {
            "item_revenue": F.col("item_price") + F.col("freight_value"),
            "is_order_header_line": F.col("order_item_id") == 1,
            "is_delivered": F.col("order_status") == "delivered",
        }
    )


def fct_orders(lines: DataFrame, orders: DataFrame, customers: DataFrame, reviews: DataFrame) -> DataFrame:
    """Order-line fact: one row per source line.

    Everything at order grain (customer, latest review) joins the orders first, which
    are fewer than the lines, so the lines shuffle once, on the order key.
    """
    heads = (
        orders.join(customers.select("customer_id", "customer_state"), "customer_id")
        .join(latest_reviews(reviews).select("order_id", "review_score"), "order_id", "left")
        .withColumn("order_date", F.to_date("ordered_at"))
        .withColumn("weather_key", joined_key("customer_state", F.date_format("order_date", "yyyy-MM-dd")))
    )
    return order_line_measures(delivery_metrics(lines.join(heads, "order_id")))


def fct_order_payments(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Payment fact with the order's date and customer."""
    return payments.join(orders.select("order_id", "customer_id", F.to_date("ordered_at").alias("order_date")), "order_id")


def person_rollup(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders, first and last order time per person."""
    return (
        customers.select("customer_id", "customer_unique_id")
        .join(orders.select("customer_id", "order_id", "ordered_at"), "customer_id")
        .groupBy("customer_unique_id")
        .agg(
            F.countDistinct("order_id").alias("orders_by_person"),
            F.min("ordered_at").alias("first_ordered_at"),
            F.max("ordered_at").alias("last_ordered_at"),
        )
    )


def dim_customers(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customer rows with the measures of the person behind them."""
    n = F.coalesce("orders_by_person", F.lit(0))
    return customers.join(person_rollup(customers, orders), "customer_unique_id", "left").withColumns(
        {"orders_by_person": n, "is_repeat_customer": n > 1}
    )


def dim_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Product attributes with a translated, never-null category and the box volume."""
    name = F.col("product_category_name")
    volume = F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm")
    return products.join(translation, "product_category_name", "left").select(
        "product_id",
        F.coalesce(name, F.lit("unknown")).alias("product_category_name"),
        F.coalesce("product_category_name_english", name, F.lit("unknown")).alias("product_category"),
        name.isNull().alias("is_uncategorised"),
        "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
        volume.alias("product_volume_cm3"),
        "product_photos_qty", "product_name_length", "product_description_length",
    )


def dim_weather(weather: DataFrame) -> DataFrame:
    """Weather by state and day with rain flags and condition group."""
    return weather.withColumns(
        {
            "weather_key": joined_key("state", F.date_format("weather_date", "yyyy-MM-dd")),
            "is_rainy_day": is_rainy("rain_mm"),
            "is_heavy_rain_day": is_rainy("rain_mm", HEAVY_RAIN_MM),
            "weather_condition": weather_condition("weather_code"),
        }
    )
