from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import calendar
from tallyloom.operators import filings, loans, marts, metrics, quality
from tallyloom.sources import readers, sinks


def ts(text):
    return None if text is None else datetime.fromisoformat(text)


@pytest.fixture
def star(spark):
    orders = spark.createDataFrame(
        [
            ("o1", "c1", " Delivered", ts("2018-01-01 10:00:00"), None, None, ts("2018-01-11 23:00:00"), ts("2018-01-11 00:00:00")),
            ("o2", "c2", "shipped", ts("2018-01-02 10:00:00"), None, None, None, ts("2018-01-20 00:00:00")),
            ("o3", "c1", "delivered", ts("2018-02-01 00:00:00"), None, None, ts("2018-02-05 00:00:00"), ts("2018-02-20 00:00:00")),
            ("o4", "c3", "canceled", ts("2018-02-01 00:00:00"), None, None, None, None),
        ],
        "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, "
        "order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz",
    )
    lines = spark.createDataFrame(
        [("o1", i, "p1", "s1", ts("2018-01-05 00:00:00"), 10.0, 1.5) for i in (1, 2, 3)] + [("o2", 1, "p2", "s1", None, 5.0, 0.5), ("o3", 1, "p1", "s2", None, 7.0, 0.0)],
        "order_id string, order_item_id int, product_id string, seller_id string, shipping_limit_date timestamp_ntz, price double, freight_value double",
    )
    customers = spark.createDataFrame([("c1", "u1", "123", " sao paulo ", "sp"), ("c2", "u1", "1234567", "rio", "rj"), ("c3", "u3", "1", "x", "mg")], "customer_id string, customer_unique_id string, customer_zip_code_prefix string, customer_city string, customer_state string")
    reviews = spark.createDataFrame(
        [("r1", "o1", 1, "", " ok ", ts("2018-01-12 00:00:00"), None), ("r2", "o1", 5, None, None, ts("2018-01-12 00:00:00"), None)],
        "review_id string, order_id string, review_score int, review_comment_title string, review_comment_message string, review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz",
    )
    return marts.stg_orders(orders), marts.stg_order_items(lines), marts.stg_customers(customers), marts.stg_order_reviews(reviews)


def test_fact_keeps_every_line_and_latest_review(star):
    orders, lines, customers, reviews = star
    fact = marts.fct_orders(lines, orders, customers, reviews)
    assert quality.line_count(fact, lines).count() == 0
    rows = {(r.order_id, r.order_item_id): r for r in fact.collect()}
    first = rows[("o1", 1)]
    assert first.review_score == 5 and first.item_revenue == Decimal("11.50") and first.weather_key == "SP-2018-01-01"
    # Late by hours only: the flag says late, the calendar-day band does not.
    assert first.is_late_delivery is True and first.delivery_timeliness_band == "0-3d early" and first.days_to_deliver == 10
    assert rows[("o2", 1)].is_late_delivery is None and rows[("o2", 1)].delivery_timeliness_band is None
    assert rows[("o3", 1)].delivery_timeliness_sort == 1
    kpi = metrics.revenue_kpis(fact).first()
    assert kpi.total_orders == 3 and kpi.avg_review_score == 5.0
    assert metrics.header_lines(fact).count() == 3


def test_people_and_texts(star):
    orders, _, customers, reviews = star
    dim = {r.customer_id: r for r in marts.dim_customers(customers, orders).collect()}
    assert dim["c1"].orders_by_person == 3 and dim["c2"].is_repeat_customer is True and dim["c3"].orders_by_person == 1
    assert dim["c1"].customer_zip_code_prefix == "00123" and dim["c2"].customer_zip_code_prefix == "1234567" and dim["c1"].customer_city == "Sao Paulo"
    review = {r.review_id: r for r in reviews.collect()}["r1"]
    assert review.review_comment_title is None and review.review_comment_message == "ok"


def test_products_and_payments(spark):
    raw = spark.createDataFrame([("p1", " ", "5", "x", "1", "10", "2", "3", None), ("p2", "moveis", "5", "6", "1", "10", "2", "3", "4")], "product_id string, product_category_name string, product_name_lenght string, product_description_lenght string, product_photos_qty string, product_weight_g string, product_length_cm string, product_height_cm string, product_width_cm string")
    empty = spark.createDataFrame([("other", "Other")], "product_category_name string, product_category_name_english string")
    dim = {r.product_id: r for r in marts.dim_products(marts.stg_products(raw), marts.stg_translation(empty)).collect()}
    assert dim["p1"].product_category == "unknown" and dim["p1"].is_uncategorised and dim["p1"].product_volume_cm3 is None
    assert dim["p2"].product_category == "moveis" and float(dim["p2"].product_volume_cm3) == 24.0
    got = [r[0] for r in spark.createDataFrame([(0,), (None,), (3,)], "n int").select(marts.floor_installments("n")).collect()]
    assert got == [1, None, 3]


def test_top_n_other_keeps_the_total(spark):
    df = spark.createDataFrame([(f"c{i:02d}", float(i)) for i in range(15)] + [("unknown", 999.0)], "label string, v double")
    out = {r.label: r.v for r in metrics.top_n_other(df, "label", "v", 10, unknown="unknown").collect()}
    assert sum(out.values()) == pytest.approx(sum(range(15)) + 999.0) and out["Other (5)"] == 10.0 and len(out) == 12


def test_matched_cells_use_cells_with_both(spark):
    rows = [("a", True, 12.0), ("a", True, 14.0), ("a", False, 10.0), ("b", True, 99.0), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "cell string, wet boolean, v double")
    row = metrics.matched_cells(df, [F.col("cell")], "wet", "v").first()
    assert row.cells == 1 and row.delta == 3.0 and row.effect_pct == pytest.approx(30.0)


def test_retention_collapses_to_years(spark):
    df = spark.createDataFrame([("a", 2020, 1.0), ("a", 2021, 1.0), ("a", 2021, 2.0), ("b", 2021, 0.0)], "org string, fy int, amt double")
    out = {r.fy: r for r in metrics.retention(df, "org", "fy", "amt").collect()}
    assert (out[2021].total_orgs, out[2021].retained) == (1, 1)
    literal = {r.fy: r for r in metrics.retention(df, "org", "fy", "amt", literal=True).collect()}
    assert (literal[2021].total_orgs, literal[2021].retained) == (2, 1)


def test_filings_pad_before_dedupe(spark):
    raw = spark.createDataFrame([("1", "A", "202001"), ("000000001", "B", "202001")], "ein string, name string, tax_period string")
    orgs = filings.dim_organization(raw, ["name"])
    assert orgs.count() == 1 and orgs.first()["name"] == "A"
    with pytest.raises(ValueError):
        filings.tolerant_columns(raw, {"ein": "ein"}, required=("missing",))
    odd = raw.toDF(" EIN ", "Name", "Tax Period")
    assert filings.tolerant_columns(odd, {"ein": "ein", "tax_period": "tp", "none": "x"}).columns == ["ein", "tp"]


def test_impute_and_lump(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None), (10.0, "b"), (4.0, "a")], "n double, c string")
    out = loans.impute(df, ["n"], ["c"]).collect()
    assert sorted(r.n for r in out) == [1.0, 3.0, 3.5, 4.0, 10.0] and sum(r.c == "a" for r in out) == 3
    assert {r.c for r in loans.lump(df, "c", 1).collect()} == {"a", "OTHER"}


def test_dummies_cover_every_level_of_the_orders(spark):
    from types import SimpleNamespace

    from tallyloom.plans.loans import ml_onehot_drop_first

    rows = [(1, "F"), (2, "O"), (3, "P"), (4, "X"), (5, "O"), (6, None)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string")
    got = ml_onehot_drop_first(SimpleNamespace(orders=orders))
    assert got.columns == ["o_orderkey", "o_orderstatus_O", "o_orderstatus_P", "o_orderstatus_X"]
    assert [tuple(r) for r in got.orderBy("o_orderkey").limit(5).collect()] == [(1, 0, 0, 0), (2, 1, 0, 0), (3, 0, 1, 0), (4, 0, 0, 1), (5, 1, 0, 0)]
    assert ml_onehot_drop_first(SimpleNamespace(orders=orders.limit(0))).count() == 0


def test_date_dimensions(spark):
    rows = calendar.date_dim(spark, "2019-12-30", "2020-01-05").orderBy("date_day").collect()
    assert rows[0].week_of_year == 1 and rows[0].day_of_week == 1 and rows[1].is_month_end and str(rows[4].week_start_date) == "2019-12-30"
    ext = calendar.date_dim_ext(spark.createDataFrame([(date(2019, 5, 3), date(2020, 2, 1))], "first_day date, last_day date"))
    assert ext.count() == 365 + 366 + 1
    unknown = ext.filter("date_key = -1").first()
    assert unknown.date_day is None and unknown.day_name == "Unknown" and unknown.is_weekend is False
    assert ext.filter("date_key = 20191230").first().iso_year == 2020


def test_quality_rules(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "z")], "k int, v string")
    assert {r["column"]: r.rows for r in quality.not_null(df, ["k", "v"]).collect()} == {"v": 1}
    assert quality.unique(df, ["k"]).count() == 1
    assert [r.v for r in quality.accepted_values(df, "v", ["a"]).collect()] == ["z"]
    assert quality.relationships(df, "k", spark.createDataFrame([(1,)], "id int"), "id").first().k == 2
    assert quality.share_within(df, F.col("v").isNull(), 0.3, 0.4).count() == 0
    report = {r["check"]: r.outcome for r in quality.report([quality.Check("u", quality.unique(df, ["k"]), "error", 0, 5), quality.Check("n", df.filter("k > 9"))]).collect()}
    assert report == {"u": "warn", "n": "pass"}
    d = spark.createDataFrame([(date(2020, 1, 1),)], "d date")
    assert quality.overlap(d, d, "d", "d").count() == 0 and quality.overlap(d, d.filter("false"), "d", "d").count() == 1


def test_compact_sink_splits_a_hot_date_and_upsert_is_idempotent(spark, scratch_dir):
    rows = spark.range(20_000).withColumn("event_date", F.when(F.col("id") < 18_000, F.lit("2024-01-01")).otherwise(F.lit("2024-01-02")).cast("date"))
    path = f"{scratch_dir}/t"
    sinks.write_compact(rows, path, target_mb=1)
    assert spark.read.parquet(path).count() == 20_000 and sinks.bytes_per_row(spark, path) > 0
    files = spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 4
    daily = spark.createDataFrame([(date(2024, 1, 31), 1), (date(2024, 2, 1), 1)], "date date, n int")
    for _ in range(2):
        sinks.upsert_daily(daily, f"{scratch_dir}/u")
    sinks.upsert_daily(daily.filter("n = 1 and date > date'2024-01-31'").withColumn("n", F.lit(9)), f"{scratch_dir}/u")
    assert sorted((str(r.date), r.n) for r in spark.read.parquet(f"{scratch_dir}/u").collect()) == [("2024-01-31", 1), ("2024-02-01", 9)]


def test_csv_null_empty_and_union(spark, scratch_dir):
    with open(f"{scratch_dir}/a.csv", "w") as f:
        f.write('id,note\n1,\\N\n2,""\n3,"two\nlines ""quoted"""\n')
    rows = {r.id: r.note for r in readers.csv_null_vs_empty(spark, f"{scratch_dir}/a.csv", "id int, note string").collect()}
    assert rows[1] is None and rows[2] == "" and rows[3] == 'two\nlines "quoted"'
    with open(f"{scratch_dir}/b.csv", "w") as f:
        f.write("other\n1\n")
    assert readers.csv_union(spark, [f"{scratch_dir}/a.csv", f"{scratch_dir}/b.csv"], ["id"]).columns == ["id", "note"]


def test_row_rules_ride_on_the_write(spark, scratch_dir):
    from tallyloom.operators import quality

    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None), (40, "z")], "n int, s string")
    rules = [*quality.null_rules(["n", "s"], "warn"), quality.RowRule("small", F.col("n") > 10), quality.RowRule("known", ~F.col("s").isin("a", "b", "z"))]
    writes = []

    def write(frame):
        writes.append(1)
        frame.write.parquet(f"{scratch_dir}/out")

    got = [tuple(r) for r in quality.write_observed(df, write, rules).collect()]
    assert got == [("n is present", "warn", 4, 1, "warn"), ("s is present", "warn", 4, 1, "warn"), ("small", "error", 4, 1, "error"), ("known", "error", 4, 0, "pass")]
    assert writes == [1] and spark.read.parquet(f"{scratch_dir}/out").count() == 4
    empty = quality.write_observed(df.limit(0), lambda frame: frame.write.parquet(f"{scratch_dir}/none"), rules)
    assert {(r.rows, r.failing, r.outcome) for r in empty.collect()} == {(0, 0, "pass")}
