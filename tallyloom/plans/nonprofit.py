"""Filing-star queries: orders play filings, customers the organisations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import fiscal_period
from tallyloom.operators import filings, metrics
from tallyloom.plans.registry import query
from tallyloom.plans.shop import plain
from tallyloom.sources.tables import Tables

ORG_COLUMNS = {"ein": "ein", "organization_name": "name", "state": "state", "ntee_code": "ntee_code", "ruling_date": "ruling_date"}
FACT_COLUMNS = {
    "ein": "ein", "tax_period": "tax_period", "total_revenue": "total_revenue", "total_expenses": "total_expenses",
    "contributions_and_grants": "contributions", "program_service_revenue": "program_revenue",
    "investment_income": "investment_income", "total_compensation": "total_compensation", "net_assets": "net_assets",
}
AMOUNTS = ["total_revenue", "total_expenses", "contributions", "program_revenue", "investment_income", "total_compensation"]


def raw_filings(t: Tables) -> DataFrame:
    """Extract-shaped rows: odd headers, text amounts, two optional columns missing."""
    cents = F.col("o_totalprice").cast("decimal(15,2)")
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_custkey").alias("EIN"),
        F.col("c_name").alias("Organization Name"),
        F.col("c_nationkey").cast("string").alias("State "),
        F.concat(F.substring("c_mktsegment", 1, 1), F.lit("20")).alias("NTEE_Code"),
        F.date_format("o_orderdate", "yyyyMM").alias("Tax Period"),
        cents.cast("string").alias("Total Revenue"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("0")).otherwise((cents * 2).cast("string")).alias("Total Expenses"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("n/a"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("0"))
        .otherwise(cents.cast("string"))
        .alias("Contributions and Grants"),
        cents.cast("string").alias("Program Service Revenue"),
        F.lit("10.50").alias("Investment Income"),
        F.lit("1000").alias("Total Compensation"),
    )


def tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    raw = raw_filings(t)
    orgs = filings.dim_organization(filings.tolerant_columns(raw, ORG_COLUMNS), ["name", "state", "ntee_code"])
    rows = filings.tolerant_columns(raw, FACT_COLUMNS, required=("tax_period",))
    years = filings.dim_fiscal_year(rows)
    return filings.fact_filing(rows, orgs, years, AMOUNTS), orgs, years


def star(t: Tables) -> DataFrame:
    return filings.star(*tables(t))


FIL_SQL = """fi AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS ein, c_name AS name, CAST(c_nationkey AS VARCHAR) AS state, substr(c_mktsegment, 1, 1) || '20' AS ntee_code,
  strftime(o_orderdate, '%Y%m') AS tax_period, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CAST(month(o_orderdate) AS INTEGER) AS fiscal_month,
  CAST(o_totalprice AS DECIMAL(15,2)) AS total_revenue, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE CAST(o_totalprice AS DECIMAL(15,2)) * 2 END AS total_expenses,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderpriority = '2-HIGH' THEN 0 ELSE CAST(o_totalprice AS DECIMAL(15,2)) END AS contributions,
  CAST(o_totalprice AS DECIMAL(15,2)) AS program_revenue, CAST(10.50 AS DECIMAL(15,2)) AS investment_income FROM orders JOIN customer ON c_custkey = o_custkey)"""


@query("src_tolerant_cols", f"WITH {FIL_SQL} SELECT state, ntee_code, count(*) AS n, count(DISTINCT ein) AS orgs FROM fi GROUP BY 1, 2")
def src_tolerant_cols(t: Tables) -> DataFrame:
    found = filings.tolerant_columns(raw_filings(t), ORG_COLUMNS)
    return found.groupBy("state", "ntee_code").agg(F.count("*").alias("n"), F.countDistinct("ein").alias("orgs"))


@query("fiscal_period_split", f"WITH {FIL_SQL} SELECT fiscal_year, fiscal_month, count(*) AS n FROM fi GROUP BY 1, 2")
def fiscal_period_split(t: Tables) -> DataFrame:
    year, month = fiscal_period(F.col("Tax Period"))
    return raw_filings(t).groupBy(year.alias("fiscal_year"), month.alias("fiscal_month")).agg(F.count("*").alias("n"))


@query("join_key_resolution", f"WITH {FIL_SQL} SELECT count(*) AS filings, count(DISTINCT ein) AS orgs, count(DISTINCT tax_period) AS periods, count(contributions) AS numeric_contributions FROM fi")
def join_key_resolution(t: Tables) -> DataFrame:
    fact, _, _ = tables(t)
    return fact.agg(
        F.count("*").alias("filings"), F.countDistinct("org_key").alias("orgs"), F.countDistinct("fy_key").alias("periods"), F.count("contributions").alias("numeric_contributions")
    )


@query("join_star3", f"WITH {FIL_SQL} SELECT ein, name, tax_period, fiscal_year, CAST(total_revenue AS DOUBLE) AS total_revenue, CAST(contributions AS DOUBLE) AS contributions FROM fi")
def join_star3(t: Tables) -> DataFrame:
    return plain(star(t).select("ein", "name", "tax_period", "fiscal_year", "total_revenue", "contributions"))


YOY_SQL = f"""{FIL_SQL}, yy AS (SELECT state, fiscal_year, count(DISTINCT ein) AS num_orgs, sum(contributions) AS total, CAST(sum(contributions) AS DOUBLE) / count(contributions) AS average FROM fi GROUP BY 1, 2)"""


@query("agg_yoy_state", f"WITH {YOY_SQL} SELECT state, fiscal_year, num_orgs, CAST(total AS DOUBLE) AS total, average FROM yy")
def agg_yoy_state(t: Tables) -> DataFrame:
    return plain(metrics.yoy_by(star(t), "state", "fiscal_year", "ein", "contributions").drop("yoy_change"))


@query("win_lag_agg", f"""WITH {YOY_SQL} SELECT state, fiscal_year, CAST(total - lag(total) OVER (PARTITION BY state ORDER BY fiscal_year) AS DOUBLE) AS yoy_change FROM yy""")
def win_lag_agg(t: Tables) -> DataFrame:
    return plain(metrics.yoy_by(star(t), "state", "fiscal_year", "ein", "contributions").select("state", "fiscal_year", "yoy_change"))


@query("win_lag_year", f"""WITH {FIL_SQL} SELECT ein, fiscal_year, lag(fiscal_year) OVER (PARTITION BY ein ORDER BY fiscal_year) AS prev_year FROM (SELECT DISTINCT ein, fiscal_year FROM fi) d""")
def win_lag_year(t: Tables) -> DataFrame:
    return metrics.previous_active_year(star(t), "ein", "fiscal_year")


RETAIN = """count(*) AS total_orgs, count(CASE WHEN prev = fiscal_year - 1 THEN 1 END) AS retained,
  round(100.0 * count(CASE WHEN prev = fiscal_year - 1 THEN 1 END) / count(*), 1) AS retention_pct"""


@query("agg_retention", f"""WITH {FIL_SQL}, d AS (SELECT DISTINCT ein, fiscal_year FROM fi WHERE contributions > 0),
y AS (SELECT *, lag(fiscal_year) OVER (PARTITION BY ein ORDER BY fiscal_year) AS prev FROM d) SELECT fiscal_year, {RETAIN} FROM y GROUP BY 1""")
def agg_retention(t: Tables) -> DataFrame:
    return plain(metrics.retention(star(t), "ein", "fiscal_year", "contributions"))


@query("agg_retention_literal", f"""WITH {FIL_SQL}, y AS (SELECT ein, fiscal_year, lag(fiscal_year) OVER (PARTITION BY ein ORDER BY fiscal_year) AS prev FROM fi WHERE contributions > 0)
SELECT fiscal_year, {RETAIN} FROM y GROUP BY 1""")
def agg_retention_literal(t: Tables) -> DataFrame:
    """One row per filing, as the original report counts."""
    return plain(metrics.retention(star(t), "ein", "fiscal_year", "contributions", literal=True))


@query("flt_contributions", f"WITH {FIL_SQL} SELECT state, count(*) AS n, CAST(sum(contributions) AS DOUBLE) AS total FROM fi WHERE contributions > 0 AND total_revenue > 250000 GROUP BY 1")
def flt_contributions(t: Tables) -> DataFrame:
    kept = star(t).filter((F.col("contributions") > 0) & (F.col("total_revenue") > 250_000))
    return plain(kept.groupBy("state").agg(F.count("*").alias("n"), F.sum("contributions").alias("total")))


@query("agg_revenue_mix", f"""WITH {FIL_SQL} SELECT left(ntee_code, 1) AS category, fiscal_year, CAST(sum(contributions) AS DOUBLE) AS contributions, CAST(sum(program_revenue) AS DOUBLE) AS program_revenue,
  CAST(sum(investment_income) AS DOUBLE) AS investment_income, round(100.0 * CAST(sum(contributions) AS DOUBLE) / nullif(CAST(sum(total_revenue) AS DOUBLE), 0), 1) AS part_pct FROM fi GROUP BY 1, 2""")
def agg_revenue_mix(t: Tables) -> DataFrame:
    return plain(metrics.revenue_mix(star(t), "ntee_code", "fiscal_year", ["contributions", "program_revenue", "investment_income"], "contributions", "total_revenue"))


@query("compensation_ratio", f"""WITH {FIL_SQL} SELECT ein, fiscal_year, tax_period, CAST(total_revenue AS DOUBLE) AS total_revenue, CAST(total_expenses AS DOUBLE) AS total_expenses,
  CASE WHEN total_expenses > 0 THEN round(1000.0::DOUBLE * 100 / CAST(total_expenses AS DOUBLE), 1) END AS compensation_pct FROM fi WHERE total_revenue > 400000""")
def compensation_ratio(t: Tables) -> DataFrame:
    amounts = plain(star(t))
    out = metrics.compensation_ratio(amounts, "total_compensation", "total_expenses", "total_revenue", 400_000).orderBy(F.desc("contributions"), "ein")
    return out.select("ein", "fiscal_year", "tax_period", "total_revenue", "total_expenses", "compensation_pct")
