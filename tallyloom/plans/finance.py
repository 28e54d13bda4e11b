"""Valuation queries: suppliers play companies, their yearly shipments the statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import valuation as v
from tallyloom.plans.registry import query
from tallyloom.session import scratch
from tallyloom.sources import readers
from tallyloom.sources.tables import Tables


def company_years(t: Tables) -> DataFrame:
    """Exact yearly sums per supplier, as doubles."""
    price, rate = F.col("l_extendedprice").cast("decimal(12,2)"), lambda c: F.col(c).cast("decimal(4,2)")
    sums = t.lineitem.groupBy(F.col("l_suppkey").alias("ticker"), F.year("l_shipdate").alias("fiscal_year")).agg(
        F.sum(price).alias("rev"),
        F.sum(price * rate("l_discount")).alias("disc"),
        F.sum(price * rate("l_tax")).alias("tax"),
        F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("qty"),
    )
    return sums.select("ticker", "fiscal_year", *[F.col(c).cast("double").alias(c) for c in ("rev", "disc", "tax", "qty")])


FORMULAS = {
    "Total Revenue": "rev",
    "Cost Of Revenue": "rev * 0.5D + disc",
    "Gross Profit": "rev - (rev * 0.5D + disc)",
    "SG&A": "tax",
    "EBITDA": "rev - (rev * 0.5D + disc) - tax",
    "Depreciation And Amortization": "qty * 10D",
    "EBIT": "rev - (rev * 0.5D + disc) - tax - qty * 10D",
    "Tax Provision": "(rev - (rev * 0.5D + disc) - tax - qty * 10D) * 0.2D",
    "Pretax Income": "rev - (rev * 0.5D + disc) - tax - qty * 10D",
    "Net Income": "(rev - (rev * 0.5D + disc) - tax - qty * 10D) * 0.8D",
    "Capital Expenditure": "-(qty * 8D)",
    "Change In Working Capital": "disc * 0.1D",
    "Current Assets": "rev * 0.3D",
    "Current Liabilities": "rev * 0.2D",
    "Current Debt": "tax * 0.5D",
    "Total Debt": "tax * 2D",
    "Cash And Cash Equivalents": "disc",
}


def statements(t: Tables) -> DataFrame:
    """Long statements; the current debt of the oldest year is not on file."""
    rows = F.array(*[F.struct(F.lit(i).alias("item"), F.expr(f).alias("value")) for i, f in FORMULAS.items()])
    long = company_years(t).select("ticker", "fiscal_year", F.inline(rows))
    return long.filter(~((F.col("item") == "Current Debt") & (F.col("fiscal_year") == 1995)))


def wide(t: Tables) -> DataFrame:
    return v.statement_wide(statements(t))


def companies(t: Tables) -> DataFrame:
    """Market figures per supplier; some have no debt interest on file, one kind no value."""
    bal = F.col("s_acctbal")
    return t.supplier.select(
        F.col("s_suppkey").alias("ticker"),
        (1 + bal / 20000).alias("beta"),
        F.when(bal > 0, bal * 10000).otherwise(F.lit(0.0)).alias("market_cap"),
        F.when(bal > 3000, bal).alias("interest_expense"),
        F.when(bal > -500, F.floor(F.abs(bal)) + 1).otherwise(F.lit(0)).cast("double").alias("shares"),
        (F.abs(bal) + 1).alias("current_price"),
        F.when(bal < 500, "Banks").when(bal < 1000, "Insurance").otherwise("Software").alias("industry"),
        F.when(bal > 9000, "Financial Services").otherwise("Technology").alias("sector"),
    )


def derived(t: Tables) -> DataFrame:
    return t.once("derived", lambda t: v.assumptions(wide(t)).join(companies(t), "ticker"))


def valued(t: Tables) -> DataFrame:
    priced = v.wacc(derived(t))
    return v.dcf(v.flows_of(v.project(v.with_paths(priced))))


def rnd(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


CO_SQL = """cy AS (SELECT l_suppkey AS ticker, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS rev,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS disc,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS tax, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS qty
  FROM lineitem GROUP BY 1, 2),
w0 AS (SELECT *, rev * 0.5::DOUBLE + disc AS cost, rev - (rev * 0.5::DOUBLE + disc) AS gp FROM cy),
w1 AS (SELECT *, gp - tax AS ebitda, qty * 10 AS da, gp - tax - qty * 10 AS ebit, -(qty * 8) AS capex FROM w0),
wd AS (SELECT *, ebit * 0.2::DOUBLE AS taxp, ebit * 0.8::DOUBLE AS ni, disc * 0.1::DOUBLE AS dwc, rev * 0.3::DOUBLE AS ca, rev * 0.2::DOUBLE AS cl,
  CASE WHEN fiscal_year = 1995 THEN 0 ELSE tax * 0.5::DOUBLE END AS cd, tax * 2 AS td,
  rev / lag(rev) OVER (PARTITION BY ticker ORDER BY fiscal_year) - 1 AS growth FROM w1),
co AS (SELECT s_suppkey AS ticker, 1 + s_acctbal / 20000 AS beta, CASE WHEN s_acctbal > 0 THEN s_acctbal * 10000 ELSE 0 END AS market_cap,
  CASE WHEN s_acctbal > 3000 THEN s_acctbal END AS interest_expense, CASE WHEN s_acctbal > -500 THEN floor(abs(s_acctbal)) + 1 ELSE 0 END AS shares,
  abs(s_acctbal) + 1 AS current_price, s_acctbal FROM supplier),
asm AS (SELECT ticker, arg_max(growth, fiscal_year) AS g0, pow(arg_max(rev, fiscal_year) / arg_min(rev, fiscal_year), 1.0 / nullif(count(*) - 1, 0)) - 1 AS cagr,
  arg_max(rev, fiscal_year) AS base, avg(gp / rev) AS gm, avg(tax / rev) AS sga_pct, avg(da / rev) AS da_pct, abs(avg(capex / rev)) AS capex_pct,
  coalesce(avg(taxp / nullif(ebit, 0)), 0) AS tax_rate, avg((ca - disc - (cl - cd)) / rev) AS nwc_pct, arg_max(td, fiscal_year) AS total_debt, arg_max(disc, fiscal_year) AS cash FROM wd GROUP BY 1),
de AS (SELECT asm.*, co.* EXCLUDE (ticker), CASE WHEN gm > 0 THEN gm ELSE 0.45 END AS m0, CASE WHEN gm > 0 THEN least(gm + 0.05, 0.9) ELSE 0.5 END AS m1,
  0.025::DOUBLE AS tg FROM asm JOIN co USING (ticker))"""
PATH_SQL = """yr AS (SELECT unnest(range(8)) AS i),
gr AS (SELECT de.*, i, CASE WHEN i < 3 THEN g0 ELSE g0 + (tg - g0) * ((i - 2) / 5.0) END AS g, m0 + (m1 - m0) * (i / 7.0) AS m FROM de, yr),
rv AS (SELECT *, base * product(1 + g) OVER (PARTITION BY ticker ORDER BY i) AS rev FROM gr),
pj AS (SELECT *, rev * m - rev * sga_pct - rev * da_pct AS ebit, rev - coalesce(lag(rev) OVER (PARTITION BY ticker ORDER BY i), base) AS drev FROM rv),
uf AS (SELECT *, ebit - ebit * tax_rate + rev * da_pct - abs(rev * capex_pct) - drev * nwc_pct AS ufcf FROM pj)"""
WACC_SQL = """wc AS (SELECT *, 0.04 + beta * 0.045 AS ke, coalesce(interest_expense, total_debt * 0.035) AS interest FROM de),
wr AS (SELECT ticker, ke, interest_expense IS NULL AS estimated, CASE WHEN market_cap <> 0 THEN CASE WHEN total_debt = 0 THEN ke ELSE
  market_cap / (market_cap + total_debt) * ke + total_debt / (market_cap + total_debt) * (abs(interest) / total_debt) * (1 - tax_rate) END END AS wacc FROM wc)"""
PV_SQL = """pv AS (SELECT uf.ticker, max(wacc) AS wacc, sum(ufcf / pow(1 + wacc, i + 1)) AS pvf, arg_max(ufcf, i) AS last_f, max(tg) AS tg, max(total_debt) AS debt, max(cash) AS cash,
  max(shares) AS shares, max(current_price) AS current_price FROM uf JOIN wr USING (ticker) GROUP BY 1),
vl AS (SELECT *, pvf + last_f * (1 + tg) / (wacc - tg) / pow(1 + wacc, 8) AS ev FROM pv)"""


@query("fin_statement_wide", f"""WITH {CO_SQL} SELECT ticker, fiscal_year, round(rev, 7) AS total_revenue, round(gp, 7) AS gross_profit, round(ebit, 7) AS ebit, round(cd, 7) AS current_debt,
  round(gp / rev, 8) AS gross_margin, round(ebit / rev, 8) AS ebit_margin, round(ebit * (1 - coalesce(taxp / nullif(ebit, 0), 0)) + da - capex + dwc, 7) AS free_cash_flow FROM wd""")
def fin_statement_wide(t: Tables) -> DataFrame:
    w = wide(t)
    return w.select(
        "ticker", "fiscal_year", *[F.round(c, 7).alias(c) for c in ("total_revenue", "gross_profit", "ebit", "current_debt")],
        F.round("gross_margin", 8).alias("gross_margin"), F.round("ebit_margin", 8).alias("ebit_margin"), F.round("free_cash_flow", 7).alias("free_cash_flow"),
    )


@query("win_stmt_growth", f"WITH {CO_SQL} SELECT ticker, fiscal_year, round(growth, 8) AS revenue_growth FROM wd")
def win_stmt_growth(t: Tables) -> DataFrame:
    return wide(t).select("ticker", "fiscal_year", F.round("revenue_growth", 8).alias("revenue_growth"))


@query("industry_guard", """SELECT s_suppkey AS ticker, s_acctbal < 1000 OR s_acctbal > 9000 AS is_unfriendly FROM supplier""")
def industry_guard(t: Tables) -> DataFrame:
    return v.industry_guard(companies(t)).select("ticker", "is_unfriendly")


@query("agg_ratio_means", f"WITH {CO_SQL} SELECT ticker, round(avg(gp / rev), 8) AS gross_margin, round(coalesce(avg(taxp / nullif(ebit, 0)), 0), 8) AS tax_rate FROM wd GROUP BY 1")
def agg_ratio_means(t: Tables) -> DataFrame:
    return wide(t).groupBy("ticker").agg(
        F.round(v.mean_ratio("gross_profit", "total_revenue"), 8).alias("gross_margin"), F.round(v.mean_ratio("tax_provision", "ebit"), 8).alias("tax_rate")
    )


@query("fin_assumptions", f"""WITH {CO_SQL} SELECT ticker, round(g0, 8) AS latest_growth, round(cagr, 8) AS historical_cagr, round(base, 2) AS base_revenue, round(gm, 8) AS gross_margin, round(sga_pct, 8) AS sga_pct,
  round(da_pct, 8) AS da_pct, round(capex_pct, 8) AS capex_pct, round(tax_rate, 8) AS tax_rate, round(nwc_pct, 8) AS nwc_pct, round(m0, 8) AS margin_start, round(m1, 8) AS margin_target FROM de""")
def fin_assumptions(t: Tables) -> DataFrame:
    names = ["latest_growth", "historical_cagr", "gross_margin", "sga_pct", "da_pct", "capex_pct", "tax_rate", "nwc_pct", "margin_start", "margin_target"]
    return derived(t).select("ticker", F.round("base_revenue", 2).alias("base_revenue"), *[F.round(c, 8).alias(c) for c in names])


@query("fin_growth_path", f"WITH {CO_SQL}, {PATH_SQL} SELECT ticker, CAST(i + 1 AS INTEGER) AS year, round(g, 8) AS growth, round(m, 8) AS gross_margin FROM gr")
def fin_growth_path(t: Tables) -> DataFrame:
    numbered = v.with_paths(derived(t)).select("ticker", F.posexplode("growths").alias("i", "growth"), "margins")
    return numbered.select("ticker", (F.col("i") + 1).alias("year"), F.round("growth", 8).alias("growth"), F.round(F.element_at("margins", F.col("i") + 1), 8).alias("gross_margin"))


@query("fin_projection", f"""WITH {CO_SQL}, {PATH_SQL} SELECT ticker, CAST(i + 1 AS INTEGER) AS year, round(rev, 3) AS revenue, round(rev * m, 3) AS gross_profit, round(ebit, 3) AS ebit, round(ebit - ebit * tax_rate, 3) AS nopat,
  round(ufcf, 3) AS ufcf FROM uf""")
def fin_projection(t: Tables) -> DataFrame:
    rows = v.projection_rows(v.project(v.with_paths(derived(t))), "ticker")
    return rows.select("ticker", "year", *[F.round(c, 3).alias(c) for c in ("revenue", "gross_profit", "ebit", "nopat", "ufcf")])


@query("fin_wacc", f"WITH {CO_SQL}, {WACC_SQL} SELECT ticker, round(ke, 12) AS cost_of_equity, CASE WHEN estimated THEN 'estimated' ELSE 'reported' END AS interest_source, round(wacc, 8) AS wacc FROM wr")
def fin_wacc(t: Tables) -> DataFrame:
    return v.wacc(derived(t)).select("ticker", F.round("cost_of_equity", 12).alias("cost_of_equity"), "interest_source", F.round("wacc", 8).alias("wacc"))


@query("fin_dcf", f"""WITH {CO_SQL}, {PATH_SQL}, {WACC_SQL}, {PV_SQL} SELECT ticker, CASE WHEN shares = 0 THEN 'shares is missing or zero' WHEN wacc <= tg THEN 'wacc must be greater than terminal_growth' END AS dcf_error,
  CASE WHEN shares <> 0 AND wacc > tg THEN round(ev, 2) END AS enterprise_value, CASE WHEN shares <> 0 AND wacc > tg THEN round((ev - debt + cash) / shares, 4) END AS implied_price FROM vl""")
def fin_dcf(t: Tables) -> DataFrame:
    # A company without a market value has no cost of capital and so no value.
    return valued(t).select("ticker", "dcf_error", F.round("enterprise_value", 2).alias("enterprise_value"), F.round("implied_price", 4).alias("implied_price"))


@query("fin_bridge", f"""WITH {CO_SQL}, {PATH_SQL}, {WACC_SQL}, {PV_SQL} SELECT ticker, round(ev, 2) AS enterprise_value, round(-debt, 4) AS less_debt, round(cash, 4) AS plus_cash, round(ev - debt + cash, 2) AS equity_value,
  round((ev - debt + cash) / shares / current_price - 1, 6) AS upside FROM vl WHERE shares <> 0 AND wacc > tg""")
def fin_bridge(t: Tables) -> DataFrame:
    out = v.bridge(valued(t)).filter("dcf_error is null and wacc is not null")
    return out.select(
        "ticker", F.round("enterprise_value", 2).alias("enterprise_value"), F.round("less_debt", 4).alias("less_debt"), F.round("plus_cash", 4).alias("plus_cash"),
        F.round("equity_value", 2).alias("equity_value"), F.round("upside", 6).alias("upside"),
    )


GRID_SQL = """gd AS (SELECT w AS grid_wacc, g AS grid_growth FROM (SELECT unnest([0.08, 0.085, 0.09, 0.095, 0.10, 0.105, 0.11, 0.115, 0.12]::DOUBLE[]) AS w) a,
  (SELECT unnest([0.015, 0.020, 0.025, 0.030, 0.035]::DOUBLE[]) AS g) b),
gp AS (SELECT ticker, grid_wacc, grid_growth, sum(ufcf / pow(1 + grid_wacc, i + 1)) AS pvf, arg_max(ufcf, i) AS lf, max(total_debt) AS debt, max(cash) AS cash, max(shares) AS shares FROM uf, gd GROUP BY 1, 2, 3)"""


@query("fin_sensitivity", f"""WITH {CO_SQL}, {PATH_SQL}, {GRID_SQL} SELECT ticker, grid_wacc, grid_growth,
  CASE WHEN shares <> 0 THEN round((pvf + lf * (1 + grid_growth) / (grid_wacc - grid_growth) / pow(1 + grid_wacc, 8) - debt + cash) / shares, 2) END AS implied_price FROM gp""")
def fin_sensitivity(t: Tables) -> DataFrame:
    base = v.flows_of(v.project(v.with_paths(derived(t))))
    return v.sensitivity_rates(base, ["ticker"])


MARGIN_SQL = """mg AS (SELECT g1, mm FROM (SELECT unnest([0.04, 0.06, 0.08, 0.10, 0.12]::DOUBLE[]) AS g1) a, (SELECT unnest([0.43, 0.45, 0.47, 0.49, 0.51]::DOUBLE[]) AS mm) b),
mr AS (SELECT de.*, g1, mm, i, base * product(1 + CASE WHEN i < 3 THEN g1 ELSE g1 + (tg - g1) * ((i - 2) / 5.0) END) OVER (PARTITION BY ticker, g1, mm ORDER BY i) AS rev FROM de, mg, (SELECT unnest(range(8)) AS i) y),
mp AS (SELECT *, rev * mm - rev * sga_pct - rev * da_pct AS ebit, rev - coalesce(lag(rev) OVER (PARTITION BY ticker, g1, mm ORDER BY i), base) AS drev FROM mr),
mu AS (SELECT mp.*, wacc, ebit - ebit * tax_rate + rev * da_pct - abs(rev * capex_pct) - drev * nwc_pct AS ufcf FROM mp JOIN wr USING (ticker)),
mv AS (SELECT ticker, g1, mm, max(wacc) AS wacc, sum(ufcf / pow(1 + wacc, i + 1)) AS pvf, arg_max(ufcf, i) AS lf, max(tg) AS tg, max(total_debt) AS debt, max(cash) AS cash, max(shares) AS shares FROM mu GROUP BY 1, 2, 3)"""


@query("join_cross_grid", f"""WITH {CO_SQL}, {WACC_SQL}, {MARGIN_SQL} SELECT ticker, g1 AS grid_first_growth, mm AS grid_margin,
  CASE WHEN shares <> 0 AND wacc > tg THEN round((pvf + lf * (1 + tg) / (wacc - tg) / pow(1 + wacc, 8) - debt + cash) / shares, 2) END AS implied_price FROM mv""")
def join_cross_grid(t: Tables) -> DataFrame:
    return v.sensitivity_margins(v.wacc(derived(t)), ["ticker"])


SCENARIOS = [
    {"scenario": "base"},
    {"scenario": "slow", "first_growth": 0.01, "terminal_growth": 0.01},
    {"scenario": "flat", "flat_margin": 0.4, "tax_rate": 0.25},
]


@query("fin_overrides", f"""WITH {CO_SQL}, sc AS (SELECT * FROM (VALUES ('base', NULL, NULL, NULL, NULL), ('slow', 0.01::DOUBLE, 0.01::DOUBLE, NULL, NULL), ('flat', NULL, NULL, 0.4::DOUBLE, 0.25::DOUBLE)) v(scenario, f, tgo, fm, tx)),
yr AS (SELECT unnest(range(8)) AS i),
gr AS (SELECT de.* EXCLUDE (tax_rate), scenario, i, coalesce(tx, tax_rate) AS tax_rate, CASE WHEN f IS NOT NULL THEN f + (tgo - f) * (i / 7.0) WHEN i < 3 THEN g0 ELSE g0 + (tg - g0) * ((i - 2) / 5.0) END AS g,
  coalesce(fm, m0 + (m1 - m0) * (i / 7.0)) AS m FROM de, yr, sc),
rv AS (SELECT *, base * product(1 + g) OVER (PARTITION BY ticker, scenario ORDER BY i) AS rev FROM gr),
pj AS (SELECT *, rev * m - rev * sga_pct - rev * da_pct AS ebit, rev - coalesce(lag(rev) OVER (PARTITION BY ticker, scenario ORDER BY i), base) AS drev FROM rv)
SELECT ticker, scenario, CAST(i + 1 AS INTEGER) AS year, round(rev, 3) AS revenue, round(ebit - ebit * tax_rate + rev * da_pct - abs(rev * capex_pct) - drev * nwc_pct, 3) AS ufcf FROM pj""")
def fin_overrides(t: Tables) -> DataFrame:
    rows = v.projection_rows(v.project(v.overridden(derived(t), SCENARIOS)), "ticker", "scenario")
    return rows.select("ticker", "scenario", "year", F.round("revenue", 3).alias("revenue"), F.round("ufcf", 3).alias("ufcf"))


@query("fin_identity_checks", f"""WITH {CO_SQL}, k AS (SELECT ticker, fiscal_year, rev, CASE WHEN fiscal_year = 1997 THEN cost * 1.2 ELSE cost END AS cost, gp, ebitda, da, CASE WHEN fiscal_year = 1998 THEN 0 WHEN fiscal_year = 1999 THEN ebit * 2 ELSE ebit END AS ebit FROM wd)
SELECT ticker, fiscal_year, 'gross_profit' AS rule, round(rev - cost, 3) AS computed, round(gp, 3) AS reported FROM k WHERE cost <> 0 AND gp <> 0 AND abs(rev - cost - gp) > abs(rev) * 0.01
UNION ALL SELECT ticker, fiscal_year, 'ebit', round(ebitda - abs(da), 3), round(ebit, 3) FROM k WHERE ebit <> 0 AND ebitda <> 0 AND da <> 0 AND abs(ebitda - abs(da) - ebit) > abs(ebitda) * 0.05""")
def fin_identity_checks(t: Tables) -> DataFrame:
    cost, ebit = F.col("cost_of_revenue"), F.col("ebit")
    bent = wide(t).withColumns(
        {
            "cost_of_revenue": F.when(F.col("fiscal_year") == 1997, cost * 1.2).otherwise(cost),
            "ebit": F.when(F.col("fiscal_year") == 1998, F.lit(0.0)).when(F.col("fiscal_year") == 1999, ebit * 2).otherwise(ebit),
        }
    )
    return rnd(v.identity_checks(bent), 3)


def facts(t: Tables) -> DataFrame:
    """Nested fact maps written as JSON text, as they are filed, one row per company.

    Even companies report revenue under a later candidate; the year 2000 was amended.
    """
    def entry(filed: str, value, form: str = "10-K", fp: str = "FY"):
        return F.struct(
            F.col("fiscal_year").alias("fy"), F.lit(fp).alias("fp"), F.lit(form).alias("form"), F.concat(F.col("fiscal_year") + 1, F.lit(filed)).alias("filed"), value.alias("val")
        )

    rev, gp = F.col("rev"), F.expr(FORMULAS["Gross Profit"])
    amended = F.when(F.col("fiscal_year") == 2000, F.array(entry("-03-01", rev), entry("-06-01", rev * 1.1), entry("-02-01", rev * 3))).otherwise(F.array(entry("-03-01", rev), entry("-04-01", rev * 7, "10-Q", "Q1")))
    per_year = company_years(t).select("ticker", amended.alias("r"), F.array(entry("-03-01", gp)).alias("g"))
    # A company files a handful of years.
    packed = per_year.groupBy("ticker").agg(F.flatten(F.collect_list("r")).alias("r"), F.flatten(F.collect_list("g")).alias("g"))

    def units(col):
        return F.struct(F.create_map(F.lit("USD"), col).alias("units"))

    empty = F.filter("r", lambda e: F.lit(False))
    odd = F.create_map(F.lit("Revenues"), units(F.col("r")), F.lit("GrossProfit"), units(F.col("g")))
    even = F.create_map(F.lit("Revenues"), units(empty), F.lit("SalesRevenueNet"), units(F.col("r")))
    text = F.to_json(F.when(F.col("ticker") % 2 == 1, odd).otherwise(even))
    return packed.select("ticker", F.from_json(text, v.FACTS_SCHEMA).alias("facts"))


FACT_SQL = """fa AS (SELECT ticker, fiscal_year, CASE WHEN ticker % 2 = 1 THEN 'Revenues' ELSE 'SalesRevenueNet' END AS concept, CASE WHEN fiscal_year = 2000 THEN rev * 1.1::DOUBLE ELSE rev END AS val FROM wd
  UNION ALL SELECT ticker, fiscal_year, 'GrossProfit', gp FROM wd WHERE ticker % 2 = 1),
lf AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ticker, concept ORDER BY fiscal_year DESC) AS rn FROM fa) x WHERE rn <= 4)"""


@query("src_nested_json", f"WITH {CO_SQL} SELECT ticker, CASE WHEN ticker % 2 = 1 THEN 'Revenues' ELSE 'SalesRevenueNet' END AS concept, count(*) + 2 * count(CASE WHEN fiscal_year = 2000 THEN 1 END) AS entries FROM wd GROUP BY 1 UNION ALL SELECT ticker, 'GrossProfit', count(*) FROM wd WHERE ticker % 2 = 1 GROUP BY 1")
def src_nested_json(t: Tables) -> DataFrame:
    """Fact files as they are landed, one company per line, read with a declared schema."""
    made = facts(t)
    path = scratch(t.spark, "facts")
    made.write.json(path)
    read = readers.nested_facts(t.spark, path).withColumn("ticker", F.col("ticker").cast(made.schema["ticker"].dataType))
    return v.annual_facts(read).groupBy("ticker", "concept").agg(F.count("*").alias("entries"))


@query("win_latest_filed", f"WITH {CO_SQL}, {FACT_SQL} SELECT ticker, concept, fiscal_year, round(val, 3) AS val FROM lf")
def win_latest_filed(t: Tables) -> DataFrame:
    return rnd(v.latest_filed(v.annual_facts(facts(t))).select("ticker", "concept", "fiscal_year", "val"), 3)


@query("fin_concept_priority", f"WITH {CO_SQL}, {FACT_SQL} SELECT ticker, CASE WHEN concept = 'GrossProfit' THEN concept ELSE 'Revenues' END AS field, concept, fiscal_year, round(val, 3) AS val FROM lf")
def fin_concept_priority(t: Tables) -> DataFrame:
    return rnd(v.by_concept_priority(v.latest_filed(v.annual_facts(facts(t)))), 3)


@query("fin_reconcile", f"""WITH {CO_SQL}, {FACT_SQL}, b AS (SELECT ticker, 'Revenues' AS field, fiscal_year, rev AS value FROM wd UNION ALL SELECT ticker, 'GrossProfit', fiscal_year, gp FROM wd),
ex AS (SELECT DISTINCT ticker, field FROM wd, (VALUES ('Revenues'), ('GrossProfit'), ('NetIncome'), ('Cash'), ('CostOfRevenue')) v(field)),
a AS (SELECT ticker, CASE WHEN concept = 'GrossProfit' THEN concept ELSE 'Revenues' END AS field, fiscal_year, val FROM lf)
SELECT ticker, field, fiscal_year, round(abs(val - value) / abs(val), 8) AS pct_diff, CASE WHEN fiscal_year IS NULL THEN 'A_MISSING' WHEN value IS NULL THEN 'B_MISSING' WHEN abs(val - value) / abs(val) <= 0.05 THEN 'MATCH' ELSE 'MISMATCH' END AS status
FROM ex LEFT JOIN a USING (ticker, field) LEFT JOIN b USING (ticker, field, fiscal_year)""")
def fin_reconcile(t: Tables) -> DataFrame:
    a = v.by_concept_priority(v.latest_filed(v.annual_facts(facts(t)))).drop("concept")
    long = statements(t)
    out = v.reconcile(a, long, long.select("ticker").distinct())
    return out.select("ticker", "field", "fiscal_year", F.round("pct_diff", 8).alias("pct_diff"), "status")
