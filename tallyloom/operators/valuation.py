"""Company statements, assumptions, projections and valuation.

A projection has one entry per future year, so it lives in an array inside the
company's row: projecting, discounting and running scenario grids need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.ordered import first_by, top_by

# Fixed values.
ITEMS = (
    "Total Revenue", "Cost Of Revenue", "Gross Profit", "EBITDA", "EBIT", "Tax Provision", "Pretax Income", "Net Income",
    "SG&A", "Capital Expenditure", "Depreciation And Amortization", "Change In Working Capital", "Current Assets",
    "Current Liabilities", "Current Debt", "Total Debt", "Cash And Cash Equivalents",
)
PROJECTION_YEARS = 8
HOLD_YEARS = 3
TERMINAL_GROWTH = 0.025
TERMINAL_CAP = 0.04
MARGIN_START = 0.45
MARGIN_TARGET = 0.50
RISK_FREE = 0.04
EQUITY_PREMIUM = 0.045
DEBT_COST_ESTIMATE = 0.035
WACC_GRID = (0.08, 0.085, 0.09, 0.095, 0.10, 0.105, 0.11, 0.115, 0.12)
TERMINAL_GRID = (0.015, 0.020, 0.025, 0.030, 0.035)
GROWTH_GRID = (0.04, 0.06, 0.08, 0.10, 0.12)
MARGIN_GRID = (0.43, 0.45, 0.47, 0.49, 0.51)
UNFRIENDLY_INDUSTRIES = (
    "banks", "insurance", "reits", "real estate investment trusts", "diversified banks", "regional banks",
    "thrifts & mortgage finance", "life & health insurance", "property & casualty insurance", "multi-line insurance",
    "reinsurance", "mortgage reits",
)
CONCEPTS = {
    "Revenues": (
        "Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
    ),
    "CostOfRevenue": ("CostOfRevenue", "CostOfGoodsAndServicesSold"),
    "GrossProfit": ("GrossProfit",),
    "OperatingIncome": ("OperatingIncomeLoss",),
    "NetIncome": ("NetIncomeLoss",),
    "InterestExpense": ("InterestExpense", "InterestExpenseDebt"),
    "TotalAssets": ("Assets",),
    "TotalDebt": ("LongTermDebt", "LongTermDebtAndCapitalLeaseObligations"),
    "Cash": ("CashAndCashEquivalentsAtCarryingValue",),
    "TotalLiabilities": ("Liabilities",),
    "OperatingCashFlow": ("NetCashProvidedByOperatingActivities",),
    "CapEx": ("PaymentsToAcquirePropertyPlantAndEquipment",),
    "DepreciationAmortization": ("DepreciationDepletionAndAmortization",),
}
RECONCILED = {
    "Revenues": "Total Revenue",
    "GrossProfit": "Gross Profit",
    "NetIncome": "Net Income",
    "Cash": "Cash And Cash Equivalents",
    "CostOfRevenue": "Cost Of Revenue",
}
FACTS_SCHEMA = "map<string, struct<units: map<string, array<struct<fy: int, fp: string, form: string, filed: string, val: double>>>>>"


def snake(item: str) -> str:
    return item.lower().replace("&", "").replace(" ", "_")


# --- statements ----------------------------------------------------------------------------------


def statement_wide(long: DataFrame, items: tuple[str, ...] = ITEMS) -> DataFrame:
    """``(ticker, fiscal_year, item, value)`` to one row per company-year with margins, cash flow and growth.

    A missing item counts as 0. Growth looks at the company's previous year on file.
    """
    wide = long.groupBy("ticker", "fiscal_year").pivot("item", list(items)).agg(F.first("value"))
    wide = wide.select("ticker", "fiscal_year", *[F.coalesce(F.col(f"`{i}`"), F.lit(0.0)).alias(snake(i)) for i in items])
    rate = F.coalesce(F.try_divide("tax_provision", "pretax_income"), F.lit(0.0))
    years = Window.partitionBy("ticker").orderBy("fiscal_year")
    before = F.lag("total_revenue").over(years)
    return wide.withColumns(
        {
            "gross_margin": F.coalesce(F.try_divide("gross_profit", "total_revenue"), F.lit(0.0)),
            "ebit_margin": F.coalesce(F.try_divide("ebit", "total_revenue"), F.lit(0.0)),
            "free_cash_flow": F.col("ebit") * (1 - rate)
            + F.col("depreciation_and_amortization")
            - F.col("capital_expenditure")
            + F.col("change_in_working_capital"),
            "revenue_growth": F.try_divide(F.col("total_revenue") - before, before),
        }
    )


def industry_guard(companies: DataFrame) -> DataFrame:
    """Flags industries and the sector the cash-flow model does not suit."""
    flagged = F.lower("industry").isin(*UNFRIENDLY_INDUSTRIES) | (F.lower("sector") == "financial services")
    return companies.withColumn("is_unfriendly", F.coalesce(flagged, F.lit(False)))


def mean_ratio(part: Column | str, whole: Column | str) -> Column:
    """Mean of yearly ratios over usable denominators, 0 without any."""
    p, w = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.coalesce(F.avg(F.try_divide(p, w)), F.lit(0.0))


def assumptions(wide: DataFrame, terminal_growth: float = TERMINAL_GROWTH) -> DataFrame:
    """Growth, margins and cost ratios per company, derived from its statements."""
    nwc = F.col("current_assets") - F.col("cash_and_cash_equivalents") - (F.col("current_liabilities") - F.col("current_debt"))
    first, last = F.min_by("total_revenue", "fiscal_year"), F.max_by("total_revenue", "fiscal_year")
    base = wide.groupBy("ticker").agg(
        F.max_by("revenue_growth", "fiscal_year").alias("latest_growth"),
        (F.pow(F.try_divide(last, first), F.try_divide(F.lit(1.0), F.count("*") - 1)) - 1).alias("historical_cagr"),
        last.alias("base_revenue"),
        mean_ratio("gross_profit", "total_revenue").alias("gross_margin"),
        mean_ratio("sga", "total_revenue").alias("sga_pct"),
        mean_ratio("depreciation_and_amortization", "total_revenue").alias("da_pct"),
        F.abs(mean_ratio("capital_expenditure", "total_revenue")).alias("capex_pct"),
        mean_ratio("tax_provision", "ebit").alias("tax_rate"),
        mean_ratio(nwc, "total_revenue").alias("nwc_pct"),
        F.max_by("total_debt", "fiscal_year").alias("total_debt"),
        F.max_by("cash_and_cash_equivalents", "fiscal_year").alias("cash"),
    )
    known = F.col("gross_margin") > 0
    return base.withColumns(
        {
            "margin_start": F.when(known, F.col("gross_margin")).otherwise(F.lit(MARGIN_START)),
            "margin_target": F.when(known, F.least(F.col("gross_margin") + 0.05, F.lit(0.90))).otherwise(F.lit(MARGIN_TARGET)),
            "terminal_growth": F.least(F.lit(terminal_growth), F.lit(TERMINAL_CAP)),
        }
    )


def growth_path(latest: Column, terminal: Column, years: int = PROJECTION_YEARS, hold: int = HOLD_YEARS) -> Column:
    """Array of yearly growth: held, then a straight fade that ends on the terminal rate."""
    fade = years - hold
    return F.transform(
        F.sequence(F.lit(0), F.lit(years - 1)),
        lambda i: F.when(i < hold, latest).otherwise(latest + (terminal - latest) * ((i - hold + 1) / F.lit(float(fade)))),
    )


def linear_path(first: Column, last: Column, years: int = PROJECTION_YEARS) -> Column:
    """Array of ``years`` values on the line from ``first`` to ``last``."""
    return F.transform(F.sequence(F.lit(0), F.lit(years - 1)), lambda i: first + (last - first) * (i / F.lit(float(max(years - 1, 1)))))


def with_paths(derived: DataFrame) -> DataFrame:
    """Adds the growth and margin arrays of the base case."""
    return derived.withColumns(
        {
            "growths": growth_path(F.col("latest_growth"), F.col("terminal_growth")),
            "margins": linear_path(F.col("margin_start"), F.col("margin_target")),
        }
    )


def project(df: DataFrame) -> DataFrame:
    """Adds ``projection``, an array of yearly figures up to the unlevered free cash flow."""
    factors = F.transform(
        F.sequence(F.lit(1), F.size("growths")),
        lambda n: F.aggregate(F.slice("growths", F.lit(1), n), F.lit(1.0), lambda acc, g: acc * (1 + g)),
    )
    grown = df.withColumn("_rev", F.transform(factors, lambda f: F.col("base_revenue") * f))

    def year(i: Column) -> Column:
        revenue, growth, margin = (F.element_at(c, i + 1) for c in ("_rev", "growths", "margins"))
        previous = F.when(i == 0, F.col("base_revenue")).otherwise(F.element_at("_rev", F.greatest(i, F.lit(1))))
        gross = revenue * margin
        sga, da = revenue * F.col("sga_pct"), revenue * F.col("da_pct")
        ebit = gross - sga - da
        tax = ebit * F.col("tax_rate")
        capex = -revenue * F.col("capex_pct")
        nwc = (revenue - previous) * F.col("nwc_pct")
        return F.struct(
            (i + 1).alias("year"),
            revenue.alias("revenue"),
            growth.alias("growth"),
            margin.alias("gross_margin"),
            gross.alias("gross_profit"),
            sga.alias("sga"),
            da.alias("da"),
            (gross - sga).alias("ebitda"),
            ebit.alias("ebit"),
            F.coalesce(F.try_divide(ebit, revenue), F.lit(0.0)).alias("ebit_margin"),
            tax.alias("tax"),
            (ebit - tax).alias("nopat"),
            capex.alias("capex"),
            nwc.alias("change_nwc"),
            (ebit - tax + da - F.abs(capex) - nwc).alias("ufcf"),
        )

    years = F.sequence(F.lit(0), F.size("_rev") - 1)
    return grown.withColumn("projection", F.transform(years, year)).drop("_rev")


def projection_rows(projected: DataFrame, *keys: str) -> DataFrame:
    """One row per key and projected year."""
    return projected.select(*keys, F.inline("projection"))


# --- valuation -----------------------------------------------------------------------------------


def wacc(companies: DataFrame, risk_free: float = RISK_FREE, premium: float = EQUITY_PREMIUM) -> DataFrame:
    """Cost of capital per company.

    ``companies`` has beta, market_cap, total_debt, interest_expense and tax_rate. Unknown
    interest is estimated from the debt; without debt the cost is the cost of equity;
    without a market value there is an ``error``.
    """
    debt = F.col("total_debt")
    equity_cost = F.lit(risk_free) + F.coalesce("beta", F.lit(1.0)) * premium
    interest = F.coalesce("interest_expense", debt * DEBT_COST_ESTIMATE)
    has_value = F.coalesce(F.col("market_cap") != 0, F.lit(False))
    has_debt = debt != 0
    capital = F.col("market_cap") + debt
    out = companies.withColumns(
        {
            "cost_of_equity": equity_cost,
            "interest_source": F.when(F.col("interest_expense").isNull(), "estimated").otherwise("reported"),
            "cost_of_debt": F.when(has_debt, F.try_divide(F.abs(interest), debt)).otherwise(F.lit(0.0)),
            "equity_weight": F.when(has_debt, F.try_divide("market_cap", capital)).otherwise(F.lit(1.0)),
            "debt_weight": F.when(has_debt, F.try_divide(debt, capital)).otherwise(F.lit(0.0)),
            "error": F.when(~has_value, "market_cap is missing or zero"),
        }
    )
    blended = F.col("equity_weight") * F.col("cost_of_equity") + F.col("debt_weight") * F.col("cost_of_debt") * (1 - F.col("tax_rate"))
    return out.withColumn("wacc", F.when(has_value, F.when(has_debt, blended).otherwise(F.col("cost_of_equity"))))


def dcf_columns(flows: Column, rate: Column, growth: Column, debt: Column, cash: Column, shares: Column) -> dict[str, Column]:
    """Value of an array of yearly flows. An unusable rate or share count gives an error and nulls."""
    error = F.when(F.coalesce(shares, F.lit(0)) == 0, "shares is missing or zero").when(
        rate <= growth, "wacc must be greater than terminal_growth"
    )
    usable = error.isNull()
    n = F.size(flows)
    present = F.aggregate(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(flows, i) / F.pow(1 + rate, i)), F.lit(0.0), lambda a, x: a + x
    )
    terminal = F.try_divide(F.element_at(flows, -1) * (1 + growth), rate - growth)
    pv_terminal = terminal / F.pow(1 + rate, n)
    enterprise = present + pv_terminal
    equity = enterprise - debt + cash
    values = {
        "pv_flows": present,
        "terminal_value": terminal,
        "pv_terminal": pv_terminal,
        "enterprise_value": enterprise,
        "equity_value": equity,
        "implied_price": F.try_divide(equity, shares),
    }
    return {name: F.when(usable, value) for name, value in values.items()} | {"dcf_error": error}


def dcf(df: DataFrame, flows: str = "flows", rate: str = "wacc", growth: str = "terminal_growth") -> DataFrame:
    """Adds the valuation of each row's flows; needs total_debt, cash and shares beside them."""
    return df.withColumns(dcf_columns(F.col(flows), F.col(rate), F.col(growth), F.col("total_debt"), F.col("cash"), F.col("shares")))


def flows_of(projected: DataFrame) -> DataFrame:
    return projected.withColumn("flows", F.transform("projection", lambda y: y["ufcf"]))


def dcf_over_flows(flow_rows: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Valuation of flow rows ``(keys, year, ufcf)`` joined to parameters by key; a company has few years."""
    packed = flow_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("year", "ufcf"))).alias("_f"))
    joined = params.join(packed, keys)
    return dcf(joined.withColumn("flows", F.transform("_f", lambda s: s["ufcf"])).drop("_f"))


def _grid(a: str, first: tuple[float, ...], b: str, second: tuple[float, ...]) -> Column:
    cells = [F.struct(F.lit(x).alias(a), F.lit(y).alias(b)) for x in first for y in second]
    return F.inline(F.array(*cells))


def sensitivity_rates(valued: DataFrame, keep: list[str], rates=WACC_GRID, growths=TERMINAL_GRID) -> DataFrame:
    """Price per share for every (rate, terminal growth); the grid is literal, not a joined table."""
    cells = valued.select(*keep, "flows", "total_debt", "cash", "shares", _grid("grid_wacc", rates, "grid_growth", growths))
    out = dcf(cells, "flows", "grid_wacc", "grid_growth")
    return out.select(*keep, "grid_wacc", "grid_growth", F.round("implied_price", 2).alias("implied_price"))


def sensitivity_margins(derived: DataFrame, keep: list[str], growths=GROWTH_GRID, margins=MARGIN_GRID) -> DataFrame:
    """Price per share for every (first growth, flat gross margin), each cell projected anew."""
    cells = derived.select("*", _grid("grid_first_growth", growths, "grid_margin", margins))
    cells = cells.withColumns(
        {
            "growths": growth_path(F.col("grid_first_growth"), F.col("terminal_growth")),
            "margins": F.array_repeat("grid_margin", PROJECTION_YEARS),
        }
    )
    out = dcf(flows_of(project(cells)))
    return out.select(*keep, "grid_first_growth", "grid_margin", F.round("implied_price", 2).alias("implied_price"))


def overridden(derived: DataFrame, scenarios: list[dict]) -> DataFrame:
    """Each company under each scenario.

    A scenario names any of terminal_growth, first_growth, flat_margin, sga_pct, da_pct,
    capex_pct, tax_rate, nwc_pct. A first-year growth replaces the path by a straight
    line to the terminal rate; a flat margin replaces the ramp.
    """
    names = ("terminal_growth", "first_growth", "flat_margin", "sga_pct", "da_pct", "capex_pct", "tax_rate", "nwc_pct")
    rows = [
        F.struct(F.lit(s["scenario"]).alias("scenario"), *[F.lit(s.get(n)).cast("double").alias(f"_{n}") for n in names])
        for s in scenarios
    ]
    crossed = with_paths(derived).select("*", F.inline(F.array(*rows)))
    plain = [n for n in names if n not in ("first_growth", "flat_margin")]
    replaced = crossed.withColumns({n: F.coalesce(f"_{n}", n) for n in plain})
    line = linear_path(F.col("_first_growth"), F.col("terminal_growth"))
    return replaced.withColumns(
        {
            "growths": F.when(F.col("_first_growth").isNotNull(), line).otherwise(F.col("growths")),
            "margins": F.when(F.col("_flat_margin").isNotNull(), F.array_repeat("_flat_margin", PROJECTION_YEARS)).otherwise(F.col("margins")),
        }
    ).drop(*[f"_{n}" for n in names])


def bridge(valued: DataFrame, price: str = "current_price") -> DataFrame:
    """From enterprise value to equity per share, and the upside on the current price."""
    return valued.withColumns(
        {
            "less_debt": -F.col("total_debt"),
            "plus_cash": F.col("cash"),
            "upside": F.try_divide("implied_price", price) - 1,
        }
    )


# --- checks --------------------------------------------------------------------------------------


def identity_checks(wide: DataFrame) -> DataFrame:
    """Failing accounting identities ``(ticker, fiscal_year, rule, computed, reported)``.

    Zero counts as not reported, so a rule with a zero input is not applied.
    """

    def given(name: str) -> Column:
        return F.when(F.col(name) != 0, F.col(name))

    revenue, cost, gross = given("total_revenue"), given("cost_of_revenue"), given("gross_profit")
    ebitda, da, ebit = given("ebitda"), given("depreciation_and_amortization"), given("ebit")
    rules = [
        ("gross_profit", revenue - cost, gross, F.abs(revenue - cost - gross) > F.abs(revenue) * 0.01),
        ("negative_revenue", F.lit(0.0), revenue, revenue < 0),
        ("ebit", ebitda - F.abs(da), ebit, F.abs(ebitda - F.abs(da) - ebit) > F.abs(ebitda) * 0.05),
    ]
    found = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), computed.alias("computed"), reported.alias("reported"), broken.alias("broken"))
            for name, computed, reported, broken in rules
        ]
    )
    return wide.select("ticker", "fiscal_year", F.inline(found)).filter("broken").drop("broken")


def annual_facts(facts: DataFrame, column: str = "facts") -> DataFrame:
    """Annual dollar entries ``(ticker, concept, fiscal_year, filed, seq, val)`` of nested fact maps."""
    per_concept = facts.select("ticker", F.explode(column).alias("concept", "c"))
    entries = per_concept.select("ticker", "concept", F.posexplode(F.col("c.units")["USD"]).alias("seq", "e"))
    return entries.filter("e.form = '10-K' and e.fp = 'FY' and e.fy is not null").select(
        "ticker", "concept", F.col("e.fy").alias("fiscal_year"), F.col("e.filed").alias("filed"), "seq", F.col("e.val").alias("val")
    )


def latest_filed(entries: DataFrame, n_years: int = 4) -> DataFrame:
    """Per concept and year the value filed last (ties: first listed), newest ``n_years`` years."""
    newest = first_by(entries, ["ticker", "concept", "fiscal_year"], [F.desc("filed"), F.asc("seq")])
    return top_by(newest, ["ticker", "concept"], [F.desc("fiscal_year")], n_years)


def by_concept_priority(annual: DataFrame, concepts: dict[str, tuple[str, ...]] = CONCEPTS) -> DataFrame:
    """For each field the values of its first candidate concept that has any."""
    ranks = [
        F.struct(F.lit(concept).alias("concept"), F.lit(field).alias("field"), F.lit(i).alias("priority"))
        for field, candidates in concepts.items()
        for i, concept in enumerate(candidates)
    ]
    listed = annual.sparkSession.range(1).select(F.inline(F.array(*ranks)))
    # The concept list is a fixed value of some twenty rows.
    named = annual.join(F.broadcast(listed), "concept")
    best = named.groupBy("ticker", "field").agg(F.min("priority").alias("priority"))
    return named.join(best, ["ticker", "field", "priority"]).select("ticker", "field", "concept", "fiscal_year", "val")


def reconcile(
    a: DataFrame, b: DataFrame, companies: DataFrame, fields: dict[str, str] | None = None, tolerance: float = 0.05
) -> DataFrame:
    """Compares two sources per company, field and year.

    ``a(ticker, field, fiscal_year, val)``, ``b(ticker, item, fiscal_year, value)``. A field the first source
    lacks gives one ``A_MISSING`` row; a year the second lacks gives ``B_MISSING``.
    """
    fields = fields or RECONCILED
    pairs = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("item")) for f, i in fields.items()]))
    expected = companies.select("ticker", pairs)
    left = expected.join(a, ["ticker", "field"], "left")
    both = left.join(b, ["ticker", "item", "fiscal_year"], "left")
    gap = F.abs(F.col("val") - F.col("value"))
    diff = F.when((F.col("val") == 0) & (F.col("value") == 0), F.lit(0.0)).when(
        F.col("val") == 0, F.lit(float("inf"))
    ).otherwise(F.try_divide(gap, F.abs("val")))
    pct = F.when(F.col("value").isNotNull(), diff)
    status = (
        F.when(F.col("fiscal_year").isNull(), "A_MISSING")
        .when(F.col("value").isNull(), "B_MISSING")
        .when(pct <= tolerance, "MATCH")
        .otherwise("MISMATCH")
    )
    return both.select(
        "ticker", "field", "fiscal_year", F.col("val").alias("a_value"), F.col("value").alias("b_value"), pct.alias("pct_diff"), status.alias("status")
    )
