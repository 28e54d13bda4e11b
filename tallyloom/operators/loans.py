"""Loan table clean-up, derived features and default rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import bands, text
from tallyloom.operators.ordered import exact_quantile

FINAL_STATUSES = ("Fully Paid", "Charged Off")


def final_outcomes(df: DataFrame) -> DataFrame:
    """Loans with one of the two definitive statuses."""
    return df.filter(F.col("loan_status").isin(*FINAL_STATUSES))


def target(df: DataFrame) -> DataFrame:
    """1 for a charged-off loan."""
    return df.withColumn("default", (F.col("loan_status") == "Charged Off").cast("int"))


def parse(df: DataFrame) -> DataFrame:
    """Percent, term and employment texts as numbers; columns that are absent are left alone."""
    rules = {
        "int_rate": text.percent_text("int_rate"),
        "revol_util": text.percent_text("revol_util"),
        "term": text.leading_number("term"),
        "emp_length": text.employment_years("emp_length"),
    }
    return df.withColumns({c: rule for c, rule in rules.items() if c in df.columns})


def ratios(df: DataFrame, as_of: str) -> DataFrame:
    """Credit history in years at ``as_of`` and income over loan amount."""
    return df.withColumns(
        {
            "credit_hist_years": F.datediff(F.lit(as_of).cast("date"), "earliest_cr_line") / F.lit(365.25),
            "income_to_loan": F.col("annual_inc") / F.greatest(F.col("loan_amnt"), F.lit(1.0)),
        }
    )


def encode(df: DataFrame) -> DataFrame:
    """Grade, verification and band columns."""
    return df.withColumns(
        {
            "grade_num": bands.grade_number("grade"),
            "verification_num": bands.verification_number("verification_status"),
            "dti_bucket": bands.dti_band("dti"),
            "revol_util_bucket": bands.revol_band("revol_util"),
            "income_bracket": bands.income_band("annual_inc"),
        }
    )


def default_rates(df: DataFrame, *by: Column | str) -> DataFrame:
    """Default rate and loan count per group; rows without a group value are left out."""
    names = [b for b in by if isinstance(b, str)]
    known = df.na.drop(subset=names) if names else df
    return known.groupBy(*by).agg(F.avg("default").alias("default_rate"), F.count("*").alias("loan_count"))


def impute(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Missing numbers become the exact median, missing labels the most frequent one (ties: smallest).

    Each fill value is one row found by aggregation and read by the main scan as a scalar.
    """
    fills = {}
    for c in numeric:
        typed = df.select(F.col(c).cast("double").alias(c))
        middle = exact_quantile(typed, keys=[], value=c, p=0.5, out="m").select("m").scalar()
        fills[c] = F.coalesce(F.col(c).cast("double"), middle)
    for c in categorical:
        counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
        mode = counts.agg(F.min_by(c, F.struct(-F.col("n"), F.col(c)))).scalar()
        fills[c] = F.coalesce(F.col(c), mode)
    return df.withColumns(fills)


def lump(df: DataFrame, column: str, n: int, other: str = "OTHER") -> DataFrame:
    """Keeps the ``n`` most frequent labels and calls the rest ``other``; nulls count as the rest."""
    top = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    top = top.orderBy(F.desc("_n"), column).limit(n).select(F.col(column).alias("_top"))
    # At most n rows, so the broadcast is bounded by the parameter.
    joined = df.join(F.broadcast(top), F.col(column) == F.col("_top"), "left")
    return joined.withColumn(column, F.coalesce("_top", F.lit(other))).drop("_top")
