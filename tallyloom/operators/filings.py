"""Filing star: organisations, fiscal periods and filings with surrogate keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import fiscal_period, numeric_or_null, zero_pad
from tallyloom.operators.ordered import first_by


def tolerant_columns(raw: DataFrame, wanted: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """Normalises header case and spaces and keeps the wanted columns that exist, renamed.

    A missing ``required`` column is an error, any other missing column is skipped.
    """
    named = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    missing = [c for c in required if c not in named.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return named.select(*[F.col(c).alias(to) for c, to in wanted.items() if c in named.columns])


def dim_organization(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per organisation, the first in the declared order, keyed by a hash of its id.

    The id is padded before the de-duplication, so ``1`` and ``000000001`` are one.
    """
    padded = rows.withColumn("ein", zero_pad("ein", 9))
    return first_by(padded, ["ein"], [F.col(c) for c in order]).withColumn("org_key", F.xxhash64("ein"))


def dim_fiscal_year(rows: DataFrame) -> DataFrame:
    year, month = fiscal_period("tax_period")
    periods = rows.select(F.col("tax_period").cast("string").alias("tax_period")).filter("tax_period is not null").distinct()
    return periods.select("tax_period", year.alias("fiscal_year"), month.alias("fiscal_month"), F.xxhash64("tax_period").alias("fy_key"))


def fact_filing(rows: DataFrame, orgs: DataFrame, years: DataFrame, amounts: list[str]) -> DataFrame:
    """Filings with surrogate keys; amounts that are not numbers become null, unmatched rows are dropped."""
    typed = rows.withColumns(
        {"ein": zero_pad("ein", 9), "tax_period": F.col("tax_period").cast("string")}
        | {a: numeric_or_null(a, "decimal(15,2)") for a in amounts}
    )
    keyed = typed.join(orgs.select("ein", "org_key"), "ein").join(years.select("tax_period", "fy_key"), "tax_period")
    return keyed.drop("ein", "tax_period")


def star(fact: DataFrame, orgs: DataFrame, years: DataFrame) -> DataFrame:
    """Filings with their organisation and fiscal year."""
    return fact.join(orgs, "org_key").join(years, "fy_key")
