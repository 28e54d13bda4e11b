"""String clean-up and tolerant parsing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: Column | str) -> Column:
    """Trimmed text; empty text is null."""
    trimmed = F.trim(_c(value))
    return F.when(trimmed != "", trimmed)


def zero_pad(value: Column | str, width: int) -> Column:
    """Zero-padded to ``width``; a longer value is kept whole (plain ``lpad`` would cut it)."""
    text = _c(value).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def joined_key(*parts: Column | str) -> Column:
    """Parts joined with ``-``; null when any part is null."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit("-"), _c(part).cast("string")]
    return F.concat(*pieces[1:])


def numeric_or_null(value: Column | str, kind: str = "double") -> Column:
    """The number in the text, or null; never fails the job."""
    return F.trim(_c(value).cast("string")).try_cast(kind)


def percent_text(value: Column | str) -> Column:
    """``"13.56%"`` or ``13.56`` to 13.56."""
    return numeric_or_null(F.regexp_replace(_c(value).cast("string"), "%+$", ""))


def leading_number(value: Column | str) -> Column:
    """The first run of digits: ``" 36 months"`` to 36."""
    return F.regexp_extract(_c(value).cast("string"), "([0-9]+)", 1).try_cast("double")


def employment_years(value: Column | str) -> Column:
    """``"10+ years"`` to 10, ``"3 years"`` to 3 and ``"< 1 year"`` to 0."""
    text = _c(value)
    return F.when(F.trim(text).startswith("<"), F.lit(0.0)).otherwise(leading_number(text))


def valid_ticker(value: Column | str) -> Column:
    """Upper-cased symbol if it is 1 to 10 letters, else null."""
    symbol = F.upper(F.trim(_c(value)))
    return F.when(symbol.rlike("^[A-Z]{1,10}$"), symbol)


def fiscal_period(value: Column | str) -> tuple[Column, Column]:
    """Year and month of a ``YYYYMM`` period."""
    text = _c(value).cast("string")
    return F.substring(text, 1, 4).try_cast("int"), F.substring(text, 5, 2).try_cast("int")


def guarded_ratio(part: Column | str, whole: Column | str, digits: int | None = None, scale: float = 100.0) -> Column:
    """``scale * part / whole``; null when the whole is zero."""
    ratio = F.try_divide(_c(part) * F.lit(scale), _c(whole))
    return ratio if digits is None else F.round(ratio, digits)


def pct_change(old: Column | str, new: Column | str, digits: int | None = None) -> Column:
    """Percent change from ``old`` to ``new``; null when ``old`` is zero."""
    return guarded_ratio(_c(new) - _c(old), old, digits)
