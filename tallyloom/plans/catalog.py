"""Imports every plan module so that its queries register."""

from tallyloom.plans import (  # noqa: F401
    clickstream,
    retail,
    series,
    transit,
    risk,
    loans,
    nonprofit,
    texts,
    finance,
    checks,
)
from tallyloom.plans.registry import oracle_sql, queries  # noqa: F401
