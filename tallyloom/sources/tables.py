"""The driver's Parquet tables with declared schemas.

Declaring the schema skips the footer-reading inference job on every read and
keeps column pruning and filter pushdown untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import frozen

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class Tables:
    """Lazy access to the tables of one scale folder: ``Tables(spark, root).orders``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._once: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}.parquet")

    def once(self, name: str, build) -> DataFrame:
        """An intermediate table that several branches of a query read, written once."""
        if name not in self._once:
            self._once[name] = frozen(build(self), name)
        return self._once[name]


def money(value: Column | str, scale: int = 2) -> Column:
    """Fixed-point money, never binary floating point: ``decimal(12, 2)`` by default."""
    col = F.col(value) if isinstance(value, str) else value
    return col.cast(f"decimal({10 + scale},{scale})")


def as_instant(df: DataFrame, *columns: str) -> DataFrame:
    """Zoneless timestamps as instants; streaming watermarks accept nothing else."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def epoch_millis(ts: Column | str) -> Column:
    """Milliseconds since the epoch of a zoneless timestamp, session zone not involved."""
    name = ts if isinstance(ts, str) else None
    if name is None:
        raise TypeError("pass a column name")
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")
