"""Ordered computations that never put one whole key into one task.

A window partitioned by a key sorts that key's rows in a single task. That is
fine where the group has a natural bound (one row per calendar tick), and not
where a key may hold a third of the table. The operators here split each key
into consecutive ``bucket`` ranges, work inside a bucket, and carry a small
per-bucket summary across; answers equal the plain window's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("sum", "max", "min", "last")


def _carry_frame(keys: list[str], bucket: str, backward: bool = False):
    spec = Window.partitionBy(*keys).orderBy(F.col(bucket).desc() if backward else F.col(bucket).asc())
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def running(
    df: DataFrame,
    *,
    keys: list[str],
    bucket: str,
    order: list[str],
    aggs: dict[str, tuple[str, str]],
    inclusive: bool = True,
    backward: bool = False,
) -> DataFrame:
    """Running aggregates per key in ``order``, computed bucket by bucket.

    ``bucket`` is a column that grows with ``order`` and bounds the rows a task
    sorts (a day, a block of offsets). ``aggs`` maps an output name to
    ``(kind, column)`` with kind ``sum``, ``max``, ``min`` or ``last`` (the last
    non-null value). ``inclusive=False`` leaves the current row out. ``backward`` runs from the
    end, so that ``last`` is the next known value.
    """
    local = Window.partitionBy(*keys, bucket).orderBy(*[F.col(c).desc() if backward else F.col(c).asc() for c in order])
    local = local.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    position = F.struct(*order)

    def local_value(kind: str, name: str) -> Column:
        if kind == "last":
            return F.last(name, ignorenulls=True).over(local)
        return getattr(F, kind)(name).over(local)

    def bucket_value(kind: str, name: str) -> Column:
        if kind == "last":
            return (F.min_by if backward else F.max_by)(name, F.when(F.col(name).isNotNull(), position))
        return getattr(F, kind)(name)

    def carried(kind: str, name: str) -> Column:
        frame = _carry_frame(keys, bucket, backward)
        return F.last(name, ignorenulls=True).over(frame) if kind == "last" else getattr(F, kind)(name).over(frame)

    summary = df.groupBy(*keys, bucket).agg(
        *[bucket_value(kind, col).alias(f"_s_{out}") for out, (kind, col) in aggs.items()]
    )
    carry = summary.select(
        *keys, bucket, *[carried(kind, f"_s_{out}").alias(f"_c_{out}") for out, (kind, _) in aggs.items()]
    )
    joined = df.withColumns({f"_l_{out}": local_value(kind, col) for out, (kind, col) in aggs.items()}).join(
        carry, [*keys, bucket], "inner"
    )

    def combined(kind: str, out: str) -> Column:
        here, before = F.col(f"_l_{out}"), F.col(f"_c_{out}")
        if kind == "last":
            return F.coalesce(here, before)
        if kind == "sum":
            return F.when(here.isNull(), before).otherwise(here + F.coalesce(before, F.lit(0)))
        return F.greatest(here, before) if kind == "max" else F.least(here, before)

    done = joined.withColumns({out: combined(kind, out) for out, (kind, _) in aggs.items()})
    return done.drop(*[f"_{p}_{out}" for out in aggs for p in "lc"])


#: Consecutive rows that one fold goes over.
FOLD = 64


def affine_scan(df: DataFrame, *, keys: list[str], position: str, a: str, b: str, out: str, fold: int = FOLD) -> DataFrame:
    """Adds ``out``, the state ``y = a * y + b`` after each row of a key, ``y`` being 0 before the first.

    ``position`` counts each key's rows from 0 without gaps. Maps compose: ``fold`` consecutive rows
    are one map, so many of these one more, and so on; every level is grouped by key and block, never
    by key alone, and the state before a block comes back down the same way. Nothing is divided, so
    maps may be zero and may die out. The levels are as many as the longest key asks for.
    """
    last = df.agg(F.max(position)).first()[0]
    rest = [c for c in df.columns if c not in (*keys, position, a, b)]
    rows = df.select(
        *keys, F.col(position).cast("long").alias("_i"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"),
        F.struct(*[F.col(f"`{c}`") for c in (*rest, position, a, b)]).alias("_row"),
    )
    done = _scan(rows, keys, int(last or 0), fold)
    return done.select(*keys, "_row.*", F.col("_after").alias(out)).select(*df.columns, out)


def _scan(rows: DataFrame, keys: list[str], last: int, fold: int) -> DataFrame:
    """``rows`` with ``_before`` and ``_after``, the states around each."""
    blocks = rows.groupBy(*keys, F.floor(F.col("_i") / fold).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("_i", F.struct("_a", "_b", "_row").alias("_m")))).alias("_m"))
    if last >= fold:
        one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
        whole = F.aggregate("_m", one, lambda y, x: F.struct((y["a"] * x["_m"]["_a"]).alias("a"), (x["_m"]["_a"] * y["b"] + x["_m"]["_b"]).alias("b")))
        maps = blocks.select(*keys, "_block", whole.alias("_w"))
        above = maps.select(*keys, F.col("_block").alias("_i"), F.col("_w.a").alias("_a"), F.col("_w.b").alias("_b"), F.struct(F.lit(0)).alias("_row"))
        states = _scan(above, keys, last // fold, fold).select(*keys, F.col("_i").alias("_block"), "_before")
        blocks = blocks.join(states, [*keys, "_block"])
    else:
        blocks = blocks.withColumn("_before", F.lit(0.0))
    start = F.struct(F.col("_before").alias("y"), F.array().cast("array<double>").alias("all"))

    def step(s: Column, x: Column) -> Column:
        y = x["_m"]["_a"] * s["y"] + x["_m"]["_b"]
        return F.struct(y.alias("y"), F.concat(s["all"], F.array(y)).alias("all"))

    after = F.aggregate("_m", start, step, lambda s: s["all"])
    states = blocks.select(*keys, "_before", "_m", after.alias("_y"))
    each = states.select(*keys, F.concat(F.array("_before"), "_y").alias("_s"), F.posexplode("_m").alias("_at", "_one"))
    return each.select(
        *keys, F.col("_one._i").alias("_i"), F.col("_one._m._row").alias("_row"), F.get("_s", F.col("_at")).alias("_before"), F.get("_s", F.col("_at") + 1).alias("_after")
    )


def range_bucket(df: DataFrame, value: str, n_buckets: int = 64, relative_error: float = 0.005) -> Column:
    """A bucket expression that cuts ``value`` into ranges of similar row count.

    The cut points come from one quantile sketch over the column and are literals
    in the plan, so every branch that uses the expression agrees on the ranges.
    """
    probabilities = [i / n_buckets for i in range(1, n_buckets)]
    cuts = sorted(set(df.approxQuantile(value, probabilities, relative_error)))

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(value) <= F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(cuts))


def value_at_rank(
    df: DataFrame,
    *,
    keys: list[str],
    value: str,
    rank: Column,
    near: float,
    out: str,
    accuracy: int = 10_000,
    few_keys: bool = False,
) -> DataFrame:
    """Per key, ``value`` interpolated at a fractional 0-based ``rank``.

    ``rank`` is an expression over ``n`` (the key's non-null count) and ``near``
    the fraction of ``n`` it stands for. A mergeable quantile sketch brackets the
    wanted rank; values outside the bracket only count, so the rows sorted per key
    are the few inside it, after equal values have been collapsed. The sketch only
    steers the work: ranks are counted exactly. ``few_keys`` says that the keys are
    classes: their sketches go to the rows, not the rows to one task per class.
    """
    eps = 2.5 / accuracy
    # Below this size a rank may sit outside the bracket by rounding alone; such groups are small enough to keep whole.
    small = int(4 / eps)
    band = F.array(F.lit(max(0.0, near - eps)), F.lit(min(1.0, near + eps)))
    present = df.filter(F.col(value).isNotNull())
    if keys:
        sketch = present.groupBy(*keys).agg(
            F.percentile_approx(value, band, F.lit(accuracy)).alias("_band"), F.count("*").alias("_size")
        )
        tagged = present.join(F.broadcast(sketch) if few_keys else sketch, keys)
        low, high = (F.when(F.col("_size") >= small, F.col("_band")[i]) for i in (0, 1))
    else:
        tagged = present
        sketch = present.agg(
            F.percentile_approx(value, band, F.lit(accuracy)).alias("_band"), F.count("*").alias("_size")
        ).first()
        low, high = (F.lit(b) for b in (sketch["_band"] if sketch["_size"] >= small else (None, None)))
    if dict(df.dtypes)[value] in ("double", "float"):
        # A recomputed float may differ in its last bits; the bracket must still hold it.
        slack = 1e-9
        low, high = low - F.abs(low) * slack, high + F.abs(high) * slack
    side = F.when(F.col(value) < low, -1).when(F.col(value) > high, 1).otherwise(0)
    cells = (
        tagged.select(*keys, side.alias("_side"), F.when(side == 0, F.col(value)).alias("_v"))
        .groupBy(*keys, "_side", "_v")
        .agg(F.count("*").alias("_m"))
    )
    per_key = Window.partitionBy(*keys)
    ahead = per_key.orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        cells.withColumn("n", F.sum("_m").over(per_key))
        .withColumn("_end", F.sum("_m").over(ahead))
        .withColumn("_rank", rank.cast("double"))
    )

    def pick(at: Column) -> Column:
        return F.max(F.when((F.col("_end") - F.col("_m") <= at) & (at < F.col("_end")), F.col("_v")))

    missed = F.raise_error(F.lit("a rank lies outside the sketched bracket"))
    return (
        ranked.groupBy(*keys)
        .agg(
            pick(F.floor("_rank")).alias("_lo"),
            pick(F.ceil("_rank")).alias("_hi"),
            F.max(F.col("_rank") - F.floor("_rank")).alias("_w"),
            F.max("n").alias("_n"),
        )
        .select(
            *keys,
            F.when((F.col("_n") > 0) & F.col("_w").isNotNull() & (F.col("_lo").isNull() | F.col("_hi").isNull()), missed)
            .when(F.col("_w") == 0, F.col("_lo"))
            .otherwise(F.col("_lo") + F.col("_w") * (F.col("_hi") - F.col("_lo")))
            .alias(out),
            F.col("_n").alias(f"{out}_n"),
        )
    )


def exact_quantile(df: DataFrame, *, keys: list[str], value: str, p: float, out: str) -> DataFrame:
    """Exact quantile with linear interpolation, ``(n-1)*p`` convention, per key."""
    return value_at_rank(df, keys=keys, value=value, rank=(F.col("n") - 1) * F.lit(p), near=p, out=out).drop(f"{out}_n")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    Spark limits each key inside the map tasks before the shuffle
    (WindowGroupLimit), so a hot key ships one row per map task.
    """
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(spec)).filter(F.col("_rn") == 1).drop("_rn")


def top_by(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key with their rank, limited before the shuffle as in ``first_by``."""
    spec = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank or "_rn", F.row_number().over(spec)).filter(F.col(rank or "_rn") <= n)
    return ranked if rank else ranked.drop("_rn")


def all_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
