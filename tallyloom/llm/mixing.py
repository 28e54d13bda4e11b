"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import frozen


def word_count(text: Column | str) -> Column:
    """Words between the bytes 0x20 and 0x09-0x0D; 0 for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _band(size: Column) -> Column:
    """Grows with ``size`` in steps of 1.6 to 3 percent: bit length and the leading six bits."""
    bits = F.length(F.bin(size))
    return bits * 64 + F.expr("shiftright(_size, greatest(length(bin(_size)) - 6, 0))").cast("int")


def targets(sizes: DataFrame, cycle: tuple[int, ...], cap: int) -> DataFrame:
    """``_source, source_size, target`` per source of ``sizes`` (``_source, _size``).

    Sources in order weigh ``cycle``, repeating, and share the total. A target stops at ``cap``
    times its source's size; what is cut goes to the others by weight. In order of
    ``cap * size / weight`` the stopped sources come first, so one running sum finds the level
    at which the rest share. Works on one row per source.
    """
    totals = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    ordinal = F.row_number().over(Window.orderBy("_source")) - 1
    weights = F.array(*[F.lit(w) for w in cycle])
    ranked = totals.withColumn("_w", F.get(weights, ordinal % len(cycle))).withColumn("_cap", F.col("source_size") * cap)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_source")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    levels = ranked.withColumn("_level", left / F.sum("_w").over(onward)).withColumn("_at", F.row_number().over(order))
    free = F.col("_level") <= F.col("_cap") / F.col("_w")
    level = F.min_by(F.when(free, F.col("_level")), F.when(free, F.col("_at"))).over(everything)
    return levels.select(
        "_source", "source_size", F.coalesce(F.least(F.col("_cap").cast("double"), level * F.col("_w")), F.lit(0.0)).alias("target")
    )


def mix_sources(
    docs: DataFrame, *, doc_id: str, source: str, size: Column, cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix"
) -> DataFrame:
    """How often each row enters the mix: ``row`` (the input columns), ``size, source_size, target, copies``.

    Every document of a source expects ``target / source_size`` copies. Expected copies are summed
    up in a fixed order within the source, from one random offset; a document is emitted once per
    integer that its step crosses. The order goes by size band, then by a hash of the id, so the
    sample is spread over the sizes and words taken stay near the target. No source stands in one
    task: ranks are counted inside (band, hash digit) buckets and shifted by the bucket's offset.

    Sources go by code point, null last. Null sizes count 0; a source without words has target 0
    and no copies. Null ids hash as the empty string; rows equal in id, size and source are
    interchangeable. Reruns give the same rows. An empty table gives an empty result.
    """
    name = F.when(F.col(source).isNull(), "z").otherwise(F.concat(F.lit("a"), F.col(source).cast("string")))
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        name.alias("_source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("_size"),
        digest.alias("_digest"),
        F.col(doc_id).alias("_id"),
    ).withColumns({"_band": _band(F.col("_size")), "_part": F.substring("_digest", 1, 1)})
    bucket = ["_source", "_band", "_part"]
    cells = frozen(rows.groupBy(*bucket).agg(F.count("*").alias("_n"), F.sum("_size").alias("_size")), "mix-cells")
    ahead = Window.partitionBy("_source").orderBy("_band", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).select(*bucket, "_before")
    plan = offsets.join(targets(cells, cycle, cap), "_source")

    within = Window.partitionBy(*bucket).orderBy("_digest", "_id", "_size")
    rank = F.row_number().over(within)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_source"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    placed = (
        rows.withColumn("_rank", rank)
        .join(plan, bucket)
        .withColumns({"_rate": rate, "_start": start, "_at": F.col("_rank") + F.col("_before")})
    )
    crossed = F.floor(F.col("_start") + F.col("_rate") * F.col("_at")) - F.floor(F.col("_start") + F.col("_rate") * (F.col("_at") - 1))
    return placed.select("row", F.col("_size").alias("size"), "source_size", "target", F.least(crossed, F.lit(cap)).cast("long").alias("copies"))
