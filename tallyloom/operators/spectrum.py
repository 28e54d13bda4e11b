"""Fourier transform of long regular series, dealt over tasks.

With ``n = classes * length`` the positions ``t`` of a series fall into residue classes. The classes
are transformed apart, every value is turned by its twiddle factor, and the values of one inner
frequency are transformed again across the classes. Either step works on groups of bounded size, so
no task holds a series.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.ordered import running

#: Values that one call of either step transforms, about.
GROUP_VALUES = 1 << 16


def _shape(n):
    """The largest divisor of ``n`` up to its root: how many residue classes a series falls into."""
    upto = F.floor(F.sqrt(n.cast("double"))).cast("long")
    return F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(upto, F.lit(1))), lambda d: n % d == 0))


def _inner(table: pa.Table) -> pa.Table:
    """Whole residue classes of one series: transform over their members, then twiddle."""
    n, classes = table.column("_n")[0].as_py(), table.column("_classes")[0].as_py()
    t = table.column("_t").to_numpy()
    order = np.lexsort((t, t % classes))
    length = n // classes
    values = np.fft.fft(table.column("_x").to_numpy()[order].reshape(-1, length), axis=1)
    residue, inner = np.meshgrid((t % classes)[order][::length], np.arange(length), indexing="ij")
    # The product stays whole before it is divided, so the angle is exact.
    values *= np.exp(-2j * np.pi * ((residue * inner) % n) / n)
    values = values.ravel()
    keys = _repeated(table, len(values))
    out = [*keys, pa.array(np.full(len(values), n)), pa.array(np.full(len(values), classes)), pa.array(residue.ravel()), pa.array(inner.ravel()), pa.array(values.real), pa.array(values.imag)]
    return pa.table(out, names=[*_keys_of(table), "_n", "_classes", "_residue", "_inner", "_re", "_im"])


def _keys_of(table: pa.Table) -> list[str]:
    return [c for c in table.column_names if c.startswith("_k")]


def _repeated(table: pa.Table, n: int) -> list[pa.Array]:
    """The keys of a group's first row, ``n`` times."""
    return [pa.repeat(table.column(c)[0], n) for c in _keys_of(table)]


def _outer(shortest: float, longest: float, top: int):
    """Inner frequencies of one series: transform across the classes and keep the strongest bins."""

    def work(table: pa.Table) -> pa.Table:
        n, classes = table.column("_n")[0].as_py(), table.column("_classes")[0].as_py()
        inner, residue = table.column("_inner").to_numpy(), table.column("_residue").to_numpy()
        order = np.lexsort((residue, inner))
        values = (table.column("_re").to_numpy() + 1j * table.column("_im").to_numpy())[order].reshape(-1, classes)
        spectrum = np.fft.fft(values, axis=1).ravel() / n
        bins = (inner[order][::classes, None] + (n // classes) * np.arange(classes)).ravel()
        with np.errstate(divide="ignore"):
            period = n / bins
        keep = np.flatnonzero((bins >= 1) & (bins <= n // 2) & (period >= shortest) & (period <= longest))
        # One-sided: every bin stands for two but the last of an even length.
        amplitude = np.abs(spectrum[keep]) * np.where(2 * bins[keep] == n, 1, 2)
        best = np.lexsort((bins[keep], -amplitude))[:top]
        at = keep[best]
        keys = _repeated(table, len(at))
        columns = [*keys, pa.array(bins[at]), pa.array(period[at]), pa.array(amplitude[best]), pa.array(np.angle(spectrum[at]))]
        return pa.table(columns, names=[*_keys_of(table), "bin", "period_h", "amplitude", "phase"])

    return work


def strongest_bins(
    df: DataFrame, *, keys: list[str], order: str, value: str, bucket: str, shortest: float, longest: float, top: int, group_values: int = GROUP_VALUES
) -> DataFrame:
    """Per series the ``top`` strongest bins with a period, in ticks, between two bounds: ``rank, bin, period_h, amplitude, phase``.

    Ticks are counted in ``order``; gaps must be filled before. Equal amplitudes go to the longer period. A
    series whose length is a prime has one residue class and is transformed in one piece; one with a missing
    value has no bins.
    """
    kinds = dict(df.dtypes)
    rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(order).alias("_o"), F.col(value).cast("double").alias("_x"), F.col(bucket).alias("_bucket"), F.lit(1).alias("_one"))
    names = [f"_k{i}" for i in range(len(keys))]
    counted = running(rows, keys=names, bucket="_bucket", order=["_o"], aggs={"_t": ("sum", "_one")})
    sizes = rows.groupBy(*names).agg(F.count("*").alias("_n"), F.avg("_x").alias("_mean"), F.count("_x").alias("_known")).filter("_n = _known").drop("_known")
    shaped = sizes.withColumn("_classes", _shape(F.col("_n")))
    placed = counted.join(shaped, names).select(*names, "_n", "_classes", (F.col("_t") - 1).alias("_t"), (F.col("_x") - F.col("_mean")).alias("_x"))
    whole = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(group_values) * F.col("_classes") / F.col("_n")))
    key_types = ", ".join(f"{n} {kinds[k]}" for n, k in zip(names, keys))
    inner = placed.groupBy(*names, F.floor((F.col("_t") % F.col("_classes")) / whole).alias("_part")).applyInArrow(
        _inner, f"{key_types}, _n bigint, _classes bigint, _residue bigint, _inner bigint, _re double, _im double"
    )
    across = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(group_values) / F.col("_classes")))
    bins = inner.groupBy(*names, F.floor(F.col("_inner") / across).alias("_part")).applyInArrow(
        _outer(shortest, longest, top), f"{key_types}, bin bigint, period_h double, amplitude double, phase double"
    )
    best = Window.partitionBy(*names).orderBy(F.col("amplitude").desc(), "bin")
    ranked = bins.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "rank", "bin", "period_h", "amplitude", "phase")
