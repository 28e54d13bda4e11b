"""Exact substring de-duplication by suffix order and longest-previous-factor arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import fragments as fr
from tallyloom.llm.blocks import byte_hash, starts_within, text_blocks
from tallyloom.llm.spans import kept
from tallyloom.llm.suffixes import SuffixOrder, previous_factors
from tallyloom.session import frozen

#: Fragment bytes whose suffixes are sorted together.
SORT_BYTES = 300_000


def _ragged(sizes: np.ndarray) -> np.ndarray:
    """``0..size-1`` for each size, concatenated."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _factor_spans(columns: dict, span: int, keep: str) -> dict:
    """Runs of windows of once-seen fragments that also begin elsewhere (``keep="none"``) or earlier (``"first"``)."""
    block = next(text_blocks(columns["bytes"], 1 << 40))
    sizes = np.diff(block.offsets)
    counts = sizes - span + 1
    owner = np.repeat(np.arange(block.rows), counts)
    starts = block.offsets[owner] + _ragged(counts)
    suffixes = SuffixOrder(block.data, starts, span)
    copied = previous_factors(suffixes, starts, span) >= span
    if keep == "none":
        copied |= previous_factors(suffixes, -starts, span) >= span
        copied &= columns["copies"].to_numpy(zero_copy_only=False)[owner] == 1
    return run_rows(columns, owner, starts - block.offsets[owner], copied, span)


def run_rows(columns: dict, owner: np.ndarray, at: np.ndarray, hit: np.ndarray, span: int) -> dict:
    """Marked windows, in order of fragment and place, as one row per unbroken run."""
    pick = np.flatnonzero(hit)
    fresh = np.ones(len(pick), bool)
    fresh[1:] = (pick[1:] != pick[:-1] + 1) | (owner[pick[1:]] != owner[pick[:-1]])
    lead = pick[np.flatnonzero(fresh)]
    tail = pick[np.append(np.flatnonzero(fresh)[1:], len(pick)) - 1] if len(pick) else lead
    lo = columns["lo"].to_numpy(zero_copy_only=False).astype(np.int64)[owner[lead]]
    take = pa.array(owner[lead])
    return {
        "_id": columns["_id"].take(take),
        "_key": columns["_key"].take(take),
        "start": pa.array(lo + at[lead], pa.int32()),
        "stop": pa.array(lo + at[tail] + span, pa.int32()),
    }


def _window_rows(span: int):
    def work(batches):
        for batch in batches:
            lo = batch.column("lo").to_numpy(zero_copy_only=False).astype(np.int64)
            for block in text_blocks(batch.column("bytes")):
                at = np.flatnonzero(starts_within(block.offsets, span, len(block.data)))
                row = np.searchsorted(block.offsets, at, side="right") - 1
                take = pa.array(row + block.row0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").take(take),
                        batch.column("_key").take(take),
                        pa.array(lo[row + block.row0] + at - block.offsets[row], pa.int32()),
                        pa.array(byte_hash(block.data).windows(span)[at].view(np.int64)),
                    ],
                    names=["_id", "_key", "start", "window"],
                )

    return work


def duplicate_spans(
    docs: DataFrame, *, doc_id: str, text: str, span: int = 200, k: int = 32, keep: str = "none", group_limit: int = fr.GROUP_LIMIT
) -> tuple[DataFrame, DataFrame]:
    """``(source, spans)``: keyed texts and their byte ranges ``_id, _key, start, stop`` to remove.

    A range is a run of ``span``-byte strings that also begin elsewhere in the corpus, or, with
    ``keep="first"``, at a smaller ``(id, text hash, place)``. Ranges of one text may overlap.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    source = fr.keyed(docs, doc_id, text)
    kind = source.schema["_id"].dataType.simpleString()
    runs = frozen(fr.anchors(source, "bytes", span, k), "runs")
    again = frozen(fr.repeated(runs), "repeated")
    place = F.struct("_id", "_key", "lo", "hi")
    groups = again.filter("mixed").groupBy("anchor", "fragment").agg(F.count("*").alias("copies"), F.min(place).alias("rep"))
    sizes = groups.groupBy("anchor").agg(F.count("*").alias("around"), F.sum("copies").alias("n"))
    distinct = frozen(groups.join(sizes, "anchor"), "distinct")

    if keep == "none":
        several = distinct.filter("copies > 1").select("anchor", "fragment")
        copied = again.filter("not mixed").select("_id", "_key", "lo", "hi").unionByName(
            again.filter("mixed").join(several, ["anchor", "fragment"]).select("_id", "_key", "lo", "hi")
        )
    else:
        firsts = again.groupBy("anchor", "fragment").agg(F.min(place).alias("rep"))
        copied = again.join(firsts, ["anchor", "fragment"]).filter(place != F.col("rep")).select("_id", "_key", "lo", "hi")
    whole = copied.select("_id", "_key", F.col("lo").alias("start"), (F.col("hi") + span).alias("stop"))

    wanted = distinct.select("rep.*", "anchor", "copies", "around").withColumn("upto", F.col("hi") + span).drop("hi")
    pieces = frozen(fr.cut(source, wanted, "bytes", ["anchor", "copies", "around"]), "pieces")
    cold = pieces.filter(F.col("around") <= group_limit)
    schema = f"_id {kind}, _key bigint, start int, stop int"
    spans = whole.unionByName(
        fr.grouped(cold, "anchor", ["_id", "_key", "lo"], lambda c: _factor_spans(c, span, keep), schema, SORT_BYTES)
    )
    crowded = pieces.filter(F.col("around") > group_limit)
    if not crowded.isEmpty():
        # Too many different surroundings for one task: their windows are counted one by one, combined before the shuffle.
        rows = crowded.select("_id", "_key", "lo", "bytes")
        windows = frozen(rows.mapInArrow(_window_rows(span), f"_id {kind}, _key bigint, start int, window bigint"), "windows")
        here = F.struct("_id", "_key", "start")
        seen = windows.groupBy("window").agg(F.count("*").alias("n"), F.min(here).alias("rep")).filter("n > 1")
        hits = windows.join(seen.drop("n"), "window")
        if keep == "first":
            hits = hits.filter(here != F.col("rep"))
        spans = spans.unionByName(hits.select("_id", "_key", "start", (F.col("start") + span).alias("stop")))
    return source, spans


def suffix_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = 200, k: int = 32, keep: str = "none", group_limit: int = fr.GROUP_LIMIT) -> DataFrame:
    """Removes every byte inside a ``span``-byte string that the corpus holds more than once.

    Returns one row per input row: ``doc_id``, ``n_bytes``, ``removed`` (array of maximal
    ``start, stop`` byte ranges) and ``kept`` (binary: a cut may split a character). Strings are
    judged on the input, overlaps count, matches never cross documents. ``keep="first"`` spares
    the occurrence with the smallest ``(doc_id, text hash, place)``.

    Null text is empty; texts shorter than ``span`` lose nothing; a null id is an id of its own.
    Rows equal in id and text are judged as copies of each other (with ``"first"``, as one
    document). An empty table gives an empty result. Extra columns are ignored.
    """
    source, spans = duplicate_spans(docs, doc_id=doc_id, text=text, span=span, k=k, keep=keep, group_limit=group_limit)
    return kept(source, spans, "bytes").withColumnRenamed("_id", doc_id)
