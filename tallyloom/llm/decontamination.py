"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.blocks import U64, Anchors, Rolling, Words, fold_table, grams, separators, splitmix, starts_within, text_blocks
from tallyloom.session import frozen

#: Words are runs of digits, letters a-z and non-ASCII bytes, after A-Z are lower-cased.
WORD_SEPARATORS = separators([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
FOLD = fold_table()

#: Bits of the map of test fingerprints that every task gets; its size does not depend on the data.
MAP_BITS = 1 << 23

_PRINT = "struct<print: bigint, at: int, size: int, whole: boolean, around: array<bigint>>"


def _fingerprints(words: Words, span: int, k: int, lengths: list[int], pad: int, whole_rows: bool):
    """Winnowed k-grams of texts with ``span`` words; of shorter windows, every gram of the asked lengths.

    Returns parallel arrays ``(row, print, at, size, whole, around)``; ``around`` holds the hashes of
    the ``span - k`` words before (nearest first) and after the gram, ``pad`` beyond the text.
    """
    first, hashes = words.first, words.hash
    runs = Anchors(Rolling(hashes), first, len(hashes), span, k)
    reach = span - k
    at = runs.at
    lo, hi = first[runs.row], first[runs.row + 1]
    near = np.concatenate([at[:, None] - 1 - np.arange(reach)[None, :], at[:, None] + k + np.arange(reach)[None, :]], axis=1)
    inside = (near >= lo[:, None]) & (near < hi[:, None])
    around = np.where(inside, hashes[np.clip(near, 0, max(len(hashes) - 1, 0))], U64(pad)) if len(at) else np.zeros((0, 2 * reach), U64)
    parts = [(runs.row, runs.anchor, at - lo, np.full(len(at), k), np.zeros(len(at), bool), around)]
    for n in lengths:
        gram = splitmix(grams(hashes, n) + U64(n))
        start = np.flatnonzero(starts_within(first, n, len(hashes))[: len(gram)])
        row = np.searchsorted(first, start, side="right") - 1
        if whole_rows:
            short = words.counts[row] == n
            start, row = start[short], row[short]
        blank = np.full((len(start), 2 * reach), pad, U64)
        parts.append((row, gram[start], start - first[row], np.full(len(start), n), np.ones(len(start), bool), blank))
    return [np.concatenate(p) for p in zip(*parts)]


def _scan(table: DataFrame, span: int, k: int, lengths: list[int], pad: int, whole_rows: bool, bitmap: np.ndarray | None) -> DataFrame:
    """``_id, _key, n_words, prints`` per row; with a bitmap, only fingerprints that may be in it."""
    kind = table.schema["_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("_text")):
                words = Words(block, WORD_SEPARATORS, FOLD)
                row, prints, at, size, whole, around = _fingerprints(words, span, k, lengths, pad, whole_rows)
                if bitmap is not None:
                    bit = prints % U64(MAP_BITS)
                    keep = np.flatnonzero((bitmap[bit >> U64(6)] >> (bit & U64(63))) & U64(1))
                    row, prints, at, size, whole, around = (a[keep] for a in (row, prints, at, size, whole, around))
                order = np.argsort(row, kind="stable")
                row, prints, at, size, whole, around = (a[order] for a in (row, prints, at, size, whole, around))
                near = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(row) + 1) * around.shape[1], pa.int32()), pa.array(around.reshape(-1).view(np.int64))
                )
                inner = pa.StructArray.from_arrays(
                    [pa.array(prints.view(np.int64)), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(whole), near],
                    ["print", "at", "size", "whole", "around"],
                )
                border = np.searchsorted(row, np.arange(block.rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(block.row0, block.rows),
                        batch.column("_key").slice(block.row0, block.rows),
                        pa.array(words.counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(border, pa.int32()), inner),
                    ],
                    names=["_id", "_key", "n_words", "prints"],
                )

    return table.mapInArrow(work, f"_id {kind}, _key bigint, n_words bigint, prints array<{_PRINT}>")


def _bitmap(prints: DataFrame) -> np.ndarray:
    """Which of ``MAP_BITS`` bits the fingerprints set; one row per 64 bits at most reaches the driver."""
    bit = F.col("print").bitwiseAND(F.lit(MAP_BITS - 1))
    cells = prints.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits")
    )
    out = np.zeros(MAP_BITS // 64, np.int64)
    for row in cells.collect():
        out[row.cell] = row.bits
    return out.view(U64)


def _agreeing(here: str, there: str, places: range) -> Column:
    """How many words agree one after the other from the gram outwards."""
    out = F.lit(len(places))
    for n, i in reversed(list(enumerate(places))):
        out = F.when(F.col(here)[i] != F.col(there)[i], n).otherwise(out)
    return out


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    span: int = 10,
    k: int = 5,
) -> DataFrame:
    """``doc_id, text_hash, n_words, hits, items`` per row of ``docs``.

    ``hits`` are word ranges ``start, stop`` (they may overlap) that repeat ``span`` consecutive
    words of an item, or all words of an item with fewer; ``items`` the sorted distinct ids, as
    strings, of the items found. Both tables are winnowed: of every ``span`` words the smallest
    k-gram is kept, so texts that share ``span`` words share a fingerprint. Fingerprints are
    joined, and each hit is extended word by word to both sides.

    Words are compared by 64-bit hashes. Null or wordless texts have no hits. An item without id
    marks words but is not listed; items with equal ids are one. Null and repeated document ids
    are kept row by row. Empty tables give empty results or no hits. Extra columns are ignored.
    """

    def keyed(table: DataFrame, name: str) -> DataFrame:
        return table.select(F.col(name).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"), F.col(text).alias("_text"))

    reach = span - k
    tests = frozen(_scan(keyed(items, item_id), span, k, list(range(1, span)), 2, True, None), "test-prints")
    test_prints = tests.select(F.col("_id").cast("string").alias("item"), F.inline("prints"))
    lengths = [r["size"] for r in test_prints.filter("whole").select("size").distinct().collect()]
    bitmap = _bitmap(test_prints)
    scanned = frozen(_scan(keyed(docs, doc_id), span, k, sorted(lengths), 1, False, bitmap), "prints")
    here = scanned.select("_id", "_key", F.inline("prints"))
    there = test_prints.select("item", "print", F.col("around").alias("_around")).distinct()
    pairs = here.join(there, "print").withColumns(
        {
            "_left": F.when(F.col("whole"), 0).otherwise(_agreeing("around", "_around", range(reach))),
            "_right": F.when(F.col("whole"), 0).otherwise(_agreeing("around", "_around", range(reach, 2 * reach))),
        }
    )
    found = pairs.filter(F.col("whole") | (F.col("_left") + F.col("size") + F.col("_right") >= span)).select(
        "_id", "_key", "item", F.struct((F.col("at") - F.col("_left")).alias("start"), (F.col("at") + F.col("size") + F.col("_right")).alias("stop")).alias("hit")
    )
    per_doc = found.groupBy(F.col("_id").alias("_rid"), F.col("_key").alias("_rkey")).agg(
        F.array_sort(F.collect_set("hit")).alias("hits"), F.array_sort(F.collect_set("item")).alias("items")
    )
    joined = scanned.select("_id", "_key", "n_words").join(per_doc, F.expr("_id <=> _rid and _key = _rkey"), "left")
    return joined.select(
        F.col("_id").alias(doc_id),
        F.col("_key").alias("text_hash"),
        "n_words",
        F.coalesce("hits", F.array().cast("array<struct<start: int, stop: int>>")).alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def words_covered(ranges: Column | str) -> Column:
    """Words inside a union of ranges sorted by start."""
    state = F.aggregate(
        ranges,
        F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n")),
        lambda s, r: F.struct(
            F.greatest(s.reach, r.stop).alias("reach"), (s.n + F.greatest(F.lit(0), r.stop - F.greatest(s.reach, r.start))).alias("n")
        ),
    )
    return state.n
