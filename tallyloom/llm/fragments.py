"""Repeated windows over a whole corpus, found without shuffling every window.

A window of ``span`` items picks the smallest k-gram inside it (its *anchor*) by content alone, so
equal windows, wherever they stand, pick equal anchors. Per text only runs of windows with one
anchor are emitted (about ``2 / (span - k + 2)`` per item). Anchors that occur once end there: none
of their windows repeats. For the others, equal fragments (see ``Anchors``) collapse to one
representative before any text moves, so a group of copies, however large, ships one fragment.
Only distinct fragments around a repeated anchor need a closer look; ``op2`` and ``op10`` give it
with suffix arrays and suffix automata.

A document is known by its id and a 64-bit hash of its text, so repeated ids stay apart; rows
equal in both are one document. Ids may be of any orderable type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.blocks import SPACES, Anchors, Block, Rolling, Words, byte_hash, separators, text_blocks
from tallyloom.session import frozen

SEPARATORS = separators(SPACES)

#: More distinct fragments than this around one anchor are split by window instead of being compared in one task.
GROUP_LIMIT = 2048


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``_id, _key, _text``: all an operator needs; other columns cannot clash."""
    return docs.select(
        F.col(doc_id).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"),
        F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"),
    )


def _units(block: Block, unit: str) -> tuple[Rolling, np.ndarray, int]:
    if unit == "bytes":
        return byte_hash(block.data), block.offsets, len(block.data)
    words = Words(block, SEPARATORS)
    return Rolling(words.hash), words.first, len(words.hash)


def anchors(source: DataFrame, unit: str, span: int, k: int) -> DataFrame:
    """``_id, _key, lo, hi, anchor, fragment`` per run of windows of ``keyed`` texts."""
    k = min(k, span)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("_text")):
                rolling, first, total = _units(block, unit)
                runs = Anchors(rolling, first, total, span, k)
                row = pa.array(runs.row + block.row0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").take(row),
                        batch.column("_key").take(row),
                        pa.array(runs.lo - first[runs.row], pa.int32()),
                        pa.array(runs.hi - first[runs.row], pa.int32()),
                        pa.array(runs.anchor.view(np.int64)),
                        pa.array(runs.fragment.view(np.int64)),
                    ],
                    names=["_id", "_key", "lo", "hi", "anchor", "fragment"],
                )

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(work, f"_id {kind}, _key bigint, lo int, hi int, anchor bigint, fragment bigint")


def repeated(runs: DataFrame) -> DataFrame:
    """Runs whose anchor occurs again, with ``mixed``: does it stand in different fragments?

    The counts are written first: a join of two plain shuffles is one whose hot anchors get split.
    """
    seen = frozen(
        runs.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("fragment").alias("a"), F.max("fragment").alias("b"))
        .filter("n > 1")
        .select("anchor", (F.col("a") != F.col("b")).alias("mixed")),
        "seen",
    )
    return runs.join(seen, "anchor")


def cut(source: DataFrame, wanted: DataFrame, unit: str, carried: list[str]) -> DataFrame:
    """Adds ``bytes``, the text of ``lo .. hi + span``, to rows of ``wanted`` (``_id, _key, lo, upto`` and ``carried``).

    Rows are first gathered per document, so each text is joined once.
    """
    per_doc = wanted.groupBy("_id", "_key").agg(F.collect_list(F.struct("lo", "upto", *carried)).alias("want"))
    joined = source.join(per_doc.withColumnsRenamed({"_id": "_rid", "_key": "_rkey"}), on_document())
    kinds = {f.name: f.dataType for f in wanted.schema.fields}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in ("_id", "_key", "lo", *carried)] + [T.StructField("bytes", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wants = batch.column("want")
            for block in text_blocks(batch.column("_text")):
                part = wants.slice(block.row0, block.rows)
                flat = part.flatten()
                row = np.repeat(np.arange(block.rows), part.value_lengths().to_numpy(zero_copy_only=False))
                lo = flat.field("lo").to_numpy(zero_copy_only=False).astype(np.int64)
                upto = flat.field("upto").to_numpy(zero_copy_only=False).astype(np.int64)
                if unit == "bytes":
                    begin, end = block.offsets[row] + lo, block.offsets[row] + upto
                else:
                    words = Words(block, SEPARATORS, hashed=False)
                    begin, end = words.start[words.first[row] + lo], words.end[words.first[row] + upto - 1]
                take = pa.array(row + block.row0)
                raw = block.data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").take(take),
                        batch.column("_key").take(take),
                        flat.field("lo"),
                        *[flat.field(c) for c in carried],
                        pa.array([raw[b:e] for b, e in zip(begin.tolist(), end.tolist())], pa.binary()),
                    ],
                    names=schema.names,
                )

    return joined.select("_id", "_key", "_text", "want").mapInArrow(work, schema)


def on_document() -> Column:
    return F.expr("_id <=> _rid and _key = _rkey")


def grouped(rows: DataFrame, key: str, order: list[str], work: Callable[[dict], dict], schema: str, size: int) -> DataFrame:
    """Feeds ``work`` with columns that hold whole groups of ``key``, about ``size`` bytes of column ``bytes``, or rows, at a time.

    Unlike one call per group, many small groups share one call. Groups are bounded by the caller.
    """

    out_schema = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_bytes = 0

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            done = work({name: table.column(name).combine_chunks() for name in table.column_names})
            return pa.RecordBatch.from_arrays([done[c] for c in out_schema], names=out_schema)

        for batch in batches:
            at = 0
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            weighed = "bytes" in batch.schema.names
            sizes = np.cumsum(np.diff(text_offsets(batch.column("bytes")))) if weighed else np.arange(1, batch.num_rows + 1)
            borders = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if held and len(keys) and keys[0] != held[-1].column(key)[-1].as_py():
                borders = np.concatenate([[0], borders])
            for border in borders.tolist():
                here = int(sizes[border - 1]) - (int(sizes[at - 1]) if at else 0) if border else 0
                if held_bytes + here >= size:
                    if border > at:
                        held.append(batch.slice(at, border - at))
                    yield flush(held)
                    held, held_bytes, at = [], 0, border
            if at < batch.num_rows:
                held.append(batch.slice(at))
                held_bytes += int(sizes[-1]) - (int(sizes[at - 1]) if at else 0)
        if held:
            yield flush(held)

    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(run, schema)


def text_offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
