"""Cuts ranges out of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.blocks import Words, text_blocks
from tallyloom.llm.fragments import SEPARATORS, on_document


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges of a union of ranges; touching ones join."""
    if len(start) == 0:
        return start, stop
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > reach[:-1]
    lead = np.flatnonzero(fresh)
    return start[lead], reach[np.append(lead[1:], len(start)) - 1]


def kept(source: DataFrame, spans: DataFrame, unit: str) -> DataFrame:
    """``_id, n_<unit>, removed, kept`` per row of ``source`` (``_id, _key, _text``).

    With unit ``words`` the ranges count words and the kept words are joined by one space.
    """
    per_doc = spans.groupBy("_id", "_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = source.join(per_doc.withColumnsRenamed({"_id": "_rid", "_key": "_rkey"}), on_document(), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("spans")
            column = column.fill_null([]) if column.null_count else column
            totals, removed, texts = [], [], []
            for block in text_blocks(batch.column("_text")):
                part = column.slice(block.row0, block.rows)
                flat = part.flatten()
                at = np.concatenate([[0], np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False))])
                start = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
                stop = flat.field("stop").to_numpy(zero_copy_only=False).astype(np.int64)
                words = Words(block, SEPARATORS, hashed=False) if unit == "words" else None
                raw = block.data.tobytes()
                for row in range(block.rows):
                    lo, hi = int(block.offsets[row]), int(block.offsets[row + 1])
                    s, e = merged(start[at[row] : at[row + 1]], stop[at[row] : at[row + 1]])
                    removed.append([{"start": a, "stop": b} for a, b in zip(s.tolist(), e.tolist())])
                    if words is None:
                        totals.append(hi - lo)
                        cuts = zip([0, *e.tolist()], [*s.tolist(), hi - lo])
                        texts.append(b"".join(raw[lo + a : lo + b] for a, b in cuts) if len(s) else raw[lo:hi])
                    else:
                        first, last = int(words.first[row]), int(words.first[row + 1])
                        totals.append(last - first)
                        cuts = zip([0, *e.tolist()], [*s.tolist(), last - first])
                        pieces = []
                        for a, b in cuts:
                            if b > a:
                                pieces.extend(raw[words.start[first + a] : words.end[first + b - 1]].split())
                        texts.append(b" ".join(pieces))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    pa.array(totals, pa.int64()),
                    pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                    pa.array(texts, pa.binary()),
                ],
                names=["_id", f"n_{unit}", "removed", "kept"],
            )

    kind = source.schema["_id"].dataType.simpleString()
    return joined.select("_id", "_text", "spans").mapInArrow(
        work, f"_id {kind}, n_{unit} bigint, removed array<struct<start: int, stop: int>>, kept binary"
    )
