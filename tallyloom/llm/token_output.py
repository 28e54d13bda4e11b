"""Token ids of a corpus as bit-packed blocks in document order."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.bitpacking import bits_for, pack, unpack
from tallyloom.llm.blocks import SPACES, U64, Block, Words, separators, splitmix, text_blocks

#: Bytes that a worker remembers, in each of two generations.
REMEMBERED_BYTES = 64 << 20
#: Longer stretches, in bytes, are encoded where they stand and not remembered.
LONGEST = 256
#: Stretches that one call of the library encodes together.
TOGETHER = 256

_SPACES = separators(SPACES)


class Generation:
    """Ids of stretches under their 64-bit hashes, in flat arrays."""

    def __init__(self):
        self.keys, self.start, self.size, self.ids = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.keys, self.start, self.size, self.ids))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each of the sorted ``keys``, -1 for unknown ones."""
        if len(self.keys) == 0:
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Takes up new ``keys``, sorted, whose ids stand one after the other."""
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, len(self.ids) + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.ids = np.concatenate([self.ids, ids])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(size, ids)`` of the stretches at these places."""
        size = self.size[at]
        return size, self.ids[_runs(self.start[at], size)]


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


class ChunkIds:
    """Encodes texts by their stretches between ASCII spaces, which no token crosses.

    Stretches are split, hashed and looked up as arrays; only those not known yet reach Python, and
    the library, many at a time with a special token between them, which splits a text before
    anything else is done to it. What is known sits in two generations bounded in bytes: when the
    younger is full it becomes the older, whose place it takes, and what is met again moves into the
    younger. So a worker's memory does not depend on what texts hold, and frequent stretches stay.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        # Such tokens are found before a text is normalised and take no space beside them.
        plain = [(t.content, i) for i, t in sorted(added.items()) if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip)]
        self.between, self.between_id = plain[0] if plain else (None, -1)
        self.added = [t.content for t in added.values()]
        self.remembered = remembered
        self.young, self.old = Generation(), Generation()

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(size, ids)`` of stretches, in their order."""
        whole = "\n".join(chunks)
        odd = [a for a in self.added if a in whole]
        alone = [self.between is None or any(a in c for a in odd) for c in chunks] if odd or self.between is None else [False] * len(chunks)
        groups: list[list[int]] = []
        for i in range(len(chunks)):
            if alone[i] or not groups or len(groups[-1]) >= TOGETHER or alone[groups[-1][0]]:
                groups.append([])
            groups[-1].append(i)
        sizes, found = np.zeros(len(chunks), np.int64), []
        for lo in range(0, len(groups), 64):
            part = groups[lo : lo + 64]
            texts = [(self.between or "").join(chunks[i] for i in g) for g in part]
            for g, e in zip(part, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                if len(g) > 1:
                    cuts = np.flatnonzero(ids == self.between_id)
                    sizes[g] = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
                    ids = ids[ids != self.between_id]
                else:
                    sizes[g] = len(ids)
                found.append(ids)
        return sizes, np.concatenate(found) if found else np.zeros(0, np.uint32)

    def _keep(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        if len(keys):
            self.young.add(keys, size, ids)
        if self.young.nbytes > self.remembered:
            self.young, self.old = Generation(), self.young

    def encode(self, block: Block, end: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, count per text)`` of a block's texts, each closed by ``end``."""
        words = Words(block, _SPACES)
        length = words.end - words.start
        # The length goes into the hash: stretches are told apart by 64 bits and their size.
        keys, first, number = np.unique(splitmix(words.hash + length.astype(U64)), return_index=True, return_inverse=True)
        young = self.young.find(keys)
        old = np.where(young < 0, self.old.find(keys), -1)
        here = Generation()
        for at, source in ((np.flatnonzero(young >= 0), (self.young, young)), (np.flatnonzero(old >= 0), (self.old, old))):
            here.add(keys[at], *source[0].take(source[1][at]))
        missing = np.flatnonzero((young < 0) & (old < 0))
        raw = block.data.tobytes()
        chunks = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.start[first[missing]].tolist(), words.end[first[missing]].tolist())]
        size, ids = self._encoded(chunks)
        here.add(keys[missing], size, ids)
        short = length[first[missing]] <= LONGEST
        again = np.flatnonzero(old >= 0)
        new = np.concatenate([again, missing[short]])
        new.sort()
        self._keep(keys[new], *here.take(new))
        sizes = here.size[number]
        border = np.concatenate([[0], np.cumsum(sizes)])
        counts = border[words.first[1:]] - border[words.first[:-1]]
        out = np.full(int(border[-1]) + block.rows, end, np.uint32)
        out[np.arange(int(border[-1])) + np.repeat(np.arange(block.rows), counts)] = here.ids[_runs(here.start[number], sizes)]
        return out, counts + 1


@lru_cache(maxsize=2)
def _chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def write_blocks(
    docs: DataFrame, path: str, *, tokenizer: str, vocabulary: int, end_id: int, doc_id: str = "doc_id", text: str = "text", block_ids: int = 1 << 16
) -> None:
    """Encodes ``docs`` in ascending ``(doc_id, text hash)`` order, nulls first, into packed blocks below ``path``.

    Texts are ordered by one range shuffle before they are encoded, so ids are never shuffled and
    nothing is encoded twice. One row per block: ``shard`` (range of ids), ``base`` (ids before it
    in the shard), ``bits``, ``n_ids``, ``docs`` (``doc_id, start, n`` inside the block) and
    ``payload``. A block closes after ``block_ids`` ids, at a document's end; a longer document is
    a block of its own.
    """
    bits = bits_for(max(vocabulary, end_id + 1))
    source = docs.select(
        F.col(doc_id).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"), F.col(text).alias("_text")
    )
    kind = source.schema["_id"].dataType.simpleString()
    ordered = source.repartitionByRange("_id", "_key").sortWithinPartitions("_id", "_key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _chunk_ids(tokenizer)
        shard, base = TaskContext.get().partitionId(), 0
        for batch in batches:
            for block in text_blocks(batch.column("_text"), 1 << 20):
                ids, counts = coder.encode(block, end_id)
                at = np.concatenate([[0], np.cumsum(counts)])
                row = 0
                while row < block.rows:
                    stop = max(row + 1, int(np.searchsorted(at, at[row] + block_ids, side="right")) - 1)
                    stop = min(stop, block.rows)
                    piece = ids[at[row] : at[stop]]
                    names = batch.column("_id").slice(block.row0 + row, stop - row)
                    inner = pa.StructArray.from_arrays(
                        [names, pa.array(at[row:stop] - at[row], pa.int32()), pa.array(counts[row:stop], pa.int32())], ["doc_id", "start", "n"]
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard], pa.int32()),
                            pa.array([base], pa.int64()),
                            pa.array([bits], pa.int32()),
                            pa.array([len(piece)], pa.int32()),
                            pa.ListArray.from_arrays(pa.array([0, stop - row], pa.int32()), inner),
                            pa.array([pack(piece, bits)], pa.binary()),
                        ],
                        names=["shard", "base", "bits", "n_ids", "docs", "payload"],
                    )
                    base += len(piece)
                    row = stop

    schema = f"shard int, base bigint, bits int, n_ids int, docs array<struct<doc_id: {kind}, start: int, n: int>>, payload binary"
    ordered.mapInArrow(work, schema).write.option("parquet.enable.dictionary", "false").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def documents_of(blocks: DataFrame, doc_id: str = "doc_id", ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document of a block table, with ``ids`` also the ids themselves.

    ``start`` counts the ids of all documents before it: sums per shard are added up over the
    shards, one row each, and joined back.
    """
    kind = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                payload = batch.column("payload")[i].as_py()
                bits, n = batch.column("bits")[i].as_py(), batch.column("n_ids")[i].as_py()
                inner = batch.column("docs").slice(i, 1).flatten()
                values = unpack(payload, bits, 0, n).astype("<u4")
                start = inner.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
                size = inner.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                view = memoryview(values.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * (a + b)]) for a, b in zip(start.tolist(), size.tolist())]
                base, shard = batch.column("base")[i].as_py(), batch.column("shard")[i].as_py()
                columns = [
                    inner.field("doc_id"),
                    pa.array(np.full(len(crc), shard), pa.int32()),
                    pa.array(start + base, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                if ids:
                    columns.append(pa.array([values[a : a + b].astype(np.int32) for a, b in zip(start, size)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["_id", "shard", "within", "n_tokens", "ids_crc32"] + (["ids"] if ids else [])
    schema = f"_id {kind}, shard int, within bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    found = blocks.select("shard", "base", "bits", "n_ids", "docs", "payload").mapInArrow(work, schema).join(bases, "shard")
    rest = [F.col("ids")] if ids else []
    return found.select(F.col("_id").alias(doc_id), (F.col("within") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *rest)


def token_output(docs: DataFrame, path: str, *, tokenizer: str, vocabulary: int, end_id: int, doc_id: str = "doc_id", text: str = "text", block_ids: int = 1 << 16) -> DataFrame:
    """Writes packed blocks below ``path`` and returns, from the files, ``doc_id, start, n_tokens, ids_crc32``.

    ``tokenizer`` is the path of a JSON vocabulary, ``vocabulary`` its size. Every document ends
    with ``end_id``, counted in ``n_tokens``; a null or empty text is that id alone. Null ids come
    first; rows with equal ids are separate documents in the order of their text hashes. An empty
    table writes an empty block table. Extra columns are ignored. ``ids_crc32`` is the unsigned
    checksum of the ids as little-endian unsigned 32-bit integers.
    """
    write_blocks(docs, path, tokenizer=tokenizer, vocabulary=vocabulary, end_id=end_id, doc_id=doc_id, text=text, block_ids=block_ids)
    return documents_of(read_blocks(docs.sparkSession, path), doc_id)
