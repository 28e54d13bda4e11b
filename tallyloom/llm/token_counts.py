"""Token counts by byte-pair merging on a heap and a linked list."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm.blocks import text_blocks

#: Chunks and words whose counts a worker keeps; a full memory is dropped and filled anew.
REMEMBERED = 500_000
#: Longer ones, in bytes or characters, are counted where they stand, so a memory has a bound in bytes too.
LONGEST = 256


def byte_symbols() -> list[str]:
    """One printable character per byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


class MergeTable:
    """Ranks of a word-level byte-pair vocabulary file, and the counting itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        symbols = byte_symbols()
        self.inner = [self.ids.get(s) for s in symbols]
        self.final = [self.ids.get(s + self.suffix) for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # White space as Unicode defines it, whatever the engine's shorthand covers.
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.special = {t["content"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None
        self.marks = {s[:2].encode() for s in self.special}
        self.normalizer = Tokenizer.from_file(path).normalizer

    def count_word(self, word: bytes) -> int:
        """Symbols at the start minus merges made, the lowest-rank adjacent pair first, leftmost among equals."""
        ids = [s for s in [*map(self.inner.__getitem__, word[:-1]), self.final[word[-1]]] if s is not None]
        n = len(ids)
        if n < 2:
            return n
        merges = self.merges
        heap = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found is not None:
                heap.append((found[0], i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        tokens = n
        while heap:
            _, at, left, right = heapq.heappop(heap)
            nxt = after[at]
            if ids[at] != left or nxt < 0 or ids[nxt] != right:
                continue  # one side has been merged since
            merged = merges[left, right][1]
            ids[at], ids[nxt] = merged, -1
            following = after[nxt]
            after[at] = following
            tokens -= 1
            if following >= 0:
                before[following] = at
                found = merges.get((merged, ids[following]))
                if found is not None:
                    heapq.heappush(heap, (found[0], at, merged, ids[following]))
            previous = before[at]
            if previous >= 0:
                found = merges.get((ids[previous], merged))
                if found is not None:
                    heapq.heappush(heap, (found[0], previous, ids[previous], merged))
        return tokens

    def count_piece(self, piece: str, words: dict[str, int]) -> int:
        text = piece.lower() if piece.isascii() else self.normalizer.normalize_str(piece)
        total = 0
        for word in self.pattern.findall(text):
            known = words.get(word)
            if known is None:
                known = self.count_word(word.encode())
                if len(word) <= LONGEST:
                    words[word] = known
            total += known
        return total


class ChunkCounts(dict):
    """Tokens per stretch of text between ASCII spaces; no token crosses those."""

    def __init__(self, table: MergeTable):
        super().__init__()
        self.table, self.words = table, {}

    def __missing__(self, chunk: bytes) -> int:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        table = self.table
        text = chunk.decode("utf-8", "replace")
        if any(mark in chunk for mark in table.marks):
            pieces = table.specials.split(text)
            n = sum(1 if p in table.special else table.count_piece(p, self.words) for p in pieces if p)
        else:
            n = table.count_piece(text, self.words)
        if len(chunk) <= LONGEST:
            self[chunk] = n
        return n


@lru_cache(maxsize=2)
def _counts(path: str) -> ChunkCounts:
    return ChunkCounts(MergeTable(path))


def token_counts(docs: DataFrame, *, tokenizer: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row; no identifier is ever produced.

    ``tokenizer`` is the path of a JSON vocabulary with word-end byte pairs. Counts equal the
    library's without begin or end tokens; special strings in a text count one each. Null text is
    empty and has 0 tokens. Rows keep their id whatever it is, null and repeated ones included; an
    empty table gives an empty result. Extra columns are ignored. Runs without a shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(tokenizer)
        get = counts.__getitem__
        for batch in batches:
            totals = []
            for block in text_blocks(batch.column("_text")):
                raw, offsets = block.data.tobytes(), block.offsets.tolist()
                for lo, hi in zip(offsets, offsets[1:]):
                    totals.append(sum(map(get, raw[lo:hi].split())))
                    if len(counts) > REMEMBERED:
                        counts.clear()
            sizes = batch.column("_bytes")
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), sizes, pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_())],
                names=["_id", "n_bytes", "n_tokens", "over_limit"],
            )

    source = docs.select(
        F.col(doc_id).alias("_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes"),
        F.col(text).alias("_text"),
    )
    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(work, f"_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("_id", doc_id)
