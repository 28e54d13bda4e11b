"""Ranked lexical search over an index whose strata hold documents of one length normaliser."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.blocks import U64, Words, fold_table, separators, splitmix, text_blocks
from tallyloom.session import frozen

#: Terms are runs of ASCII letters, digits and all characters beyond ASCII.
BETWEEN_TERMS = separators([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_LOWER = fold_table()
#: Documents and postings of one index row, about.
ROW_DOCS, ROW_POSTINGS = 1 << 13, 1 << 20
#: Terms, with repeats, of the documents of a stratum that are indexed in one place.
PART_TERMS = 1 << 18
#: Postings that a task holds at once to order the visits to their strata.
HELD_POSTINGS = 1 << 22
#: Terms of the items that are asked together; more items go in further blocks.
ASKED_TERMS = 1 << 19


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """``values[offsets[i]:offsets[i + 1]]`` as one binary each."""
    at = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def term_counts(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """``_id, n, terms, tfs, salt`` per row with a term: how many, the distinct ones as sorted 64-bit hashes, their counts.

    ``salt`` is spread evenly and tells equal rows apart.
    """
    source = rows.select(F.col(row_id).alias("_id"), F.col(text).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for block in text_blocks(batch.column("_text")):
                words = Words(block, BETWEEN_TERMS, _LOWER)
                row = words.row
                order = np.lexsort((words.hash, row))
                row, term = row[order], words.hash[order]
                lead = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])) if len(row) else np.zeros(0, np.int64)
                tf = np.diff(np.append(lead, len(row))).astype(np.uint32)
                has = np.flatnonzero(words.counts)
                first = np.searchsorted(row[lead], np.append(has, block.rows))
                salt = splitmix(np.arange(done, done + len(has), dtype=U64) + U64(part << 40))
                done += len(has)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").take(pa.array(has + block.row0)),
                        pa.array(words.counts[has].astype(np.int64)),
                        _binary(term[lead], first),
                        _binary(tf, first),
                        pa.array(salt.view(np.int64)),
                    ],
                    names=["_id", "n", "terms", "tfs", "salt"],
                )

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(work, f"_id {kind}, n bigint, terms binary, tfs binary, salt bigint")


def normaliser(n: str, documents: int, terms: int):
    """Share of a document's length in its normaliser: 25 and 75 hundredths of its length against the mean."""
    product = f"cast(75L * {n} as decimal(18, 0)) * cast({documents}L as decimal(18, 0))"
    return F.expr(f"25L + ({product}) div cast({max(terms, 1)}L as decimal(18, 0))")


class Stratum:
    """Postings of documents with one normaliser: terms, per term groups of equal count, per group documents in order of id."""

    FIELDS = (("terms", U64), ("term_at", np.uint32), ("tfs", np.uint32), ("group_at", np.uint32), ("docs", np.uint16))

    def __init__(self, m: int, ids: pa.Array, arrays: dict[str, np.ndarray]):
        self.m, self.ids = m, ids
        self.terms, self.tfs = arrays["terms"], arrays["tfs"].astype(np.int64)
        self.term_at, self.group_at, self.docs = (arrays[c].astype(np.int64) for c in ("term_at", "group_at", "docs"))
        different, place = np.unique(self.tfs, return_inverse=True)
        # Once per count, not per posting.
        self.impact = ((1_000_000_000 * different) // (1_000 * different + 8 * m))[place]

    @staticmethod
    def arrays(counts: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
        """Of the ``(terms, tfs)`` of documents in order of id; higher counts first."""
        term = np.concatenate([t for t, _ in counts])
        tf = np.concatenate([f for _, f in counts]).astype(np.int64)
        doc = np.repeat(np.arange(len(counts)), [len(t) for t, _ in counts])
        order = np.lexsort((doc, -tf, term))
        term, tf = term[order], tf[order]
        new_term = np.concatenate([[True], term[1:] != term[:-1]])
        new_group = new_term | np.concatenate([[True], tf[1:] != tf[:-1]])
        group_at, lead = np.flatnonzero(new_group), np.flatnonzero(new_term)
        return {
            "terms": term[lead],
            "term_at": np.append(np.searchsorted(group_at, lead), len(group_at)).astype(np.uint32),
            "tfs": tf[group_at].astype(np.uint32),
            "group_at": np.append(group_at, len(term)).astype(np.uint32),
            "docs": doc[order].astype(np.uint16),
        }

    def places(self, vocabulary: np.ndarray) -> np.ndarray:
        """Index of each term of ``vocabulary``, -1 where no document holds it."""
        at = np.searchsorted(self.terms, vocabulary)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == vocabulary, at, -1)

    def holding(self, place: np.ndarray) -> np.ndarray:
        """Documents that hold the terms at ``place``."""
        return self.group_at[self.term_at[place + 1]] - self.group_at[self.term_at[place]]

    def scores(self, place: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Score of every document for terms at ``place`` with ``weight``."""
        first, last = self.term_at[place], self.term_at[place + 1]
        group = _ranges(first, last)
        gain = self.impact[group] * np.repeat(weight, last - first)
        posting = _ranges(self.group_at[first], self.group_at[last])
        gain = np.repeat(gain, self.group_at[group + 1] - self.group_at[group])
        if int(weight.astype(object).sum()) * 1_000_000 < 1 << 53:
            return np.bincount(self.docs[posting], weights=gain, minlength=len(self.ids)).astype(np.int64)
        total = np.zeros(len(self.ids), np.int64)
        np.add.at(total, self.docs[posting], gain)
        return total


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    sizes = last - first
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def document_lengths(docs: DataFrame, text: str) -> DataFrame:
    """``n, docs``: how many texts have ``n`` terms; texts without terms are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("_text")):
                yield pa.RecordBatch.from_arrays([pa.array(Words(block, BETWEEN_TERMS, hashed=False).counts.astype(np.int64))], names=["n"])

    counts = docs.select(F.col(text).alias("_text")).mapInArrow(work, "n bigint")
    return counts.filter("n > 0").groupBy("n").agg(F.count("*").alias("docs"))


def write_index(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", row_docs: int = ROW_DOCS, part_terms: int = PART_TERMS) -> tuple[int, int]:
    """Writes the strata below ``path``; returns how many documents have a term, and all their terms with repeats.

    Lengths are counted first, as every normaliser depends on all of them. Then the term counts go to
    their strata in one shuffle. A stratum of more than ``part_terms`` terms, of long documents or of a
    length that many share, is dealt over several parts, so parts stay small whatever the texts.
    """
    lengths = frozen(document_lengths(docs, text), "lengths")
    documents, terms = lengths.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("docs")), F.lit(0))).first()
    stratum = normaliser("n", documents, terms)
    parts = lengths.groupBy(stratum.alias("m")).agg(F.ceil(F.sum(F.col("n") * F.col("docs")) / part_terms).alias("parts"))
    counted = term_counts(docs, doc_id, text)
    kind = counted.schema["_id"].dataType.simpleString()
    placed = counted.withColumn("m", stratum).join(frozen(parts, "parts"), "m").withColumn("part", F.pmod("salt", "parts"))
    order = ["m", "part", F.col("_id").asc_nulls_last(), "salt"]
    ordered = placed.select("_id", "m", "part", "terms", "tfs", "salt").repartition("m", "part").sortWithinPartitions(*order).select("_id", "m", "part", "terms", "tfs")
    names = ["m", "ids", *[f for f, _ in Stratum.FIELDS]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_m, held, ids, postings = None, [], [], 0

        def close() -> pa.RecordBatch:
            arrays = Stratum.arrays(held)
            named = pa.chunked_array(ids).combine_chunks()
            whole = [pa.ListArray.from_arrays(pa.array([0, len(named)], pa.int32()), named)]
            return pa.RecordBatch.from_arrays([pa.array([held_m[0]], pa.int64()), *whole, *[pa.array([arrays[f].tobytes()], pa.binary()) for f, _ in Stratum.FIELDS]], names=names)

        for batch in batches:
            strata, terms_of, tfs_of = zip(batch.column("m").to_pylist(), batch.column("part").to_pylist()), batch.column("terms"), batch.column("tfs")
            for row, m in enumerate(strata):
                if held and (m != held_m or len(held) >= min(row_docs, 1 << 16) or postings >= ROW_POSTINGS):
                    yield close()
                    held, ids, postings = [], [], 0
                term = np.frombuffer(terms_of[row].as_py(), U64)
                held_m = m
                held.append((term, np.frombuffer(tfs_of[row].as_py(), np.uint32)))
                ids.append(batch.column("_id").slice(row, 1))
                postings += len(term)
        if held:
            yield close()

    schema = f"m bigint, ids array<{kind}>, " + ", ".join(f"{f} binary" for f, _ in Stratum.FIELDS)
    ordered.mapInArrow(work, schema).write.option("parquet.enable.dictionary", "false").parquet(path)
    return documents, terms


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class _Asked:
    """Items of one block: their terms as places in a common vocabulary, with how often each occurs."""

    def __init__(self, rows: pa.Table):
        terms = [np.frombuffer(t, U64) for t in rows.column("terms").to_pylist()]
        self.ids = rows.column("_id").combine_chunks()
        self.vocabulary = np.unique(np.concatenate(terms)) if terms else np.zeros(0, U64)
        self.slots = [np.searchsorted(self.vocabulary, t) for t in terms]
        self.times = [np.frombuffer(t, np.uint32).astype(np.int64) for t in rows.column("tfs").to_pylist()]


def _frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Documents of the index that hold each term of ``vocabulary``; sums per task meet in one small aggregate."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                terms, term_at, group_at = (np.frombuffer(batch.column(c)[row].as_py(), k) for c, k in (("terms", U64), ("term_at", np.uint32), ("group_at", np.uint32)))
                holding = np.diff(group_at[term_at].astype(np.int64))
                at = np.searchsorted(terms, vocabulary)
                at[at == len(terms)] = 0
                total += np.where(terms[at] == vocabulary, holding[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["slot", "df"])

    found = index.select("terms", "term_at", "group_at").mapInArrow(work, "slot int, df bigint").groupBy("slot").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[found.column("slot").to_numpy()] = found.column("df").to_numpy()
    return df


def ranked_search(
    index: DataFrame, documents: int, items: DataFrame, *, item_id: str = "item_id", text: str = "text", k: int = 10, asked_terms: int = ASKED_TERMS, held_postings: int = HELD_POSTINGS
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of an index for every item.

    A term weighs ``floor(1000 * ln((2 * documents + 2) / (2 * df + 1)))``; a document scores, over
    the item's terms with repeats, weight times impact, which depends on the term's count and the
    document's normaliser alone. A task looks at as many strata as it may hold: the highest counts of
    an item's terms bound what a stratum can give, strata are visited by falling bound, and an item
    leaves the rest alone once the bound falls below the k-th score it has found. Only scores above
    0 are returned, equal ones by ascending id, null ids last.

    Items are collected in blocks of about ``asked_terms`` terms, so what a task is sent is bounded;
    an item without terms has no result. Items equal in id and terms are one item; equal ids with
    other terms are items of their own, null ids included.
    """
    asked = frozen(term_counts(items, item_id, text).dropDuplicates(["_id", "terms", "tfs"]).select("_id", "terms", "tfs"), "items")
    many = asked.agg(F.coalesce(F.sum(F.length("terms")), F.lit(0))).first()[0] // 8
    blocks = max(1, -(-many // asked_terms))
    item_kind, doc_kind = asked.schema["_id"].dataType.simpleString(), index.schema["ids"].dataType.elementType.simpleString()
    schema = f"item int, _item {item_kind}, _doc {doc_kind}, score bigint"
    out = []
    for number in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("_id", "terms", "tfs"), F.lit(blocks)) == number)
        of = _Asked(block.orderBy(F.col("_id").asc_nulls_last(), "terms", "tfs").toArrow())
        df = _frequencies(index, of.vocabulary)
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        out.append(index.mapInArrow(_visits(of, weight, k, held_postings), schema).withColumn("block", F.lit(number)))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    best = Window.partitionBy("block", "item").orderBy(F.col("score").desc(), F.col("_doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("_item").alias(item_id), "rank", F.col("_doc").alias("doc_id"), "score")


def _visits(of: _Asked, weight: np.ndarray, k: int, held_postings: int):
    def best_of(item: int, strata: list[Stratum], places: np.ndarray, bounds: np.ndarray, best: list) -> None:
        slots, times = of.slots[item], of.times[item]
        for s in np.argsort(-bounds, kind="stable").tolist():
            least = -best[-1][0] if len(best) == k else 1
            if bounds[s] < least:
                return
            place = places[s][slots]
            has = np.flatnonzero(place >= 0)
            scores = strata[s].scores(place[has], (weight[slots] * times)[has])
            good = np.flatnonzero(scores >= least)
            if len(good) > k:
                good = good[scores[good] >= np.partition(scores[good], len(good) - k)[len(good) - k]]
            # Documents stand in order of id, so the first of equal scores are the smaller ids.
            good = good[np.lexsort((good, -scores[good]))[:k]]
            names = strata[s].ids.take(pa.array(good)).to_pylist()
            best += [(-score, name is None, name) for score, name in zip(scores[good].tolist(), names)]
            best.sort(key=lambda found: found if found[2] is not None else found[:2])
            del best[k:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in of.ids]
        held: list[Stratum] = []
        lead = np.concatenate([[0], np.cumsum([len(s) for s in of.slots])])[:-1].astype(np.int64)
        slots = np.concatenate(of.slots) if of.slots else np.zeros(0, np.int64)
        times = np.concatenate(of.times) if of.times else np.zeros(0, np.int64)

        def visit() -> None:
            places, bounds = [], []
            for stratum in held:
                place = stratum.places(of.vocabulary)
                # The first group of a term has its highest count, and the highest impact.
                most = np.where(place >= 0, weight * stratum.impact[stratum.term_at[np.maximum(place, 0)]], 0)
                places.append(place)
                bounds.append(np.add.reduceat(most[slots] * times, lead))
            for item, bound in enumerate(np.stack(bounds, axis=1)):
                best_of(item, held, places, bound, best[item])

        size, named = 0, pa.null()
        for batch in batches:
            named = batch.column("ids").type.value_type
            for row in range(batch.num_rows if len(of.ids) else 0):
                arrays = {c: np.frombuffer(batch.column(c)[row].as_py(), kind) for c, kind in Stratum.FIELDS}
                held.append(Stratum(batch.column("m")[row].as_py(), batch.column("ids").slice(row, 1).flatten(), arrays))
                size += len(arrays["docs"])
                if size >= held_postings:
                    visit()
                    held, size = [], 0
        if held:
            visit()
        for item, found in enumerate(best):
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item] * len(found), pa.int32()),
                        of.ids.take(pa.array([item] * len(found))),
                        pa.array([name for _, _, name in found], named),
                        pa.array([-score for score, _, _ in found], pa.int64()),
                    ],
                    names=["item", "_item", "_doc", "score"],
                )

    return work


def index_search(docs: DataFrame, items: DataFrame, path: str, *, k: int = 10) -> DataFrame:
    """Indexes ``docs`` below ``path`` and ranks them for every item; see ``write_index`` and ``ranked_search``.

    Null and empty texts have no terms: such documents are in no stratum, such items in no result.
    Rows with equal ids are separate documents. An empty table on either side gives an empty result;
    extra columns are ignored. Terms are told apart by 64-bit hashes.
    """
    documents, _ = write_index(docs, path)
    return ranked_search(read_index(docs.sparkSession, path), documents, items, k=k)
