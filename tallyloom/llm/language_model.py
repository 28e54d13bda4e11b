"""Scores texts by context-tree weighting learnt from a share of the corpus, beside a unigram base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.blocks import SPACES, U64, Words, fold_table, separators, text_blocks
from tallyloom.llm.context_tree import Crown, Subtrees, bucket_of, grams_of
from tallyloom.llm.packed import Tally, add_up, from_bytes
from tallyloom.session import frozen

SEPARATORS = separators(SPACES)
FOLD = fold_table()

#: Closes every text; no UTF-8 text holds this byte.
END = 0xFF

#: Entries of the tables every task gets, by use; what they lack is joined by a shuffle instead.
HEAVY_GRAMS = 1_000_000
HEAVY_WORDS = 1_000_000

GRAM, WORD = 0, 1


def _closed(block) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of a block with ``END`` after every text."""
    rows = block.rows
    first = block.offsets + np.arange(rows + 1)
    data = np.full(int(first[-1]), END, np.uint8)
    inside = np.ones(len(data), bool)
    inside[first[1:] - 1] = False
    data[inside] = FOLD[block.data]
    return data, first


def _counted(source: DataFrame, buckets: int) -> DataFrame:
    """Packed ``kind, bucket, keys, learnt, used``: how often each gram and word occurs in training and in all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = batch.column("_train").to_numpy(zero_copy_only=False)
            tallies = {GRAM: Tally(2), WORD: Tally(2)}
            for block in text_blocks(batch.column("_text")):
                here = train[block.row0 : block.row0 + block.rows]
                data, first = _closed(block)
                words = Words(block, SEPARATORS, FOLD)
                for kind, keys, mask in (
                    (GRAM, grams_of(data, first), np.repeat(here, np.diff(first))),
                    (WORD, words.hash, np.repeat(here, words.counts)),
                ):
                    for part, learnt in ((keys[mask], 1), (keys[~mask], 0)):
                        ordered = np.sort(part)
                        lead = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
                        size = np.diff(np.append(lead, len(ordered)))
                        tallies[kind].add(ordered[lead], size * learnt, size)
            rows = []
            for kind, tally in tallies.items():
                keys, learnt, used = tally.result()
                bucket = bucket_of(keys, buckets) if kind == GRAM else (keys >> U64(40)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                keys, learnt, used, bucket = keys[order], learnt[order], used[order], bucket[order]
                cut = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
                for b, (i, j) in enumerate(zip(cut, cut[1:])):
                    if j > i:
                        rows.append((kind, b, keys[i:j].tobytes(), learnt[i:j].astype("<u4").tobytes(), used[i:j].astype("<u4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                    names=["kind", "bucket", "keys", "learnt", "used"],
                )

    def gather(table: pa.Table) -> pa.Table:
        keys = from_bytes(table.column("keys").to_pylist(), U64)
        counts = [from_bytes(table.column(c).to_pylist(), "<u4").astype(np.int64) for c in ("learnt", "used")]
        keys, learnt, used = add_up(keys, *counts)
        return pa.table(
            {
                "kind": table.column("kind").slice(0, 1),
                "bucket": table.column("bucket").slice(0, 1),
                "keys": pa.array([keys.tobytes()], pa.binary()),
                "learnt": pa.array([learnt.astype("<i8").tobytes()], pa.binary()),
                "used": pa.array([used.astype("<i8").tobytes()], pa.binary()),
                "tokens": pa.array([int(learnt.sum())], pa.int64()),
                "distinct": pa.array([int((learnt > 0).sum())], pa.int64()),
            }
        )

    blocks = source.mapInArrow(work, "kind int, bucket int, keys binary, learnt binary, used binary")
    return blocks.groupBy("kind", "bucket").applyInArrow(
        gather, "kind int, bucket int, keys binary, learnt binary, used binary, tokens bigint, distinct bigint"
    )


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        yield tuple(np.frombuffer(batch.column(c)[i].as_py(), k) for c, k in (("keys", U64), ("learnt", "<i8"), ("used", "<i8")))


def _crown(counts: DataFrame) -> Crown:
    """Shared upper nodes: partial sums per bucket, added up; one row per node, 65,280 at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, learnt, _ in _unpacked(batch):
                tree = Subtrees(gram, learnt)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree.roots.view(np.int64)), pa.array(tree.root_n0), pa.array(tree.root_n1), pa.array(tree.root_total)],
                    names=["node", "n0", "n1", "below"],
                )

    parts = counts.filter(F.col("kind") == GRAM).select("keys", "learnt", "used")
    rows = parts.mapInArrow(work, "node bigint, n0 bigint, n1 bigint, below double")
    nodes = rows.groupBy("node").agg(F.sum("n0"), F.sum("n1"), F.sum("below")).collect()
    columns = list(zip(*nodes)) or [(), (), (), ()]
    return Crown(np.array(columns[0], np.int64).view(U64), *[np.array(c, np.int64) for c in columns[1:3]], np.array(columns[3], float))


def _gram_table(counts: DataFrame, crown: Crown) -> DataFrame:
    """``key, learnt, used, value``: the log10 probability of every gram that occurs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, learnt, used in _unpacked(batch):
                value = crown.log10(gram, Subtrees(gram, learnt).probability())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(learnt), pa.array(used), pa.array(value)], names=["key", "learnt", "used", "value"]
                )

    rows = counts.filter(F.col("kind") == GRAM).select("keys", "learnt", "used")
    return rows.mapInArrow(work, "key bigint, learnt bigint, used bigint, value double")


def _word_table(counts: DataFrame, total: float) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, learnt, used in _unpacked(batch):
                word, learnt, used = word[learnt > 0], learnt[learnt > 0], used[learnt > 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.view(np.int64)), pa.array(learnt), pa.array(used), pa.array(np.log10((learnt + 0.5) / total))],
                    names=["key", "learnt", "used", "value"],
                )

    rows = counts.filter(F.col("kind") == WORD).select("keys", "learnt", "used")
    return rows.mapInArrow(work, "key bigint, learnt bigint, used bigint, value double")


def _heavy(table: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The most used entries, ``limit`` at most: keys in order and their values."""
    octave = F.floor(F.log2(F.col("used").cast("double")) * 8)
    steps = table.groupBy(octave.alias("step")).agg(F.count("*").alias("n"), F.min("used").alias("least")).orderBy(F.desc("step")).collect()
    kept, least = 0, None
    for row in steps:
        kept += row.n
        if kept > limit:
            break
        least = row.least
    if least is None:
        return np.zeros(0, U64), np.zeros(0)
    found = table.filter(F.col("used") >= least).select("key", "value").toArrow()
    keys = found.column("key").to_numpy().view(U64)
    order = np.argsort(keys)
    return keys[order], found.column("value").to_numpy()[order]


def _lookup(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions of ``keys`` in a sorted table, -1 where absent."""
    if len(table) == 0:
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _scored(source: DataFrame, heavy, spark) -> DataFrame:
    """Per row the sums over heavy entries, and the rest as ``tail`` (``kind, key, n``)."""
    kind_of_id = source.schema["_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(heavy)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            for block in text_blocks(batch.column("_text")):
                data, first = _closed(block)
                words = Words(block, SEPARATORS, FOLD)
                rows = block.rows
                sums, known, tails = {}, None, []
                for kind, keys, row in (
                    (GRAM, grams_of(data, first), np.repeat(np.arange(rows), np.diff(first))),
                    (WORD, words.hash, words.row),
                ):
                    order = np.lexsort((row, keys)) if kind == WORD or rows >= 1 << 16 else None
                    if order is None:
                        # 48-bit grams leave room for the row, so one plain sort brings equal pairs together.
                        both = np.sort((keys << U64(16)) | row.astype(U64))
                        keys, row = both >> U64(16), (both & U64(0xFFFF)).astype(np.int64)
                    else:
                        keys, row = keys[order], row[order]
                    new = np.ones(len(keys), bool)
                    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
                    lead = np.flatnonzero(new)
                    n = np.diff(np.append(lead, len(keys)))
                    keys, row = keys[lead], row[lead]
                    at = _lookup(keys, tables[kind][0])
                    found = at >= 0
                    value = tables[kind][1][at[found]]
                    sums[kind] = np.bincount(row[found], weights=value * n[found], minlength=rows).astype(float)
                    if kind == WORD:
                        known = np.bincount(row[found], weights=n[found], minlength=rows).astype(np.int64)
                    rest = np.flatnonzero(~found)
                    tails.append((row[rest], np.full(len(rest), kind), keys[rest], n[rest]))
                row, kinds, keys, n = (np.concatenate(c) for c in zip(*tails))
                order = np.argsort(row, kind="stable")
                inner = pa.StructArray.from_arrays(
                    [pa.array(kinds[order], pa.int32()), pa.array(keys[order].view(np.int64)), pa.array(n[order], pa.int64())], ["kind", "key", "n"]
                )
                border = np.searchsorted(row[order], np.arange(rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(block.row0, rows) for c in ("_id", "_key", "_train")],
                        pa.array(np.diff(block.offsets)),
                        pa.array(words.counts, pa.int64()),
                        pa.array(known),
                        pa.array(sums[WORD]),
                        pa.array(sums[GRAM]),
                        pa.ListArray.from_arrays(pa.array(border, pa.int32()), inner),
                    ],
                    names=["_id", "_key", "_train", "n_bytes", "n_words", "known", "base", "score", "tail"],
                )

    return source.mapInArrow(
        work,
        f"_id {kind_of_id}, _key bigint, _train boolean, n_bytes bigint, n_words bigint, known bigint, base double, score double, "
        "tail array<struct<kind: int, key: bigint, n: bigint>>",
    )


def context_tree_scores(
    docs: DataFrame,
    *,
    train: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    heavy_grams: int = HEAVY_GRAMS,
    heavy_words: int = HEAVY_WORDS,
) -> DataFrame:
    """Scores every text by a model learnt from the rows where ``train`` holds.

    Returns ``doc_id, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``
    per row. ``score`` is the log10 probability of the text's bytes (A-Z lower-cased) and an end
    symbol; ``bits_per_byte`` the code length it stands for, per byte and end symbol. ``base_score``
    adds ``log10((c + 0.5) / (N + 0.5 * (V + 1)))`` over the words and one end token.

    Counts of all grams and words come from all training rows. Tasks look up the most used
    entries in tables of a fixed size; all other (text, gram) and (text, word) pairs are joined
    with the full tables by a shuffle, so nothing is left out. Null ``train`` means false, null
    text is empty (one end symbol). Without training rows every byte costs eight bits. Null and
    repeated ids are kept row by row. An empty table gives an empty result. Extra columns are
    ignored. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(
        F.col(doc_id).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"),
        F.coalesce(train, F.lit(False)).alias("_train"),
        F.col(text).alias("_text"),
    )
    counts = frozen(_counted(source.select("_train", "_text"), buckets), "counts")
    learnt = source.agg(F.count_if("_train").alias("ends")).first().ends
    words = counts.filter(F.col("kind") == WORD).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    n_all = words.n + learnt
    total = n_all + 0.5 * (words.v + (1 if learnt else 0) + 1)
    gram_table = frozen(_gram_table(counts, _crown(counts)), "grams")
    word_table = frozen(_word_table(counts, total), "words")
    heavy = (_heavy(gram_table, heavy_grams), _heavy(word_table, heavy_words))
    scored = frozen(_scored(source, heavy, spark), "scores")

    values = gram_table.select(F.lit(GRAM).alias("kind"), "key", "learnt", "value").unionByName(
        word_table.select(F.lit(WORD).alias("kind"), "key", "learnt", "value")
    )
    unseen = F.lit(float(np.log10(0.5 / total)))
    is_word = F.col("kind") == WORD
    tail = scored.select("_id", "_key", F.inline("tail")).join(values, ["kind", "key"], "left")
    rest = tail.groupBy(F.col("_id").alias("_rid"), F.col("_key").alias("_rkey")).agg(
        F.sum(F.when(is_word, F.coalesce("value", unseen) * F.col("n"))).alias("base_more"),
        F.sum(F.when(~is_word, F.col("value") * F.col("n"))).alias("score_more"),
        F.sum(F.when(is_word & F.col("learnt").isNotNull(), F.col("n"))).alias("known_more"),
    )
    # Rows equal in id and text put the same tail in once each.
    copies = scored.groupBy(F.col("_id").alias("_cid"), F.col("_key").alias("_ckey")).agg(F.count("*").alias("copies"))
    end_value = float(np.log10((learnt + 0.5) / total))
    joined = scored.drop("tail").join(rest, F.expr("_id <=> _rid and _key = _rkey"), "left").join(copies, F.expr("_id <=> _cid and _key = _ckey"))

    def more(name: str) -> Column:
        return F.coalesce(F.col(name) / F.col("copies"), F.lit(0))

    score = F.col("score") + more("score_more")
    return joined.select(
        F.col("_id").alias(doc_id),
        F.col("_train").alias("train"),
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + more("known_more").cast("long") + F.lit(1 if learnt else 0)).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + more("base_more") + F.lit(end_value)).alias("base_score"),
        score.alias("score"),
        (-score * F.lit(float(np.log2(10))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
