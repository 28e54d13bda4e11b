"""Exact set-similarity self-join of word shingles by vertical partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.blocks import SPACES, U64, Rolling, Words, fold_table, grams, separators, splitmix, starts_within, text_blocks
from tallyloom.llm.components import components
from tallyloom.llm.packed import add_up, from_bytes
from tallyloom.session import frozen

SEPARATORS = separators(SPACES)
FOLD = fold_table()

#: Share of the shingle order in the first fragment, which is counted before the others are looked at.
FIRST_FRAGMENT = 0.35
#: Fragments in which overlaps of candidate pairs are counted apart.
FRAGMENTS = 8

_FIVE = 5  # bytes per packed value
_MASK = U64((1 << 40) - 1)


def shingle_sets(block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, shingle)`` of a block, distinct and sorted; fewer than ``n`` words are one shingle."""
    words = Words(block, SEPARATORS, FOLD)
    gram = grams(words.hash, n)
    at = np.flatnonzero(starts_within(words.first, n, len(words.hash))[: len(gram)])
    row = np.searchsorted(words.first, at, side="right") - 1
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < n))
    whole = splitmix(Rolling(words.hash).ranges(words.first[short], words.first[short + 1]) + counts[short].astype(U64))
    row, shingle = np.concatenate([row, short]), np.concatenate([gram[at], whole])
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    return row[new], shingle[new]


def _first_border() -> np.uint64:
    return U64(int(FIRST_FRAGMENT * (1 << 64)))


def _describe(source: DataFrame, n: int) -> DataFrame:
    """Per row: set size, size in the first fragment, and two sums that identify the set."""
    kind = source.schema["_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        border = _first_border()
        for batch in batches:
            for block in text_blocks(batch.column("_text")):
                row, shingle = shingle_sets(block, n)
                at = np.searchsorted(row, np.arange(block.rows + 1))
                sums = [np.concatenate([[U64(0)], np.cumsum(splitmix(shingle + U64(seed)))]) for seed in (1, 2)]
                first = np.concatenate([[0], np.cumsum(shingle < border)])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(block.row0, block.rows) for c in ("_id", "_key", "_ref")],
                        pa.array(np.diff(at), pa.int64()),
                        pa.array(first[at[1:]] - first[at[:-1]], pa.int64()),
                        *[pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums],
                    ],
                    names=["_id", "_key", "_ref", "n", "n_first", "c1", "c2"],
                )

    return source.mapInArrow(work, f"_id {kind}, _key bigint, _ref bigint, n bigint, n_first bigint, c1 bigint, c2 bigint")


def _five(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_FIVE]).tobytes()


def _from_five(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, _FIVE)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :_FIVE] = raw
    return out.view("<u8").reshape(-1).astype(U64)


def _repeats(source: DataFrame, n: int, buckets: int) -> DataFrame:
    """``ref, r``: how many first-fragment shingles of a text occur in another one, or a little more.

    Shingles travel packed, a block of them per bucket of the order, so the shuffle holds ten bytes
    each. Values are cut to 40 bits; collisions can only raise ``r``, which stays an upper bound.
    Shingles met twice in one batch are known to repeat: one copy travels on, their texts are
    counted on the spot, so a shingle that a third of all texts hold adds one entry per batch.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        border = _first_border()
        turn = 0
        for batch in batches:
            refs = batch.column("_ref").to_numpy(zero_copy_only=False).view(U64) & _MASK
            some, owner = [np.zeros(0, U64)], [np.zeros(0, U64)]
            for block in text_blocks(batch.column("_text")):
                row, shingle = shingle_sets(block, n)
                low = shingle < border
                some.append(shingle[low]), owner.append(refs[row[low] + block.row0])
            shingle, owner = np.concatenate(some), np.concatenate(owner)
            order = np.argsort(shingle)
            shingle, owner = shingle[order], owner[order]
            new = np.ones(len(shingle), bool)
            new[1:] = shingle[1:] != shingle[:-1]
            lead = np.flatnonzero(new)
            size = np.diff(np.append(lead, len(shingle)))
            several = np.repeat(size > 1, size)
            sure, counts = np.unique(owner[several], return_counts=True)
            # The first text of a local group speaks for it with reference 0.
            token, speaker = shingle[lead], np.where(size > 1, U64(0), owner[lead])
            bucket = (token.astype(np.float64) / float(border) * buckets).astype(np.int64).clip(0, buckets - 1)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = [(b, _five(token[i:j] & _MASK), _five(speaker[i:j]), b"", b"") for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if j > i]
            rows.append((turn % buckets, b"", b"", _five(sure), counts.astype("<u4").tobytes()))
            turn += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))],
                names=["bucket", "tokens", "refs", "sure", "counts"],
            )

    def gather(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).to_pylist() for c in ("tokens", "refs", "sure", "counts")}
        token, ref = _from_five(column["tokens"]), _from_five(column["refs"])
        order = np.argsort(token)
        token, ref = token[order], ref[order]
        same = np.zeros(len(token), bool)
        same[1:] = token[1:] == token[:-1]
        again = same.copy()
        again[:-1] |= same[1:]
        # A local group's speaker is enough: its lone partners elsewhere must be counted.
        found = ref[again & (ref != 0)]
        sure, counts = _from_five(column["sure"]), np.frombuffer(b"".join(column["counts"]), "<u4").astype(np.int64)
        every, weight = np.concatenate([found, sure]), np.concatenate([np.ones(len(found), np.int64), counts])
        names, total = add_up(every, weight)
        part = (names % U64(buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        names, total = names[order], total[order]
        cut = np.searchsorted(part[order], np.arange(buckets + 1)).tolist()
        rows = [(b, _five(names[i:j]), total[i:j].astype("<u4").tobytes()) for b, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("part", "refs", "counts"), columns, (pa.int32(), pa.binary(), pa.binary()))})

    def total(table: pa.Table) -> pa.Table:
        names = _from_five(table.column("refs").to_pylist())
        names, counts = add_up(names, from_bytes(table.column("counts").to_pylist(), "<u4").astype(np.int64))
        return pa.table({"ref": pa.array(names.view(np.int64)), "r": pa.array(counts)})

    blocks = source.select("_ref", "_text").mapInArrow(deal, "bucket int, tokens binary, refs binary, sure binary, counts binary")
    parts = blocks.groupBy("bucket").applyInArrow(gather, "part int, refs binary, counts binary")
    return parts.groupBy("part").applyInArrow(total, "ref bigint, r bigint")


def _tokens(source: DataFrame, n: int) -> DataFrame:
    """``ref, n, tokens``: whole sets of a few texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("_text")):
                row, shingle = shingle_sets(block, n)
                at = np.searchsorted(row, np.arange(block.rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_ref").slice(block.row0, block.rows),
                        pa.array(np.diff(at), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(shingle.view(np.int64))),
                    ],
                    names=["ref", "n", "tokens"],
                )

    return source.select("_ref", "_text").mapInArrow(work, "ref bigint, n bigint, tokens array<bigint>")


def _similar(overlap: Column, left: Column, right: Column, percent: int) -> Column:
    return overlap * 100 >= F.lit(percent) * (left + right - overlap)


def _probe(percent: int):
    """Overlaps of sent texts with all texts of a part, by an inverted index over the part's shingles."""

    def work(here: pa.Table, sent: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if here.num_rows and sent.num_rows:
            column = here.column("tokens").combine_chunks()
            token = column.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(here.num_rows), column.value_lengths().to_numpy(zero_copy_only=False))
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            ref, size, root = (here.column(c).to_numpy() for c in ("ref", "n", "root"))
            theirs = sent.column("tokens").combine_chunks()
            other, count, mine = (sent.column(c).to_numpy() for c in ("ref", "n", "root"))
            for i in range(sent.num_rows):
                wanted = theirs[i].values.to_numpy(zero_copy_only=False)
                lo, hi = np.searchsorted(token, wanted, "left"), np.searchsorted(token, wanted, "right")
                spread = hi - lo
                at = np.arange(int(spread.sum())) - np.repeat(np.cumsum(spread) - spread - lo, spread)
                overlap = np.bincount(owner[at], minlength=here.num_rows)
                hit = np.flatnonzero((100 * overlap >= percent * (size + count[i] - overlap)) & (root != mine[i]))
                if len(hit):
                    one = np.unique(root[hit], return_index=True)[1]
                    out_a.extend([other[i]] * len(one)), out_b.extend(ref[hit[one]])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return work


def similarity_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, group`` per row.

    Two rows link when ``100 * intersection >= percent * union`` of their shingle sets;
    ``component_id`` is the smallest id reachable by links, the row's own included; ``group`` a
    number all rows of a component share, null for texts without words. Exact:

    1. The global shingle order (by hash) is cut into fragments. Overlaps inside the first are
       bounded by how many of a text's shingles repeat at all; what the other fragments can add
       is bounded by their size. Texts that stay below ``percent`` that way link with nothing.
    2. Equal sets become one class; only its representative goes on.
    3. Representatives order their shingles by document frequency, rarest first, and index the
       prefix that two linked texts must share in part. Per indexed shingle, each text is paired
       with the most central one; overlaps of these pairs are counted fragment by fragment and
       summed up.
    4. Texts that then stand apart from another text of the same list are sent to the parts that
       hold their lists, where an inverted index counts their overlap with every text at once.
       No list is ever expanded into all its pairs.

    Words are separated by the bytes 0x20 and 0x09-0x0D after A-Z are lower-cased, and compared by
    64-bit hashes. Texts without words, null ones too, link with nothing. Null ids never become a
    component's id unless it holds no other; rows equal in id and text are separate rows of one
    class. An empty table gives an empty result. Extra columns are ignored.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(
        F.col(doc_id).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"), F.col(text).alias("_text")
    ).withColumn("_ref", F.xxhash64("_id", "_key"))
    described = frozen(_describe(source, words), "sets")
    repeats = _repeats(source, words, parts)
    bound = F.coalesce("r", F.lit(0)) + F.col("n") - F.col("n_first")
    alive = (
        described.filter("n > 0")
        .withColumn("_short", F.col("_ref").bitwiseAND(F.lit((1 << 40) - 1)))
        .join(repeats, F.col("_short") == F.col("ref"), "left")
        .filter(bound * 100 >= F.col("n") * percent)
    )
    classes = ["c1", "c2", "n"]
    reps = frozen(alive.groupBy(*classes).agg(F.min(F.struct("_ref", "_id", "_key")).alias("rep")).select(*classes, "rep.*"), "reps")
    wanted = reps.select(F.col("_id").alias("_rid"), F.col("_key").alias("_rkey"))
    # The list grows with the corpus: a shuffle at any size, without sorting the texts.
    chosen = source.join(wanted.hint("shuffle_hash"), F.expr("_id <=> _rid and _key = _rkey"), "left_semi").dropDuplicates(["_id", "_key"])
    sets = _tokens(chosen, words)
    sets = frozen(_ordered(frozen(sets, "tokens"), percent), "ordered")
    links = frozen(_links(sets, percent, parts), "links")
    linked = components(links, "links").select(F.col("node").alias("_ref"), "root")
    names = described.filter("n > 0").groupBy(*classes).agg(F.min("_id").alias("smallest"))
    rooted = names.join(reps.select(*classes, "_ref").join(linked, "_ref"), classes, "left")
    united = rooted.filter("root is not null").groupBy("root").agg(F.min("smallest").alias("together"))
    component = rooted.join(united, "root", "left").select(
        *classes, F.coalesce("together", "smallest").alias("component_id"), F.coalesce("root", F.xxhash64(*classes)).alias("group")
    )
    return described.join(component, classes, "left").select(
        F.col("_id").alias(doc_id),
        F.col("_key").alias("text_hash"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"),
        "group",
    )


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """``ref, n, tokens, prefix, central``: repeated shingles, rarest first, of texts that can still link.

    ``prefix`` counts those that must be indexed: ``n - ceil(percent% of n) + 1`` in the full
    order, in which shingles of one text only come first.
    """
    rows = sets.select("ref", "n", F.explode("tokens").alias("token"))
    frequency = rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    known = rows.join(frequency, "token").groupBy("ref", "n").agg(F.collect_list(F.struct("df", "token")).alias("found"))
    kept = known.filter(F.size("found") * 100 >= F.col("n") * percent)
    needed = F.ceil(F.col("n") * percent / 100)
    weight = F.aggregate("found", F.lit(0.0), lambda a, x: a + F.log(x.df.cast("double")))
    return kept.select(
        "ref",
        "n",
        F.transform(F.array_sort("found"), lambda x: x.token).alias("tokens"),
        (F.size("found") - needed + 1).cast("int").alias("prefix"),
        (weight / F.col("n")).alias("central"),
    )


def _links(sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links ``a, b`` between representatives, enough to connect every two that are similar."""
    indexed = frozen(
        sets.filter("prefix > 0").select("ref", "n", "central", F.explode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("token")), "index"
    )
    leaders = indexed.groupBy("token").agg(F.max(F.struct("central", "ref", "n")).alias("lead"), F.count("*").alias("size")).filter("size > 1")
    leaders = frozen(leaders.select("token", F.col("lead.ref").alias("lead"), F.col("lead.n").alias("lead_n")), "leaders")
    joined = indexed.join(leaders, "token")
    fits = (F.col("n") * 100 >= F.col("lead_n") * percent) & (F.col("lead_n") * 100 >= F.col("n") * percent)
    pairs = joined.filter(fits & (F.col("ref") != F.col("lead"))).select(F.col("ref").alias("a"), F.col("lead").alias("b")).distinct()
    # Vertical partitioning: the sets are cut at the same borders of the order, overlaps add up over the fragments.
    def piece(f: int) -> Column:
        return F.filter("tokens", lambda x: F.shiftrightunsigned(x, 65 - FRAGMENTS.bit_length()) == f)

    fragments = F.array(*[F.struct(F.lit(f).alias("fragment"), piece(f).alias("piece")) for f in range(FRAGMENTS)])
    pieces = sets.select("ref", "n", F.inline(fragments)).filter(F.size("piece") > 0)
    left = pieces.select(F.col("ref").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("piece").alias("piece_a"))
    right = pieces.select(F.col("ref").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("piece").alias("piece_b"))
    partial = pairs.hint("merge").join(left, "a").join(right.hint("merge"), ["b", "fragment"]).select(
        "a", "b", "n_a", "n_b", F.size(F.array_intersect("piece_a", "piece_b")).alias("part")
    )
    counted = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("overlap"))
    stars = frozen(counted.filter(_similar(F.col("overlap"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b"), "stars")

    roots = components(stars, "stars")
    rooted = sets.join(roots.withColumnRenamed("node", "ref"), "ref", "left").withColumn("root", F.coalesce("root", "ref"))
    led = leaders.join(rooted.select(F.col("ref").alias("lead"), F.col("root").alias("lead_root")), "lead").select("token", "lead_root")
    tagged = indexed.select("ref", "token").join(led, "token").join(rooted.select("ref", "root"), "ref")
    apart = tagged.filter("root <> lead_root").select("ref", "token").distinct()
    places = indexed.groupBy("token").agg(F.collect_set(F.pmod("ref", F.lit(parts)).cast("int")).alias("at"))
    sent = apart.join(places, "token").groupBy("ref").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("at"))
    probes = sent.join(rooted.select("ref", "n", "tokens", "root"), "ref").select("ref", "n", "tokens", "root", F.explode("at").alias("place"))
    held = rooted.filter("prefix > 0").select("ref", "n", "tokens", "root", F.pmod("ref", F.lit(parts)).cast("int").alias("place"))
    rest = held.groupBy("place").cogroup(probes.groupBy("place")).applyInArrow(_probe(percent), "a bigint, b bigint")
    return stars.unionByName(rest)
