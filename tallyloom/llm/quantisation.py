"""Near-duplicate vectors by iterative quantisation: balanced binary codes, multi-index Hamming tables, exact cosines."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.fragments import grouped
from tallyloom.session import frozen

#: Vectors, at most, on which the rotation is learnt.
SAMPLE = 20_000
BITS = 64
ROUNDS = 50
#: Bits of the code that a table looks at, for labels of up to ``FINE`` classes; one more for each doubling beyond, up to ``MOST_BITS``.
PART_BITS = 8
FINE = 1 << 18
MOST_BITS = 24
#: Share of the pairs right at the threshold that no table may bring together, if bits differ independently.
MISS = 0.03
#: Rows of one label or cell that a task compares at once; larger ones are split into pairs of blocks.
BLOCK_ROWS = 2_000
#: Rows handed to one call.
TASK_ROWS = 20_000
#: Rows times cells that are looked at together when a vector's cells are listed.
CELLS_AT_ONCE = 1 << 15


class Rotation:
    """Centre, principal axes and the rotation that balances the signs of the projections."""

    def __init__(self, sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 7):
        """Iterative quantisation: alternate between signs of the rotated data and the best rotation for them."""
        self.bits = min(bits, sample.shape[1], 64)
        self.centre = sample.mean(axis=0)
        centred = sample - self.centre
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, : self.bits]
        projected = centred @ axes
        rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((self.bits, self.bits)))[0]
        for _ in range(rounds):
            codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(codes.T @ projected)
            rotation = (left @ right).T
        self.matrix = axes @ rotation

    @classmethod
    def drawn(cls, size: int, bits: int) -> Rotation:
        """A fixed random one, for vector lengths of which the sample holds too little to learn from."""
        self = cls.__new__(cls)
        self.bits, self.centre = min(bits, size, 64), np.zeros(size)
        self.matrix = np.linalg.qr(np.random.default_rng(size).standard_normal((size, self.bits)))[0]
        return self

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.centre) @ self.matrix


@lru_cache(maxsize=256)
def _masks(bits: int, width: int, cosine: float) -> np.ndarray:
    """The bits that each table looks at: parts of the code side by side, then drawn sets of as many bits.

    A bit of two vectors at ``cosine`` differs with the probability of their angle over pi, so a table brings
    them together with that of no difference in its bits. There are as many tables as leave ``MISS`` of them.
    """
    width = max(1, min(width, bits // 4))
    together = (1 - math.acos(cosine) / math.pi) ** width
    wanted = 1 if together >= 1 else math.ceil(math.log(MISS) / math.log(1 - together))
    parts = [range(start, start + width) for start in range(0, bits - width + 1, width)]
    rng = np.random.default_rng(bits * 64 + width)
    while len(parts) < wanted:
        parts.append(rng.choice(bits, width, replace=False).tolist())
    return np.array([sum(1 << int(bit) for bit in part) for part in parts[:wanted]], np.uint64).view(np.int64)


def _codes(projected: np.ndarray) -> np.ndarray:
    # What is zero but for rounding, as in directions that no vector takes, counts as positive.
    signs = (projected >= -1e-9).astype(np.uint64) << np.arange(projected.shape[1], dtype=np.uint64)
    return signs.sum(axis=1, dtype=np.uint64).view(np.int64)


def _cells(projected: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, cell, home``: the cell of each row's code, and others that may hold a vector within ``sqrt(reach)``.

    Where two codes differ the projections have different signs, so they lie apart by the row's own
    projection at least. A cell is out of reach if the squares of these, over the differing bits, sum
    to more than ``reach``. Of two cells one, by parity, receives the other's rows.
    """
    own = ((projected >= 0).astype(np.int64) << np.arange(projected.shape[1])).sum(axis=1)
    apart = np.zeros((len(projected), 1))
    for bit in range(projected.shape[1]):
        apart = np.concatenate([apart, apart + projected[:, bit, None] ** 2], axis=1)
    row, flipped = np.nonzero(apart <= reach)
    own = own[row]
    cell = own ^ flipped
    goes = (flipped == 0) | ((own < cell) == ((own + cell) % 2 == 1))
    return row[goes], cell[goes], flipped[goes] == 0


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def paired_blocks(rows: DataFrame, keys: list[str], order: str, limit: int) -> DataFrame:
    """Splits groups so that every two rows of a group, not both visitors, meet in exactly one task, or in ``own`` blocks.

    Adds ``_i, _j`` (the pair of blocks a task handles) and ``_b`` (the row's block). Up to ``limit``
    rows at ``home`` have one block, more are dealt into blocks by a hash; so are the visitors, whose
    blocks follow. Each row goes to every pair that holds its block and one with rows at home.
    """
    sizes = rows.groupBy(*keys).agg(F.count_if("home").alias("_n"), F.count_if(~F.col("home")).alias("_v")).filter("_n > 0 and _n + _v > 1")
    dealt = rows.join(sizes, keys).withColumns({"_n": F.ceil(F.col("_n") / limit).cast("int"), "_v": F.ceil(F.col("_v") / limit).cast("int")})
    hashed = F.xxhash64(order)
    block = F.when(F.col("home"), F.pmod(hashed, "_n")).otherwise(F.col("_n") + F.pmod(hashed, "_v"))
    met = F.when(F.col("home"), F.col("_n") + F.col("_v")).otherwise(F.col("_n"))
    return (
        dealt.withColumn("_b", block.cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), met - 1)))
        .withColumns({"_i": F.least("_b", "_other"), "_j": F.greatest("_b", "_other")})
        .drop("_n", "_v", "_other")
    )


def _task_rows(dealt: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One 64-bit key per group and pair of blocks; ``across`` where the two blocks differ."""
    return dealt.select(F.xxhash64(*keys, "_i", "_j").alias("key"), *columns, "_b", (F.col("_i") != F.col("_j")).alias("across"))


def _roots(hit: np.ndarray) -> np.ndarray:
    """Per row of a symmetric matrix the first row it can reach, -1 if it has no link."""
    root = np.full(len(hit), -1)
    for seed in np.flatnonzero(hit.any(axis=1)).tolist():
        front = np.array([seed]) if root[seed] < 0 else np.array([], np.int64)
        while len(front):
            root[front] = seed
            front = np.flatnonzero(hit[front].any(axis=0) & (root < 0))
    return root


def _links(columns: dict, least: float) -> dict:
    """Per vector that links in a pair of blocks: the copies it links with, and one node of its component there.

    All cosines of the pair of blocks are computed; components stand for the links, which are not listed.
    A pair that an earlier table has brought together is left to that one.
    """
    key, node, copies, side, code, table, width = (columns[c].to_numpy() for c in ("key", "node", "copies", "_b", "code", "_t", "_w"))
    across = columns["across"].to_numpy(zero_copy_only=False)
    total, root = np.zeros(len(node), np.int64), np.full(len(node), -1)
    border = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    for lo, hi in zip(border[:-1].tolist(), border[1:].tolist()):
        x = _vectors(columns["embedding"].slice(lo, hi - lo))
        hit = np.empty((hi - lo, hi - lo), bool)
        for start in range(0, hi - lo, 512):
            hit[start : start + 512] = x[start : start + 512] @ x.T >= least
        # The two products of a pair may differ in the last digit.
        hit |= hit.T
        np.fill_diagonal(hit, False)
        if table[lo] and hit.any():
            for mask in _masks(min(BITS, x.shape[1]), int(width[lo]), least)[: table[lo]]:
                seen = code[lo:hi] & mask
                hit &= seen[:, None] != seen[None, :]
        if across[lo]:
            hit &= side[lo:hi, None] != side[None, lo:hi]
        total[lo:hi] = [int(copies[lo:hi][row].sum()) for row in hit]
        root[lo:hi] = np.where((found := _roots(hit)) < 0, -1, found + lo)
    row = np.flatnonzero(root >= 0)
    return {"node": pa.array(node[row]), "n": pa.array(total[row]), "root": pa.array(node[root[row]])}


def _rotations(classes: DataFrame, sample: int) -> dict[int, Rotation]:
    """Per vector length a rotation, learnt on what a drawing of about ``sample`` vectors, of all lengths together, holds of it."""
    share = min(1.0, sample / max(1, classes.count()))
    drawn = classes.filter(F.pmod("node", F.lit(1 << 30)) < int(share * (1 << 30))).select("_size", "embedding").toArrow()
    sizes = drawn.column("_size").to_numpy()
    found = {}
    for size in np.unique(sizes).tolist():
        here = np.flatnonzero(sizes == size)
        if len(here) > 1:
            found[size] = Rotation(_vectors(drawn.column("embedding").take(pa.array(here)).combine_chunks()), BITS)
    return found


def _coded(classes: DataFrame, rotations: dict[int, Rotation]) -> DataFrame:
    """``classes`` with the code of each."""

    def encode(batches):
        plain = {}
        for batch in batches:
            sizes = batch.column("_size").to_numpy()
            code = np.zeros(batch.num_rows, np.int64)
            for size in np.unique(sizes).tolist():
                here = np.flatnonzero(sizes == size)
                if size not in rotations and size not in plain:
                    plain[size] = Rotation.drawn(size, BITS)
                rotation = rotations.get(size) or plain[size]
                code[here] = _codes(rotation.project(_vectors(batch.column("embedding").take(pa.array(here)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=[*batch.schema.names, "code"])

    return classes.mapInArrow(encode, classes.withColumn("code", F.lit(0).cast("long")).schema)


def _tabled(coded: DataFrame, cosine: float) -> DataFrame:
    """One row per class and table: ``_t`` the table, ``cell`` the bits of the code that it looks at."""

    def look_up(batches):
        for batch in batches:
            kinds = np.column_stack([batch.column("_size").to_numpy(), batch.column("_w").to_numpy()])
            code = batch.column("code").to_numpy()
            for size, width in np.unique(kinds, axis=0).tolist():
                here = np.flatnonzero((kinds == (size, width)).all(axis=1))
                alike = batch.take(pa.array(here))
                for table, mask in enumerate(_masks(min(BITS, size), width, cosine).tolist()):
                    cell = pa.array(code[here] & mask)
                    yield pa.RecordBatch.from_arrays(
                        [*alike.columns, pa.array(np.full(len(here), table, np.int32)), cell, pa.array(np.ones(len(here), bool))],
                        names=[*batch.schema.names, "_t", "cell", "home"],
                    )

    extra = {"_t": F.lit(0), "cell": F.lit(0).cast("long"), "home": F.lit(True)}
    return coded.mapInArrow(look_up, coded.withColumns(extra).schema)


def _near_cells(classes: DataFrame, cosine: float, sample: int, bits: int, block_rows: int) -> DataFrame:
    """One row per class and cell that may hold a vector within ``cosine`` of it."""
    group = ["_label", "_size"]
    width = F.least(F.ceil(F.log2(F.col("_c") / block_rows)).cast("int"), F.lit(bits), F.col("_size"))
    counts = classes.groupBy(*group).agg(F.count("*").alias("_c")).withColumn("_w", F.when(F.col("_c") > block_rows, width).otherwise(0))
    large = counts.filter("_w > 0").groupBy("_size").agg(F.max("_w").alias("width"), F.sum("_c").alias("n")).collect()
    carried = ["node", "_label", "_size", "embedding", "copies"]
    cells = classes.select(*carried, F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"))
    if large:
        rotations = {}
        for one in large:
            alike = classes.join(counts.filter("_w > 0"), group, "left_semi").filter(F.col("_size") == one["_size"]).select("node", "embedding")
            drawn = alike.filter(F.pmod("node", F.lit(1 << 30)) < int(min(1.0, sample / one["n"]) * (1 << 30))).select("embedding").toArrow()
            if drawn.num_rows < 2:
                drawn = alike.select("embedding").limit(2).toArrow()
            rotations[one["_size"]] = Rotation(_vectors(drawn.column("embedding").combine_chunks()), one["width"])
        # Unit vectors: the squared distance is twice what the cosine lacks to one, and some for rounding.
        reach = 2 - 2 * cosine + 1e-9

        def deal(batches):
            for batch in batches:
                kinds = np.column_stack([batch.column("_size").to_numpy(), batch.column("_w").to_numpy()])
                for size, w in np.unique(kinds, axis=0).tolist():
                    alike = batch.select(carried).take(pa.array(np.flatnonzero((kinds == (size, w)).all(axis=1))))
                    projected = rotations[size].project(_vectors(alike.column("embedding"))) if w else np.zeros((alike.num_rows, 0))
                    step = max(1, CELLS_AT_ONCE >> w)
                    for start in range(0, alike.num_rows, step):
                        row, cell, home = _cells(projected[start : start + step, :w], reach)
                        taken = alike.take(pa.array(row + start))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell), pa.array(home)], names=[*carried, "cell", "home"])

        cells = classes.join(counts.drop("_c"), group).select(*carried, "_w").mapInArrow(deal, cells.schema)
    return cells.withColumns({"code": F.lit(0).cast("long"), "_t": F.lit(0), "_w": F.lit(0)})


def vector_classes(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = 0.93,
    sample: int = SAMPLE,
    bits: int = BITS,
    block_rows: int = BLOCK_ROWS,
    exact: bool = False,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row.

    Rows of one label and vector length link when their cosine, in double precision, is at least ``cosine``.
    Equal vectors become one class with a multiplicity. A rotation per vector length, learnt on a drawing of
    about ``sample`` vectors of all lengths, gives every class a balanced code of up to 64 bits. Tables look
    at 8 bits of it each, more in labels of over 262,144 classes, and at so many parts that 0.97 of the pairs
    right at the threshold should meet in one (8 tables of 8 bits at 0.93), and more of those above it.
    Every two classes of a label that meet are compared by their original vectors, in the first table
    that they share; a crowded cell is split into pairs of blocks, so none is cut short. No pair below
    ``cosine`` links. The rows that are shuffled are one per class and table whose cell holds others.

    ``exact=True`` misses no link: a class is compared with its own cell of a short code (about ``block_rows``
    classes a cell) and all others but those that its projections prove too far (see ``_cells``).
    ``bits`` bounds that code. Without structure its work grows with the square of a label's classes.

    Vectors that are null, zero, hold null or non-finite numbers, or have no label link with nothing
    and are components of their own. A component is named after its smallest id; null ids
    count only where there is no other. Rows with equal ids are separate rows. An empty table gives
    an empty result. Extra columns are ignored. Classes are told apart by 64-bit hashes.
    """
    rows = vectors.select(F.col(vec_id).alias("_id"), F.col(label).alias("_label"), F.col(vector).alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    nonzero = F.exists("embedding", lambda v: v != 0)
    valid = rows.filter(F.col("_label").isNotNull() & F.col("embedding").isNotNull()).filter(finite & nonzero)
    node = F.xxhash64("_label", "embedding")
    classes = frozen(
        valid.withColumn("node", node).groupBy("node", "_label", "embedding").agg(F.count("*").alias("copies"), F.min("_id").alias("smallest")).withColumn("_size", F.size("embedding")), "classes"
    )
    group = ["_label", "_size"]
    if exact:
        cells = _near_cells(classes, cosine, sample, bits, block_rows)
    else:
        doublings = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_c") / FINE))).cast("int")
        counts = classes.groupBy(*group).agg(F.count("*").alias("_c")).filter("_c > 1")
        widths = counts.select(*group, F.least(F.lit(MOST_BITS), doublings + PART_BITS).alias("_w"))
        several = classes.select("node", *group, "embedding", "copies").join(widths, group)
        cells = _tabled(frozen(_coded(several, _rotations(classes, sample)), "codes"), cosine)
    keys = [*group, "_t", "cell"]
    blocks = _task_rows(paired_blocks(cells, keys, "node", block_rows), keys, ["node", "embedding", "copies", "code", "_t", "_w"])
    linked = frozen(grouped(blocks, "key", ["node"], lambda c: _links(c, cosine), "node bigint, n bigint, root bigint", TASK_ROWS), "linked")
    clusters = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-links")
    counted = linked.groupBy("node").agg(F.sum("n").alias("others"))
    named = classes.select("node", "_label", "embedding", "copies", "smallest").join(clusters, "node", "left").join(counted, "node", "left")
    together = named.filter("root is not null").groupBy("root").agg(F.min("smallest").alias("together"))
    known = named.join(together, "root", "left").select(
        F.col("_label").alias("_l"), F.col("embedding").alias("_e"), F.coalesce("together", "smallest").alias("name"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = rows.join(known, (F.col("_label") == F.col("_l")) & (F.col("embedding") == F.col("_e")), "left")
    component = F.coalesce("name", "_id")
    return out.select(F.col("_id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
