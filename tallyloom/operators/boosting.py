"""Second-order boosted trees: sums of gradients and hessians per bin and node, one aggregation a level."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import frozen, scratch

#: Trees whose margins live in executors' storage before they are written beside the rows.
PENDING = 40

#: Rows of one block, blocks of one part (on more cores fewer), and parts whose sums the driver adds up itself.
BLOCK_ROWS = 1 << 16
PART_BLOCKS = 64
PARTS = 32

#: Cells of the histogram that a group of features shares; distinct labels times weights whose rows are counted.
CELLS = 1024
KINDS = 4


@dataclass
class Tree:
    """Nodes in heap order; a node without a feature is a leaf, or is not there."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n))

    def node(self, bins: np.ndarray) -> np.ndarray:
        """The node at which each row comes to rest. A bin of 0 is a missing value."""
        at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            inner = self.feature[at] >= 0
            if not inner.any():
                break
            here = bins[row, np.maximum(self.feature[at], 0)]
            left = np.where(here == 0, self.missing_left[at], here <= self.cut[at])
            at = np.where(inner, 2 * at + 2 - left, at)
        return at

    def rests(self, left: Callable[[int, np.ndarray], np.ndarray], n: int) -> Iterator[tuple[int, np.ndarray]]:
        """``node, rows`` of ``n`` rows where they come to rest; ``left(node, rows)`` tells which of the rows go left."""
        todo = [(0, np.arange(n))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                yield node, rows
                continue
            goes = left(node, rows)
            todo += [(2 * node + 1, rows.take(np.flatnonzero(goes))), (2 * node + 2, rows.take(np.flatnonzero(~goes)))]

    def goes_left(self, node: int, bins: np.ndarray) -> np.ndarray:
        """Whether a bin of the node's feature goes left."""
        return np.where(bins == 0, self.missing_left[node], bins <= self.cut[node])


@dataclass
class Boosted:
    features: list[str]
    cuts: list[np.ndarray]
    loss: str
    base: float
    trees: list[Tree] = field(default_factory=list)
    gains: np.ndarray | None = None

    def bins(self, values: np.ndarray) -> np.ndarray:
        """0 for a missing value, else one more than the number of cuts that the value reaches."""
        out = np.empty(values.shape, np.int64)
        for f, cuts in enumerate(self.cuts):
            out[:, f] = np.where(np.isnan(values[:, f]), 0, np.searchsorted(cuts, values[:, f], side="right") + 1)
        return out

    def importance(self) -> dict[str, int]:
        """How many nodes split by each feature."""
        used = np.concatenate([t.feature[t.feature >= 0] for t in self.trees] or [np.array([], np.int64)])
        return dict(zip(self.features, np.bincount(used.astype(np.int64), minlength=len(self.features)).tolist()))

    def gain_importance(self) -> dict[str, float]:
        """Each feature's share of what all splits gained."""
        gains = np.zeros(len(self.features)) if self.gains is None else self.gains
        return dict(zip(self.features, (gains / (gains.sum() or 1.0)).tolist()))


def quantile_cuts(df: DataFrame, features: list[str], bins: int = 64) -> list[np.ndarray]:
    """Per feature at most ``bins - 1`` distinct approximate quantiles, by one mergeable aggregation."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), shares, 10_000).alias(c) for c in features]).first()
    return [np.unique(np.array(row[c] or [], float)) for c in features]


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    columns = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for c in features]
    return np.column_stack(columns) if columns else np.zeros((batch.num_rows, 0))


def _drawn(key: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Whether a tree learns from a row: by its key alone, so that a repeated task draws the same rows."""
    mixed = key.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return (mixed ^ (mixed >> np.uint64(31))).astype(float) < share * 2.0**64


def _slopes(loss: str, margin: np.ndarray, label: np.ndarray, weight: np.ndarray, first: bool = False) -> tuple[np.ndarray, np.ndarray]:
    if loss == "squared":
        return weight * (margin - label), weight
    if loss == "residual":
        side = 2 * label - 1
        return -weight * (side if first else 4 * side / (1 + np.exp(2 * side * margin))), weight
    p = 1 / (1 + np.exp(-margin))
    return weight * (p - label), weight * p * (1 - p)


def _kind_slopes(loss: str, margin: np.ndarray, kind: np.ndarray, kinds: np.ndarray, first: bool) -> np.ndarray:
    """The gradients of ``_slopes`` for rows whose labels and weights are those of their kind."""
    label, weight = kinds.T
    if loss != "residual" or first:
        return _slopes(loss, margin, label.take(kind), weight.take(kind), first)[0]
    power = (4 * label - 2).take(kind)
    power *= margin
    np.exp(power, out=power)
    power += 1
    return np.divide((-4 * weight * (2 * label - 1)).take(kind), power, out=power)


def split_sums(rows: DataFrame, model: Boosted, pending: list[Tree], tree: Tree, nodes: list[int], draw: tuple[int, float]) -> DataFrame:
    """``node, feature, bin, g, h, n`` over the rows (``_y, _weight, _margin, _key`` and features) that rest at ``nodes``.

    Every task adds its rows up before the shuffle; there is one row per node, feature and bin at most.
    """
    width = max((len(c) for c in model.cuts), default=0) + 2
    slot = np.full(len(tree.feature), -1)
    slot[nodes] = np.arange(len(nodes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(nodes) * len(model.features) * width
        total = np.zeros((3, size))
        for batch in batches:
            bins = model.bins(_matrix(batch, model.features))
            label, weight, margin, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_weight", "_margin", "_key"))
            margin = margin + sum(t.value[t.node(bins)] for t in pending)
            here = slot[tree.node(bins)]
            row = np.flatnonzero((here >= 0) & _drawn(key, *draw))
            g, h = (s[row] for s in _slopes(model.loss, margin, label, weight))
            for f in range(len(model.features)):
                cell = (here[row] * len(model.features) + f) * width + bins[row, f]
                for k, what in enumerate((g, h, None)):
                    total[k] += np.bincount(cell, what, minlength=size)
        cell = np.flatnonzero(total[2])
        place, of_bin = np.divmod(cell, width)
        arrays = [np.array(nodes, np.int64)[place // len(model.features)], place % len(model.features), of_bin, total[0][cell], total[1][cell], total[2][cell].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["node", "feature", "bin", "g", "h", "n"])

    parts = rows.mapInArrow(work, "node bigint, feature bigint, bin bigint, g double, h double, n bigint")
    return parts.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def best_split(g: np.ndarray, h: np.ndarray, penalty: float, least: float) -> tuple | None:
    """``gain, feature, cut, missing_left, left (g, h), right (g, h)`` of a node's ``[feature, bin]`` sums; None if none gains.

    Bin 0 (missing) goes to the side that gains more. Equal gains go to the first feature, then the lowest cut.
    """
    if not g.size or g.shape[1] < 3:
        return None
    sums, missing = np.stack([g, h])[..., 1:], np.stack([g, h])[..., :1]
    upto = np.cumsum(sums, axis=-1)
    # Taken from the running sum itself: a side without rows is exactly 0.
    below, above = upto[..., :-1], upto[..., -1:] - upto[..., :-1]
    left, right = np.stack([below, below + missing], axis=1), np.stack([above + missing, above], axis=1)
    score = lambda s: s[0] ** 2 / np.maximum(s[1] + penalty, 1e-300)
    gain = score(left) + score(right) - score(upto[..., -1:] + missing)
    gain = np.where((left[1] >= least) & (right[1] >= least), gain, -np.inf)
    best, at, most = None, gain.argmax(axis=-1), gain.max(axis=-1)
    for f in range(len(g)):
        for side in (0, 1):
            if most[side, f] > 1e-9 and (best is None or most[side, f] > best[0] + 1e-9):
                best = (float(most[side, f]), f, side)
    if best is None:
        return None
    top, f, side = best
    c = int(at[side, f])
    return top, f, c + 1, bool(side), left[:, side, f, c], right[:, side, f, c]


def prepared_rows(df: DataFrame, label: str, features: list[str], key: str, weight: str | None, base: float) -> DataFrame:
    known = df.filter(F.col(label).isNotNull())
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    named = [F.col(c).cast("double").alias(c) for c in features]
    return known.select(*named, F.col(label).cast("double").alias("_y"), w.alias("_weight"), F.lit(base).alias("_margin"), F.xxhash64(key).alias("_key"))


@dataclass
class Layout:
    """How blocks hold rows: groups of features whose bins make one cell number, and the labels and weights that occur.

    A feature of ``first`` 1 has no missing values. Without ``kinds`` (pairs of label and weight) both are held row by row.
    """

    width: int
    first: list[int]
    sizes: list[int]
    groups: list[list[int]]
    kinds: np.ndarray | None
    keyed: bool

    @classmethod
    def of(cls, cuts: list[np.ndarray], missing: list[bool], kinds: np.ndarray | None, keyed: bool) -> Layout:
        first = [0 if m else 1 for m in missing]
        sizes = [len(c) + 2 - at for c, at in zip(cuts, first)]
        groups: list[list[int]] = []
        for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
            room = next((g for g in groups if math.prod(sizes[i] for i in g) * sizes[f] <= CELLS), None)
            room.append(f) if room else groups.append([f])
        return cls(max((len(c) for c in cuts), default=0) + 2, first, sizes, groups, kinds, keyed)

    def dims(self, group: list[int]) -> tuple[int, ...]:
        return tuple(self.sizes[f] for f in group)

    @property
    def kind(self) -> np.dtype:
        return np.dtype(np.uint16 if all(self.size(g) <= 1 << 16 for g in self.groups) else np.int64)

    def size(self, group: list[int]) -> int:
        """Cell numbers of a group: those of a kind follow those of the kind before."""
        return math.prod(self.dims(group)) * (1 if self.kinds is None else len(self.kinds))

    def cells(self, bins: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
        """The cell number of each row, ``[group, row]``."""
        out = np.zeros((len(self.groups), len(bins)), self.kind)
        for row, group in zip(out, self.groups):
            dims = self.dims(group)
            row[:] = np.ravel_multi_index([bins[:, f] - self.first[f] for f in group], dims) + kind * np.intp(math.prod(dims))
        return out

    def rester(self, tree: Tree, give: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """What gives the rows of ``cells`` ``give`` (a value per node) of the node where each rests."""
        place = {f: (g, i) for g, group in enumerate(self.groups) for i, f in enumerate(group)}
        tables: dict[int, dict[int, np.ndarray]] = {}
        for node in np.flatnonzero(tree.feature >= 0).tolist():
            g, i = place[int(tree.feature[node])]
            dims = self.dims(self.groups[g])
            side = tree.goes_left(node, np.arange(dims[i]) + self.first[tree.feature[node]])
            side = np.broadcast_to(side.reshape([-1 if d == i else 1 for d in range(len(dims))]), dims).ravel()
            tables.setdefault(g, {})[node] = np.tile(side, self.size(self.groups[g]) // len(side))
        levels = max((node + 1).bit_length() for t in tables.values() for node in t) if tables else 0
        if levels > 6:
            sides = {node: (g, side) for g, t in tables.items() for node, side in t.items()}

            def by_rows(cells: np.ndarray) -> np.ndarray:
                out = np.empty(cells.shape[1], give.dtype)
                for node, rows in tree.rests(lambda node, rows: sides[node][1].take(cells[sides[node][0]].take(rows)), len(out)):
                    out[rows] = give[node]
                return out

            return by_rows
        # All nodes' answers as bits of one word, looked up once per group; a row below a leaf goes on to anywhere.
        word = np.uint32 if levels < 6 else np.uint64
        words = {g: sum(side.astype(word) << word(node) for node, side in t.items()) for g, t in tables.items()}
        rest = np.arange(2 ** (levels + 1) - 1)
        for node in range(1, len(rest)):
            above = rest[(node - 1) // 2]
            rest[node] = above if tree.feature[above] < 0 else node
        given = give[rest]

        def by_bits(cells: np.ndarray) -> np.ndarray:
            bits, at = np.zeros(cells.shape[1], word), np.zeros(cells.shape[1], word)
            for g, table in words.items():
                bits |= table.take(cells[g])
            for _ in range(levels):
                goes = bits >> at
                goes &= word(1)
                at *= word(2)
                at += word(2)
                at -= goes
            return given.take(at)

        return by_bits

    def by_feature(self, totals: list[np.ndarray]) -> np.ndarray:
        """``[..., feature, bin]`` from the sums per cell of each group."""
        out = np.zeros((*totals[0].shape[:-1], len(self.sizes), self.width))
        for total, group in zip(totals, self.groups):
            lead = total.ndim - 1
            whole = total.reshape(*total.shape[:-1], *self.dims(group))
            for i, f in enumerate(group):
                others = tuple(lead + j for j in range(len(group)) if j != i)
                out[..., f, self.first[f] : self.first[f] + self.sizes[f]] = whole.sum(axis=others)
        return out


#: A block: cell numbers, kinds (or labels and weights), margins, keys; what a layout does not hold is None.
COLUMNS = ["_cells", "_kind", "_y", "_weight", "_margin", "_key"]


def _written(df: DataFrame) -> DataFrame:
    """Like ``frozen``, with a file for every two blocks, so that readers divide the blocks evenly."""
    path = scratch(df.sparkSession, "boosting")
    df.write.option("maxRecordsPerFile", 2).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SCHEMA = ", ".join(f"{c} binary" for c in COLUMNS)


def _blocks(rows: DataFrame, model: Boosted, layout: Layout) -> DataFrame:
    """The rows as blocks of up to about ``BLOCK_ROWS``, every column as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray | None]] = []

        def block() -> pa.RecordBatch:
            parts = [None if p[0] is None else np.concatenate(p, axis=-1).tobytes() for p in zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=COLUMNS)

        for batch in batches:
            y, weight, margin, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_weight", "_margin", "_key"))
            kind = None
            if layout.kinds is not None:
                kind = np.argmax((layout.kinds[:, :1] == y) & (layout.kinds[:, 1:] == weight), axis=0).astype(np.uint8)
                y = weight = None
            held.append([layout.cells(model.bins(_matrix(batch, model.features)), 0 if kind is None else kind), kind, y, weight, margin, key if layout.keyed else None])
            if sum(h[4].size for h in held) >= BLOCK_ROWS:
                yield block()
                held = []
        if held:
            yield block()

    return _written(rows.mapInArrow(pack, SCHEMA))


def _opened(layout: Layout):
    """A packed block as arrays."""

    def work(row) -> tuple[np.ndarray | None, ...]:
        margin = np.frombuffer(row[4])
        kinds = [layout.kind, np.dtype(np.uint8), *[np.dtype(float)] * 3, np.dtype(np.int64)]
        cells, *others = (None if b is None else np.frombuffer(b, k) for b, k in zip(row, kinds))
        return cells.reshape(len(layout.groups), len(margin)), *others

    return work


def _added(tree: Tree, layout: Layout):
    def work(blocks):
        values = layout.rester(tree, tree.value)
        for block in blocks:
            yield *block[:4], block[4] + values(block[0]), block[5]

    return work


def _packed(block: tuple[np.ndarray | None, ...]) -> tuple[bytes | None, ...]:
    return tuple(None if part is None else np.ascontiguousarray(part).tobytes() for part in block)


def _level_sums(state, loss: str, layout: Layout, tree: Tree, nodes: list[int], draw: tuple[int, float]) -> np.ndarray:
    """``[what, node, feature, bin]`` over the blocks: one sum per part, and of many parts the driver gets few.

    ``what`` is g and h; of a layout with kinds it is g and the number of rows of each kind.
    """
    kinds = layout.kinds
    shape = (2 if kinds is None else 1 + len(kinds), len(nodes))
    slot = np.full(len(tree.feature), -1)
    slot[nodes] = np.arange(len(nodes))

    def work(blocks):
        totals = [np.zeros((2, len(nodes) * layout.size(g))) for g in layout.groups]
        slots = layout.rester(tree, slot)
        for cells, kind, y, weight, margin, key in blocks:
            here = slots(cells)
            row = here >= 0
            if draw[1] < 1.0:
                row &= _drawn(key, *draw)
            row = np.flatnonzero(row)
            of = (lambda part: part) if len(row) == len(margin) else (lambda part: part.take(row))  # noqa: B023
            if kinds is None:
                g, h = _slopes(loss, of(margin), of(y), of(weight), draw[0] == 0)
            else:
                g, h = _kind_slopes(loss, of(margin), of(kind), kinds, draw[0] == 0), None
            node = of(here)
            for total, cell, group in zip(totals, cells, layout.groups):
                cell = node * layout.size(group) + of(cell) if len(nodes) > 1 else of(cell)
                total[0] += np.bincount(cell, g, minlength=total.shape[1])
                total[1] += np.bincount(cell, h, minlength=total.shape[1])
        if not totals:
            yield np.zeros((*shape, 0, layout.width))
        elif kinds is None:
            yield layout.by_feature([t.reshape(*shape, -1) for t in totals])
        else:
            parts = [t.reshape(2, len(nodes), len(kinds), -1) for t in totals]
            yield layout.by_feature([np.concatenate([t[0].sum(axis=1)[None], t[1].swapaxes(0, 1)]) for t in parts])

    parts = state.mapPartitions(work)
    if state.getNumPartitions() > PARTS:
        return parts.treeReduce(np.add)
    return sum(parts.collect(), np.zeros((*shape, len(layout.sizes), layout.width)))


def _kinds(rows: DataFrame, loss: str) -> np.ndarray | None:
    """The pairs of label and weight where there are few and a row's second derivative is its weight, else None."""
    few = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in ("_y", "_weight")]).first()
    if loss == "logistic" or max(few) > KINDS:
        return None
    pairs = np.array([tuple(r) for r in rows.groupBy("_y", "_weight").count().select("_y", "_weight").collect()], float)
    return pairs.reshape(-1, 2) if len(pairs) <= KINDS and not np.isnan(pairs).any() else None


def fit_boosted_trees(
    df: DataFrame,
    label: str,
    features: list[str],
    *,
    key: str,
    loss: str = "logistic",
    trees: int = 200,
    depth: int = 5,
    rate: float = 0.1,
    penalty: float = 1.0,
    least: float = 1.0,
    subsample: float = 1.0,
    weight: str | None = None,
    cuts: list[np.ndarray] | None = None,
) -> Boosted:
    """Gradient boosting by first and second derivatives of the ``logistic`` or ``squared`` loss.

    The rows are binned once, into blocks that stay in the executors' storage with their margins. Features
    share histograms of up to ``CELLS`` cells. A level of a tree is one pass over the blocks; what reaches the
    driver are the sums per part, node, feature and bin, at most ``2**(depth - 1)`` times features times 65,
    added up between executors above ``PARTS`` parts. If labels and weights are few and the loss has them as
    second derivatives (``squared``, ``residual``), only the smaller child of each node is added up. A leaf is ``-rate * g / (h + penalty)``; a split keeps a hessian sum of ``least`` on both sides.
    ``key`` draws the share ``subsample`` of the rows anew for each tree. Rows without a label are left
    out; null and NaN features are missing, a null weight is 1. Without rows the model has no trees.

    ``residual`` is gradient boosting as MLlib does it: the first tree, at a rate of 1, learns labels of
    -1 and 1, the others the gradients of ``2 * log(1 + exp(-2 * y * margin))``, every leaf being a mean.
    """
    base = 0.0
    if loss == "squared":
        base = float(df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0)
    rows = frozen(prepared_rows(df, label, features, key, weight, base), "boosting")
    model = Boosted(features, cuts or quantile_cuts(rows, features), loss, base, gains=np.zeros(len(features)))
    known = rows.agg(F.count("*").alias("_n"), *[F.bool_or(F.isnull(c) | F.isnan(c)).alias(f"_{i}") for i, c in enumerate(features)]).first()
    layout = Layout.of(model.cuts, [bool(m) for m in known[1:]], _kinds(rows, loss), subsample < 1.0)
    held = math.ceil(known["_n"] / BLOCK_ROWS)
    parts = max(1, min(held, rows.sparkSession.sparkContext.defaultParallelism), held // PART_BLOCKS)
    # Few rows are packed by few tasks, as every block costs a level something.
    blocks, pending = _blocks(rows.coalesce(parts) if parts == held or held == 0 else rows, model, layout), 0
    opened = lambda packed: packed.rdd.map(_opened(layout)).coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)
    state, before = opened(blocks), None
    for number in range(trees):
        tree, active, wanted, above = Tree.empty(depth), [0], [0], {}
        step = 1.0 if loss == "residual" and number == 0 else rate
        for _ in range(depth):
            sums = dict(zip(wanted, _level_sums(state, loss, layout, tree, wanted, (number, subsample)).swapaxes(0, 1)))
            if before is not None:
                before.unpersist()
                before = None
            for node in active:
                if node not in sums:
                    sums[node] = _rest(above[(node - 1) // 2], sums[node + 1 if node % 2 else node - 1])
            following, wanted = [], []
            for node in active:
                g, h = sums[node] if layout.kinds is None else (sums[node][0], np.tensordot(layout.kinds[:, 1], sums[node][1:], 1))
                found = best_split(g, h, penalty, least)
                if found:
                    gain, tree.feature[node], tree.cut[node], tree.missing_left[node], *sides = found
                    model.gains[tree.feature[node]] += gain
                    children = [2 * node + 1, 2 * node + 2]
                    for child, side in zip(children, sides):
                        tree.value[child] = -step * side[0] / (side[1] + penalty)
                    following += children
                    # Where rows are counted, the larger child is what the smaller one leaves of its parent.
                    wanted += children if layout.kinds is None else [children[int(_fewer_right(tree, node, sums[node]))]]
            active, above = following, sums
            if not active:
                break
        if tree.feature[0] < 0:
            if subsample == 1.0 or not rows.head(1):
                break
            continue
        model.trees.append(tree)
        pending, before = pending + 1, state
        state = state.mapPartitions(_added(tree, layout)).persist(StorageLevel.MEMORY_AND_DISK)
        if pending == PENDING and number + 1 < trees:
            passed, pending = state, 0
            state = opened(_written(rows.sparkSession.createDataFrame(passed.map(_packed), SCHEMA, verifySchema=False)))
            passed.unpersist()
    for kept in (state, before):
        if kept is not None:
            kept.unpersist()
    return model


def _rest(parent: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The other child's sums. Counts are exact; a cell without rows has no gradients either."""
    other = parent - child
    other[0] = np.where(other[1:].any(axis=0), other[0], 0.0)
    return other


def _fewer_right(tree: Tree, node: int, sums: np.ndarray) -> bool:
    """Whether fewer rows of a node go right than left."""
    rows = sums[1:, tree.feature[node]].sum(axis=0)
    left = tree.goes_left(node, np.arange(len(rows)))
    return rows[~left].sum() < rows[left].sum()


def _with_margin(df: DataFrame, model: Boosted, trees: list[Tree], out: str) -> DataFrame:
    """``out`` (added where it is absent, as the base) plus what ``trees`` give."""
    if out not in df.columns:
        df = df.withColumn(out, F.lit(model.base))

    layout = Layout.of(model.cuts, [True] * len(model.cuts), None, False)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [layout.rester(t, t.value) for t in trees]
        for batch in batches:
            cells = layout.cells(model.bins(_matrix(batch, model.features)), 0)
            margin = batch.column(out).to_numpy(zero_copy_only=False) + sum(value(cells) for value in values)
            at = batch.schema.get_field_index(out)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(margin), *batch.columns[at + 1 :]], names=batch.schema.names)

    return df.mapInArrow(add, df.schema)


def boosted_scores(model: Boosted, df: DataFrame, out: str = "p") -> DataFrame:
    """Every row with ``out``: the probability of label 1, or the predicted value of a squared loss."""
    scored = _with_margin(df.drop(out), model, model.trees, out)
    if model.loss == "squared":
        return scored
    return scored.withColumn(out, 1 / (1 + F.exp(F.col(out) * (-2 if model.loss == "residual" else -1))))
