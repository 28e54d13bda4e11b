"""Fill-in-middle rearrangement: a Fenwick tree over fixed blocks of a text finds where it is cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.blocks import SPACES, separators, text_blocks

#: Bytes of a text that one leaf of the tree stands for.
BLOCK = 512
#: Signs before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")

_SPACE = separators(SPACES)


class CutTree:
    """Units and code points that begin in each block of one text, as two Fenwick trees of equal shape.

    ``units`` and ``points`` mark the bytes where a unit and a code point begin.
    """

    def __init__(self, units: np.ndarray, points: np.ndarray, block: int = BLOCK):
        self.units, self.points, self.block = units, points, block
        self.leaves = -(-len(units) // block)
        self.unit_tree = self._tree(units)
        self.point_tree = self.unit_tree if points is units else self._tree(points)
        self.top = 1 << max(self.leaves.bit_length() - 1, 0)

    def _tree(self, marks: np.ndarray) -> list[int]:
        before = np.zeros(self.leaves + 1, np.int64)
        if self.leaves:
            np.cumsum(np.add.reduceat(marks, np.arange(0, len(marks), self.block), dtype=np.int64), out=before[1:])
        node = np.arange(self.leaves + 1)
        return (before - before[node - (node & -node)]).tolist()

    def cut(self, k: int) -> tuple[int, int]:
        """``(byte, code points before it)`` where unit ``k`` begins; the text's end for ``k`` past the last unit."""
        leaf, left, points, step = 0, k, 0, self.top
        while step:
            at = leaf + step
            if at <= self.leaves and self.unit_tree[at] <= left:
                leaf, left, points = at, left - self.unit_tree[at], points + self.point_tree[at]
            step >>= 1
        if leaf >= self.leaves:
            return len(self.units), points
        start = leaf * self.block
        inside = np.flatnonzero(self.units[start : start + self.block])
        if left >= len(inside):
            return len(self.units), points + int(np.count_nonzero(self.points[start:]))
        byte = start + int(inside[left])
        return byte, points + int(np.count_nonzero(self.points[start:byte]))


def _marks(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a block where units and code points begin."""
    points = (data & 0xC0) != 0x80
    if unit == "code_points":
        return points, points
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = inside[first]
    # White space before the first word belongs to it.
    words = np.concatenate([[0], np.cumsum(begins)])
    leading = first[~begins[first]]
    rows_end = offsets[1:][np.diff(offsets) > 0][~begins[first]]
    at = np.flatnonzero(begins)
    has = words[rows_end] > words[leading]
    begins[at[words[leading[has]]]] = False
    begins[leading] = True
    return begins, points


def fill_in_middle(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    unit: str = "code_points",
    plain_from: int = 90,
    spm_below: int = 20,
    seed: str = "1",
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` per row.

    A text of ``n`` units (``code_points``, or ``words`` with the white space that follows them) is
    cut at two places into prefix, middle and suffix. ``output`` is the text itself (``plain``),
    prefix, suffix, middle behind their signs (``psm``), or suffix, prefix, middle (``spm``); see
    ``restored`` for the way back. Cuts and form follow from the sha256 of ``seed:doc_id``, so
    reruns and retried tasks agree: prefix and middle end after the smaller and the larger of
    ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units; a text stays plain if it is empty, holds a sign or
    has ``h3 % 100 >= plain_from``; of the others ``h4 % 100 < spm_below`` are ``spm``.

    Null text is empty. A null id counts as an empty one; rows with equal ids are cut by the same
    draws. Lengths are null for plain rows, else in code points. An empty table gives an empty
    result; extra columns are ignored. Bytes that are no UTF-8 pass unchanged. Runs without a shuffle.
    """
    if unit not in ("code_points", "words"):
        raise ValueError("unit is code_points or words")
    signs = [m.encode() for m in marks]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]
    source = docs.select(F.col(doc_id).alias("_id"), *draws, F.col(text).alias("_text"))

    def arrange(raw: bytes, units: np.ndarray, points: np.ndarray, n: int, h: list[int]) -> tuple[str, int | None, int | None, bytes]:
        if n == 0 or h[2] % 100 >= plain_from or any(s in raw for s in signs):
            return "plain", None, None, raw
        tree = CutTree(units, points)
        (a, before), (b, upto) = (tree.cut(k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
        if h[3] % 100 < spm_below:
            return "spm", before, upto - before, b"".join([signs[1], suffix, signs[0], prefix, signs[2], middle])
        return "psm", before, upto - before, b"".join([signs[0], prefix, signs[1], suffix, signs[2], middle])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = np.column_stack([batch.column(f"_h{i}").to_numpy() for i in range(1, 5)]).tolist()
            for block in text_blocks(batch.column("_text")):
                units, points = _marks(block.data, block.offsets, unit)
                before = np.concatenate([[0], np.cumsum(units)])[block.offsets]
                sizes = np.diff(before).tolist()
                raw, at = block.data.tobytes(), block.offsets.tolist()
                done = []
                for row, (lo, hi) in enumerate(zip(at, at[1:])):
                    here = units[lo:hi]
                    done.append(arrange(raw[lo:hi], here, here if points is units else points[lo:hi], sizes[row], drawn[block.row0 + row]))
                form, prefix, middle, output = zip(*done)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(block.row0, block.rows),
                        pa.array(sizes, pa.int64()),
                        pa.array(form, pa.string()),
                        pa.array(prefix, pa.int64()),
                        pa.array(middle, pa.int64()),
                        pa.array(output, pa.binary()).view(pa.string()),
                    ],
                    names=names,
                )

    names = ["_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kind = source.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return source.mapInArrow(work, schema).withColumnRenamed("_id", doc_id)


def restored(output: str | Column = "output", form: str | Column = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` arranged, from its output and form alone.

    No arranged text holds a sign and no sign overlaps itself or another, so every sign in an output is one that was put there.
    """
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = (F.lit(x) for x in marks)
    one, two = F.lit(1), F.lit(2)
    behind_s = F.split_part(output, s, two)
    psm = F.concat(F.split_part(F.split_part(output, s, one), p, two), F.split_part(behind_s, m, two), F.split_part(behind_s, m, one))
    behind_p = F.split_part(output, p, two)
    spm = F.concat(
        F.split_part(behind_p, m, one), F.split_part(behind_p, m, two), F.split_part(F.split_part(output, p, one), s, two)
    )
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
