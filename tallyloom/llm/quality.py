"""Quality scores by positive-unlabelled learning with a non-negative risk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.blocks import SPACES, Words, separators, text_blocks
from tallyloom.session import frozen

SEPARATORS = separators(SPACES)

#: Training rows drawn, at most, from the trusted positives and from the unlabelled texts.
SAMPLE = 10_000
BINS = 24
STEPS = 300

_PUNCTUATION = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(key: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys per row, and the largest number of times one of them stands there."""
    if len(key) == 0:
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    lead = np.flatnonzero(new)
    size = np.diff(np.append(lead, len(key)))
    most = np.zeros(rows)
    np.maximum.at(most, row[lead], size)
    return np.bincount(row[lead], minlength=rows).astype(float), most


def features(block) -> np.ndarray:
    """One row of numbers per text: shares of byte kinds, word and line shapes, repetition."""
    rows, data, offsets = block.rows, block.data, block.offsets
    n_bytes = np.diff(offsets)
    owner = np.repeat(np.arange(rows), n_bytes)
    histogram = np.bincount(owner * 256 + data, minlength=rows * 256).reshape(rows, 256).astype(float)

    def total(values) -> np.ndarray:
        return histogram[:, list(values)].sum(axis=1)

    upper, lower, digit = total(_UPPER), total(_LOWER), total(_DIGIT)
    beyond = histogram[:, 128:].sum(axis=1)
    letters = upper + lower + beyond
    columns = [np.log1p(n_bytes), _share(upper, letters), _share(digit, n_bytes), _share(beyond, n_bytes), _share(letters, n_bytes)]
    columns += [_share(total([b]), n_bytes) for b in _PUNCTUATION]
    columns.append(_share(total(_PUNCTUATION), n_bytes))

    words = Words(block, SEPARATORS)
    n_words, row = words.counts, words.row
    length = words.end - words.start
    first, last = data[words.start], data[words.end - 1]
    is_upper, is_alpha = (first >= 65) & (first <= 90), (last >= 97) & (last <= 122) | (last >= 65) & (last <= 90) | (last >= 128)
    shouted = is_upper & (last >= 65) & (last <= 90) & (length > 1)

    def per_word(values: np.ndarray) -> np.ndarray:
        return _share(np.bincount(row, weights=values, minlength=rows), n_words)

    distinct, most = _distinct(words.hash, row, rows)
    mean = per_word(length)
    spread = np.sqrt(np.maximum(per_word(length.astype(float) ** 2) - mean**2, 0))
    columns += [np.log1p(n_words), mean, spread, per_word(is_upper), per_word(~is_alpha), per_word(shouted), per_word(length == 1), per_word(length > 20)]
    again = np.zeros(len(row), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])
    columns.append(per_word(again))
    columns += [_share(distinct, n_words), _share(distinct, np.sqrt(np.maximum(n_words, 1))), _share(most, n_words)]

    lines = Words(block, separators([10]))
    n_lines, line_row = lines.counts, lines.row
    line_length = (lines.end - lines.start).astype(float)
    line_distinct, line_most = _distinct(lines.hash, line_row, rows)
    mean_line = _share(np.bincount(line_row, weights=line_length, minlength=rows), n_lines)
    columns += [np.log1p(n_lines), np.log1p(mean_line), _share(line_distinct, n_lines), _share(line_most, n_lines)]
    return np.column_stack(columns)


class Additive:
    """Log odds as a sum of one weight per feature and quantile bin."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, bias: float):
        self.edges, self.weights, self.bias = edges, weights, bias

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        if len(self.edges) == 0:
            return np.full(len(x), 1 / (1 + np.exp(-self.bias)))
        at = self.bins(x)
        return 1 / (1 + np.exp(-np.clip(self.bias + self.weights[np.arange(at.shape[1]), at].sum(axis=1), -50, 50)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, bins: int = BINS) -> Additive:
    """Minimises the non-negative positive-unlabelled risk with the logistic loss.

    Risk of positives ``prior * mean(l(g(p)))`` plus that of negatives, which is written without
    any: ``mean(l(-g(u))) - prior * mean(l(-g(p)))``. It cannot be negative for the true
    distribution; when the estimate falls below zero the model has begun to overfit, and the step
    raises it instead. Gradient steps with running moments; deterministic.
    """
    prior = min(max(prior, 0.01), 0.99)
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    if len(positive) == 0 or len(unlabelled) == 0:
        return Additive(np.zeros((0, 0)), np.zeros((0, 0)), float(np.log(prior / (1 - prior))))
    edges = np.quantile(unlabelled, quantiles, axis=0).T
    model = Additive(edges, np.zeros((positive.shape[1], bins)), float(np.log(prior / (1 - prior))))
    width = positive.shape[1]
    flat = [m + np.arange(width) * bins for m in (model.bins(positive), model.bins(unlabelled))]
    theta, moment, square = np.zeros(width * bins + 1), np.zeros(width * bins + 1), np.zeros(width * bins + 1)
    theta[-1] = model.bias
    for step in range(1, steps + 1):
        g_p, g_u = (theta[at].sum(axis=1) + theta[-1] for at in flat)
        s_p, s_u = (1 / (1 + np.exp(-np.clip(g, -50, 50))) for g in (g_p, g_u))
        negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        up_u, up_p = s_u / len(s_u), -prior * s_p / len(s_p)
        if negative < 0:
            push_p, push_u = -up_p, -up_u
        else:
            push_p, push_u = up_p - prior * (1 - s_p) / len(s_p), up_u
        gradient = np.zeros_like(theta)
        for at, push in zip(flat, (push_p, push_u)):
            gradient[:-1] += np.bincount(at.reshape(-1), weights=np.repeat(push, width), minlength=width * bins)
            gradient[-1] += push.sum()
        gradient[:-1] += 1e-4 * theta[:-1]
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        theta -= 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    model.weights, model.bias = theta[:-1].reshape(width, bins), float(theta[-1])
    return model


def _featured(rows: DataFrame) -> DataFrame:
    kind = rows.schema["_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("_text")):
                x = features(block)
                at = pa.array(np.arange(block.rows + 1) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(block.row0, block.rows),
                        batch.column("_draw").slice(block.row0, block.rows),
                        pa.ListArray.from_arrays(at, pa.array(x.reshape(-1))),
                    ],
                    names=["_id", "_draw", "x"],
                )

    return rows.mapInArrow(work, f"_id {kind}, _draw double, x array<double>")


def _matrix(rows: DataFrame) -> np.ndarray:
    column = rows.select("x").toArrow().column("x").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def learn_quality(
    docs: DataFrame, labels: DataFrame, *, learn, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", sample: int = SAMPLE
) -> Additive:
    """Fits the classifier on rows whose id passes ``learn`` (a function of the id column).

    Trusted positives are texts labelled 1; the unlabelled set is drawn from all texts, labels not
    looked at; the class prior is the share of ones among the labelled ids. Both sets hold about
    ``sample`` rows, drawn by a hash of the id, so reruns draw the same. An id labelled several
    times is positive if every label says 1; null labels and ids are ignored. Without positives or
    texts every score is the prior, one half if that is unknown too.
    """
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(quality).isNotNull() & learn(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("_lid")).agg(F.min(quality).alias("_label"))
    tally = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("_label"), F.lit(0)).alias("ones")).first()
    texts = docs.filter(learn(F.col(doc_id)))
    n_texts = texts.count()
    share = {"positive": sample / max(tally.ones, 1), "unlabelled": sample / max(n_texts, 1)}
    draw = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 30)) / float(1 << 30)
    rows = texts.select(F.col(doc_id).alias("_id"), draw.alias("_draw"), F.col(text).alias("_text"))
    drawn = frozen(_featured(rows.filter(F.col("_draw") < max(share.values()))), "drawn")
    positive = drawn.filter(F.col("_draw") < share["positive"]).join(known.filter("_label = 1"), F.col("_id") == F.col("_lid"), "left_semi")
    unlabelled = drawn.filter(F.col("_draw") < share["unlabelled"])
    return fit(_matrix(positive), _matrix(unlabelled), tally.ones / tally.n if tally.n else 0.5)


def quality_score(model: Additive, text: Column | str) -> Column:
    """Probability that a text is of good quality, as a column; null text scores as empty text."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        parts = [model.probability(features(block)) for block in text_blocks(column)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(F.col(text) if isinstance(text, str) else text)
