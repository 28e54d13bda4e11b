"""Substring de-duplication against earlier documents by suffix automata of reference shards."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import fragments as fr
from tallyloom.llm.automata import SuffixAutomaton
from tallyloom.llm.blocks import Rolling, Words, starts_within, text_blocks
from tallyloom.llm.spans import kept
from tallyloom.session import frozen

#: Fragment bytes handled per call; groups inside stay apart.
SHARD_BYTES = 1 << 20


def _earlier_spans(columns: dict, span: int) -> dict:
    """Per group: stream each document's fragments through the automaton of earlier documents, then add them.

    Rows are sorted by anchor and document, so the automaton of a group holds smaller ids only.
    """
    anchors = columns["anchor"].to_pylist()
    ids = columns["_id"].to_pylist()
    texts = columns["bytes"].to_pylist()
    rows, starts, stops = [], [], []
    for _, group in groupby(range(len(anchors)), key=anchors.__getitem__):
        automaton = SuffixAutomaton()
        members = list(group)
        for i, (_, same) in enumerate(groupby(members, key=ids.__getitem__)):
            same = list(same)
            split = [texts[r].split() for r in same]
            if i:
                for row, words in zip(same, split):
                    since = None
                    for at, size in enumerate(automaton.matches(words)):
                        if size >= span:
                            since = at - span + 1 if since is None else since
                        elif since is not None:
                            rows.append(row), starts.append(since), stops.append(at)
                            since = None
                    if since is not None:
                        rows.append(row), starts.append(since), stops.append(len(words))
            if same[-1] != members[-1]:
                for words in split:
                    automaton.add(words)
    take = pa.array(rows, pa.int64())
    return {
        "anchor": columns["anchor"].take(take),
        "fragment": columns["fragment"].take(take),
        "start": pa.array(starts, pa.int32()),
        "stop": pa.array(stops, pa.int32()),
    }


def _window_rows(span: int):
    def work(batches):
        for batch in batches:
            for block in text_blocks(batch.column("bytes")):
                words = Words(block, fr.SEPARATORS)
                at = np.flatnonzero(starts_within(words.first, span, len(words.hash)))
                row = np.searchsorted(words.first, at, side="right") - 1
                take = pa.array(row + block.row0)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).take(take) for c in ("_id", "anchor", "fragment")],
                        pa.array(at - words.first[row], pa.int32()),
                        pa.array(Rolling(words.hash).windows(span)[at].view(np.int64)),
                    ],
                    names=["_id", "anchor", "fragment", "start", "window"],
                )

    return work


def automaton_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = 13, k: int = 5, group_limit: int = fr.GROUP_LIMIT) -> DataFrame:
    """Removes each word inside a ``span``-word window that a document with a smaller id also holds.

    The corpus is its own reference. Reference fragments are dealt into shards by anchor; a shard
    holds every earlier fragment that can match its documents' fragments, so each document meets
    only the automata that matter. Words are separated by the bytes 0x20 and 0x09-0x0D.

    Returns per input row ``doc_id``, ``n_words``, ``removed`` (maximal ``start, stop`` word
    ranges) and ``kept`` (remaining words joined by one space, binary). Windows are judged on the
    input. Repeats within one id, rows with equal ids included, stay. A null id is neither smaller
    nor larger than any: such a row loses nothing and removes nothing. Null text has no words. An
    empty table gives an empty result. Extra columns are ignored.
    """
    source = fr.keyed(docs, doc_id, text)
    kind = source.schema["_id"].dataType.simpleString()
    runs = fr.anchors(source.filter("_id is not null"), "words", span, k)
    again = frozen(fr.repeated(runs), "repeated")
    firsts = frozen(
        again.groupBy("anchor", "fragment", "mixed").agg(F.min(F.struct("_id", "_key", "lo", "hi")).alias("rep")), "firsts"
    )
    sizes = firsts.filter("mixed").groupBy("anchor").agg(F.count("*").alias("around"))
    wanted = (
        firsts.filter("mixed").select("rep.*", "anchor", "fragment").withColumn("upto", F.col("hi") + span).drop("hi").join(sizes, "anchor")
    )
    pieces = frozen(fr.cut(source, wanted, "words", ["anchor", "fragment", "around"]), "pieces")
    cold = pieces.filter(F.col("around") <= group_limit)
    spans = fr.grouped(
        cold, "anchor", ["_id", "_key", "lo"], lambda c: _earlier_spans(c, span), "anchor bigint, fragment bigint, start int, stop int", SHARD_BYTES
    )
    crowded = pieces.filter(F.col("around") > group_limit)
    if not crowded.isEmpty():
        # Too many different surroundings for one automaton: windows are compared one by one, combined before the shuffle.
        windows = frozen(
            crowded.mapInArrow(_window_rows(span), f"_id {kind}, anchor bigint, fragment bigint, start int, window bigint"), "windows"
        )
        seen = windows.groupBy("window").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).filter("_first < _last")
        hits = windows.join(seen, "window").filter("_id > _first")
        spans = spans.unionByName(hits.select("anchor", "fragment", "start", (F.col("start") + span).alias("stop")))
    inner = spans.groupBy("anchor", "fragment").agg(F.collect_list(F.struct("start", "stop")).alias("inner"))
    known = firsts.select("anchor", "fragment", F.col("rep._id").alias("_first")).join(inner, ["anchor", "fragment"], "left")
    whole = F.array(F.struct(F.col("lo").alias("start"), (F.col("hi") + span).alias("stop")))
    shifted = F.transform("inner", lambda r: F.struct((F.col("lo") + r.start).alias("start"), (F.col("lo") + r.stop).alias("stop")))
    removed = (
        again.join(known, ["anchor", "fragment"])
        .select("_id", "_key", F.when(F.col("_id") > F.col("_first"), whole).otherwise(shifted).alias("ranges"))
        .filter("ranges is not null")
        .select("_id", "_key", F.inline("ranges"))
    )
    return kept(source, removed, "words").withColumnRenamed("_id", doc_id)
