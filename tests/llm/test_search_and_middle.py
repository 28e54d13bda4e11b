"""Fill-in-middle, threshold search and ranked search against brute force."""

import collections
import hashlib
import math
import random
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import stratified_index
from tallyloom.llm.fill_in_middle import CutTree, fill_in_middle, restored
from tallyloom.llm.stratified_index import index_search, ranked_search, read_index, write_index
from tallyloom.llm.threshold_search import SortedLists, top_inner_products

TEXTS = ["", None, "a", "é€𝄞x", "has <S> inside", "<P", "P>", "almost <M", " lead and trail ", "   ", "ab cd\tef", "x" * 5000, "é𝄞 " * 900 + "end", "two  words", "same", "same"]


def arranged(i, text, unit):
    """The contract, on Python strings."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * j : 8 * j + 8], 16) for j in range(4)]
    if unit == "words":
        starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)][1:]
        starts = [0, *starts, len(text)] if text else [0]
    else:
        starts = list(range(len(text) + 1))
    n = len(starts) - 1
    if n == 0 or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = (starts[k] for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit", ["code_points", "words"])
def test_fill_in_middle_and_back(spark, unit):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "no id é"), (None, None), (3, "again under three"), (-7, "negative")]
    df = spark.createDataFrame([(*r, 1, "z", "f") for r in rows], "doc_id long, text string, n int, _id string, form string")
    got = fill_in_middle(df, unit=unit).withColumn("back", restored()).collect()
    want = sorted([(i, *arranged(i, t, unit), t or "") for i, t in rows], key=repr)
    assert sorted([tuple(r) for r in got], key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.limit(0), unit=unit).count() == 0


def test_cut_tree_against_counting():
    rng = random.Random(4)
    for n in (1, 5, 63, 64, 65, 1000):
        units = np.array([rng.random() < 0.3 for _ in range(n)])
        points = units | np.array([rng.random() < 0.5 for _ in range(n)])
        tree, at = CutTree(units, points, block=16), np.flatnonzero(units)
        for k in range(len(at) + 1):
            byte = int(at[k]) if k < len(at) else n
            assert tree.cut(k) == (byte, int(points[:byte].sum()))


def best_vectors(rows, marked, k):
    out = []
    for q, u in marked:
        scores = sorted((-max(min(sum(a * b for a, b in zip(u, v)), 2**63 - 1), -(2**63)), i is None, i or 0, i) for i, v in rows if i != q and len(v) == len(u))
        out += [(q, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(scores[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [(4096, 1 << 14), (40, 3)])
def test_top_inner_products_against_all_pairs(spark, shard):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(60)] + [(500 + i, [0.0] * 12) for i in range(20)] + [(600 + i, [1.0, -0.5, 0.25]) for i in range(4)]
    rows += [(None, rows[7][1]), (None, rows[8][1]), (10, rows[3][1]), (10, rows[3][1]), rows[20], (700, [-1e30] * 12), (710, [3e30] * 12), (720, [])]
    odd = [(800, None), (810, [None] + [1.0] * 11), (820, [float("nan")] * 12), (830, [float("inf")] * 12)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<float>, _size int, rank int")
    whole = {(i, tuple(min(max(math.floor(1024 * float(x)), -(2**63)), 2**63 - 1) for x in np.array(v, np.float32))) for i, v in rows}
    want = best_vectors(whole, [r for r in whole if r[0] is not None and r[0] % 10 == 0], 10)
    got = top_inner_products(df, queries=F.col("vec_id") % 10 == 0, least_rows=shard[0], query_rows=shard[1]).collect()
    assert sorted([tuple(r) for r in got], key=repr) == want
    assert top_inner_products(df.limit(0), queries=F.lit(True)).count() == 0
    assert top_inner_products(df, queries=F.lit(None).cast("boolean")).count() == 0


def test_threshold_search_stops_early():
    rng = np.random.default_rng(1)
    vectors = np.floor(1024 * rng.normal(size=(20_000, 3))).astype(np.int64)
    read = []

    class Counted(SortedLists):
        def _scored(self, query):
            vectors, query = super()._scored(query)
            return CountedRows(vectors), query

    class CountedRows:
        def __init__(self, inner):
            self.inner, self.shape, self.dtype = inner, inner.shape, inner.dtype

        def __getitem__(self, at):
            if not isinstance(at, tuple):
                read.append(len(at))
            return self.inner[at]

    lists = Counted(vectors)
    rows, scores = lists.top(vectors[17], [17], 10)
    every = vectors @ vectors[17]
    every[17] = -(10**9)
    assert rows.tolist() == np.lexsort((np.arange(20_000), -every))[:10].tolist() and scores == every[rows].tolist()
    assert sum(read) < 10_000


def terms_of(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def ranked(docs, items, k):
    bags = [(i, collections.Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    count, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 25 + (75 * sum(bag.values()) * count) // total
            score = sum(
                q * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t, q in collections.Counter(terms_of(text)).items()
                if t in bag
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def lexical():
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(120)] + ["É", "naïve", "x½"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 10, 10, 10, 40, 200])))) for i in range(250)]
    docs += [(300 + i, "T1 t2, t3-T4 common template text") for i in range(70)]
    docs += [(None, docs[0][1]), (None, "t1 t1 t1"), (7, "t5 t5 under a repeated id"), docs[3], (900, None), (901, ""), (902, " ... "), (903, "long " * 6000 + "t9")]
    items = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(25)]
    items += [(50, "T1 T2 t2 t2"), (51, None), (52, ""), (53, "absent words only"), (None, "t9 É"), (54, "t1 t2"), (54, "t7 t8"), (55, "t1"), (55, "T1!")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search_against_scoring_everything(spark, small, monkeypatch):
    docs, items = lexical()
    df = spark.createDataFrame([(*r, 1, "s") for r in docs], "doc_id long, text string, m int, _id string")
    asked = spark.createDataFrame([(*r, 3, "b") for r in items], "item_id long, text string, score int, terms string")
    path = tempfile.mkdtemp(dir="/tmp") + "/index"
    if small:
        monkeypatch.setattr(stratified_index, "ROW_POSTINGS", 60)
    count, _ = write_index(df, path, row_docs=9 if small else 1 << 13, part_terms=100 if small else 1 << 20)
    options = {"asked_terms": 40, "held_postings": 500} if small else {}
    got = ranked_search(read_index(spark, path), count, asked, k=10, **options).collect()
    different = [r for r in items if r != (55, "T1!")]
    assert sorted([tuple(r) for r in got], key=repr) == ranked(docs, different, 10)


def test_ranked_search_of_nothing(spark):
    docs, items = lexical()
    df = spark.createDataFrame(docs[:20], "doc_id string, text string")
    asked = spark.createDataFrame(items[:3], "item_id string, text string")
    named = [(str(i), t) for i, t in docs[:20]]
    got = index_search(df, asked, tempfile.mkdtemp(dir="/tmp") + "/a", k=4).collect()
    assert sorted([tuple(r) for r in got], key=repr) == named_ranks(named, [(str(i), t) for i, t in items[:3]], 4)
    assert index_search(df.limit(0), asked, tempfile.mkdtemp(dir="/tmp") + "/b").count() == 0
    assert index_search(df, asked.limit(0), tempfile.mkdtemp(dir="/tmp") + "/c").count() == 0


def named_ranks(docs, items, k):
    number = {name: at for at, name in enumerate(sorted(i for i, _ in docs))}
    back = {at: name for name, at in number.items()}
    return sorted([(item, rank, back[i], s) for item, rank, i, s in ranked([(number[i], t) for i, t in docs], items, k)], key=repr)
