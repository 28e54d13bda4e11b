"""Vector classes, components and the corpus pipeline."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from tallyloom.llm.components import components  # noqa: E402
from tallyloom.llm.quantisation import Rotation, _cells, _codes, _masks, vector_classes  # noqa: E402
from tallyloom.session import frozen  # noqa: E402
from tallyloom.sources.tables import Tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def joined(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(1, i) for i in range(2, 200)] + [(500, 400)], []])
def test_components(spark, edges):
    edges = random.Random(1).sample(edges, len(edges)) + edges[:3]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges + [(7, 7)][: len(edges)], "a long, b long")).collect()}
    assert got == joined(edges)


@pytest.mark.parametrize("block_rows", [2000, 20])
def test_vector_classes_against_all_pairs(spark, block_rows):
    rng = np.random.default_rng(5)
    rows = []
    for centre in rng.normal(size=(25, 32)):
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), (centre + rng.normal(scale=0.12, size=32)).astype(np.float32).tolist(), int(len(rows) % 2)))
    hot = rng.normal(size=32)
    rows += [(len(rows) + i, (hot + rng.normal(scale=0.1, size=32)).astype(np.float32).tolist(), 0) for i in range(60)]
    rows += [(len(rows) + i, rows[0][1], rows[0][2]) for i in range(5)]
    odd = [None, [0.0] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1.0] * 7, []]
    rows += [(9000 + i, v, 0) for i, v in enumerate(odd)] + [(9100, rows[0][1], None)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, copies int")
    good = [(i, np.array(v, float), g) for i, v, g in rows if i < 9000]
    links = [(a, b) for x, (a, u, g) in enumerate(good) for b, v, h in good[:x] if g == h and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93]
    degree = {i: 0 for i, _, _ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    root = joined(links)
    want = {i: (degree[i], root.get(i, i), root.get(i, i) == i) for i in degree}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_classes(df, block_rows=block_rows, exact=True).collect()}
    assert set(got) == set(want)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert 0.98 * there <= found <= there
    assert np.mean([got[i] == want[i] for i in want]) > 0.97
    if block_rows == 20:
        assert vector_classes(df.limit(0)).count() == 0
        assert vector_classes(df.limit(0), exact=True).count() == 0


def hubs_and_spokes():
    """Per hub, spokes at cosine 0.935 to it and below 0.93 to each other, among vectors at 0.87 to 0.92."""
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v)
    out = []
    for _ in range(12):
        hub = unit(rng.normal(size=64))
        out.append(hub)
        for c in [0.935] * 25 + rng.uniform(0.87, 0.92, size=50).tolist():
            side = rng.normal(size=64)
            out.append(c * hub + np.sqrt(1 - c * c) * unit(side - (side @ hub) * hub))
    return np.array(out).astype(np.float32)


@pytest.mark.parametrize("block_rows", [2000, 100])
def test_vector_classes_find_every_link_of_a_hub(spark, block_rows):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(hubs_and_spokes())]
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = np.triu(x @ x.T >= 0.93, 1)
    degree, root = hit.sum(axis=0) + hit.sum(axis=1), joined(np.argwhere(hit).tolist())
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_classes(df, block_rows=block_rows, exact=True).collect()}
    assert got == {i: (degree[i], root.get(i, i)) for i, _, _ in rows}


def all_links(rows, cosine=0.93):
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([g for _, _, g in rows])
    return np.argwhere(np.triu((x @ x.T >= cosine) & (label[:, None] == label[None, :]), 1))


def pairs_of(tables, codes):
    """The pairs of rows that share the masked code of some table, and in how many of them they are owned."""
    met, owned = np.zeros((len(codes), len(codes)), bool), np.zeros((len(codes), len(codes)), int)
    for mask in tables:
        same = (codes & mask)[:, None] == (codes & mask)[None, :]
        owned += same & ~met
        met |= same
    return met, owned


@pytest.mark.parametrize("block_rows", [2000, 20])
def test_tables_find_the_links_of_hubs_and_link_no_other(spark, block_rows):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(hubs_and_spokes())]
    rows += [(len(rows) + i, rows[i][1], 0) for i in range(3)]
    links = all_links(rows)
    degree = np.bincount(links.ravel(), minlength=len(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in vector_classes(df, block_rows=block_rows).collect()}
    assert all(got[i].n_links <= degree[i] for i in got) and len(got) == len(rows)
    assert sum(r.n_links for r in got.values()) >= 0.9 * 2 * len(links)
    root = joined(links.tolist())
    assert all(got[i].component_id >= root.get(i, i) and got[i].kept == (got[i].component_id == i) for i in got)
    # Rows linked to anything are in one of the true components, never across two.
    assert all(root.get(i, i) == root.get(r.component_id, r.component_id) for i, r in got.items())


def test_tables_count_each_link_once_whatever_the_block(spark):
    rng = np.random.default_rng(21)
    rows = []
    for centre in rng.normal(size=(30, 48)):
        for _ in range(int(rng.integers(2, 20))):
            rows.append((len(rows), (centre + rng.normal(scale=0.15, size=48)).tolist(), len(rows) % 3))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    answers = [sorted(tuple(r) for r in vector_classes(df, block_rows=n).collect()) for n in (2000, 3)]
    assert answers[0] == answers[1]
    assert sum(r[1] for r in answers[0]) >= 0.95 * 2 * len(all_links(rows)) > 0


def test_tables_serve_every_length_and_directions_that_no_vector_takes(spark):
    rows = [(i, v, i % 2) for i, v in enumerate([[1.0] * 7, [0.5] * 7, [3.0] * 7] * 4)]
    rows += [(100, [2.0], 0), (101, [5.0], 0), (102, [-1.0], 0), (103, [1.0] * 300, 0), (104, [2.0] * 300, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_classes(df).collect()}
    assert all(got[i] == (5, i % 2) for i in range(12))
    assert got[100] == got[101] == (1, 100) and got[102] == (0, 102) and got[103] == got[104] == (1, 103)


def test_tables_compare_a_small_part_of_the_pairs():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = 0.94 * x[:400] + np.sqrt(1 - 0.94**2) * (side := rng.normal(size=(400, 64))) / np.linalg.norm(side, axis=1)[:, None]
    x = np.vstack([x, near / np.linalg.norm(near, axis=1)[:, None]])
    codes = _codes(Rotation(x, 64, rounds=10).project(x))
    assert abs(np.unpackbits(codes.view(np.uint8)).mean() - 0.5) < 0.05
    for width, share in ((8, 0.05), (12, 0.01)):
        met, owned = pairs_of(_masks(64, width, 0.93), codes)
        assert owned.max() == 1 and np.triu(met, 1).sum() < share * len(x) ** 2 / 2
        links = np.triu(x @ x.T >= 0.93, 1)
        assert links.sum() > 300 and met[links].mean() >= 0.9


def test_vector_classes_compare_every_length(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v, i % 2) for i, v in enumerate([[1.0] * 7, [0.5] * 7] * 3)]
    for size in (24, 33):
        for centre in rng.normal(size=(30, size)):
            rows += [(len(rows) + i, (centre + rng.normal(scale=0.2, size=size)).tolist(), 0) for i in range(3)]
    rows += [(900, [2.0] * 7, 0), (901, [3.0] * 7, 1), (902, [1.0] * 8, 0)]
    x = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.93]
    degree = np.bincount(np.ravel(links), minlength=903)
    root = joined(links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_classes(df, block_rows=30, exact=True).collect()}
    assert got == {i: (degree[i], root.get(i, i)) for i, _, _ in rows}


def test_vector_cells_rule_out_only_what_is_too_far():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(40, 16)), 15, axis=0) + rng.normal(scale=0.1, size=(600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    row, cell, home = _cells(Rotation(x, 5).project(x), 2 - 2 * 0.93 + 1e-9)
    assert len(row) < 600 * 17 / 2
    met = np.zeros((600, 600), int)
    for c in np.unique(cell):
        here = [row[(cell == c) & home], row[(cell == c) & ~home]]
        met[np.ix_(here[0], here[0])] += 1
        met[np.ix_(here[0], here[1])] += 1
        met[np.ix_(here[1], here[0])] += 1
    assert met.max() == 1 and met[x @ x.T >= 0.93].min() == 1


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    extra = {"_hash": F.lit("h"), "_rid": F.lit(1), "size": F.lit(2)}
    docs = Tables(spark, SMALL).documents.withColumns(extra)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long").withColumns(extra)
    docs = frozen(docs.unionByName(odd))
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = frozen(stage(spark, docs, SMALL))
        assert out.columns == docs.columns
        sizes.append(out.count())
        if name == "near_duplicates":
            again = corpus_pipeline.near_duplicates(spark, out, SMALL)
            assert again.count() == out.count()
        docs = out
    assert sizes[0] < 203 and sizes[1] < sizes[0] and sizes[2] < sizes[1]
    ids = corpus_pipeline.token_ids(spark, docs, SMALL)
    assert ids.count() == sizes[-1]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
