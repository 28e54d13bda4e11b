"""Text operators against brute force, on texts with nulls, repeats, ties and clashing columns."""

import collections
import hashlib
import math
import random
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm import jaccard
from tallyloom.llm.automaton_dedup import automaton_dedup
from tallyloom.llm.blocks import text_blocks
from tallyloom.llm.bitpacking import bits_for, pack, unpack
from tallyloom.llm.decontamination import contamination, words_covered
from tallyloom.llm.language_model import context_tree_scores
from tallyloom.llm.mixing import mix_sources, word_count
from tallyloom.llm.quality import learn_quality, quality_score
from tallyloom.llm.suffix_dedup import suffix_dedup
from tallyloom.llm.token_counts import ChunkCounts, MergeTable, token_counts
from tallyloom.llm.token_output import ChunkIds, token_output

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, _id string, _key string, _text string, row string, size int, n long, source string"


def frame(spark, docs, source=None):
    rows = [(i, t, "x", None, "y", "z", 1, 2, source(i) if source else "s") for i, t in docs]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=1):
    """Copies, near copies, a passage in a third of the texts, a null, empty, tiny and long texts, repeated and null ids."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(900)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage = words(60)
    docs = []
    for i in range(36):
        body = words(rng.randint(1, 90))
        docs.append(" ".join(body[:20] + passage + body[20:] if i % 3 == 0 else body))
    base = words(120)
    for _ in range(14):
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        docs.append(" ".join(near))
    docs += [docs[0]] * 3 + ["", "one", "one two\tthree ", None, "a" * 700, "ab " * 300, "  " + " ".join(words(4000)), "It's DON'T <|endoftext|>x ½ \x1c é"]
    named = list(enumerate(docs))
    return named + [named[3], (3, "another text under id three " * 9), (None, docs[0]), (None, None)]


DOCS = corpus()


def text_of(t):
    return (t or "").encode()


def by_row(rows, key="doc_id"):
    return sorted((tuple(r) for r in rows), key=repr)


def test_token_counts_equal_the_library(spark):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = []
    for i, t in DOCS:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len(text_of(t)), n, n > 100))
    assert by_row(token_counts(frame(spark, DOCS), tokenizer=VOCABULARY, limit=100).collect()) == by_row(want)
    assert token_counts(frame(spark, []), tokenizer=VOCABULARY).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 31])
def test_packed_ids_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003)
    packed = pack(ids, bits)
    assert len(packed) == -(-1003 * bits // 8)
    assert (unpack(packed, bits, 0, 1003) == ids).all() and (unpack(packed, bits, 501, 77) == ids[501:578]).all()
    assert bits_for(1 << bits) == bits


def test_token_output_reads_back_what_the_library_gives(spark, scratch_dir):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    docs = [d for d in DOCS if d[0] != 3]
    out = token_output(frame(spark, docs), f"{scratch_dir}/ids", tokenizer=VOCABULARY, vocabulary=49_408, end_id=1, block_ids=500).collect()
    start, want = 0, []
    order = sorted([d for d in docs if d[0] is None], key=lambda d: 0) + sorted([d for d in docs if d[0] is not None])
    lengths = collections.Counter()
    for i, t in order:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        lengths[i, len(ids), zlib.crc32(ids.tobytes())] += 1
        want.append((i, start, len(ids)))
        start += len(ids)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == lengths
    named = [(r.doc_id, r.start, r.n_tokens) for r in sorted(out, key=lambda r: r.start)]
    assert named[2:] == want[2:] and {r[0] for r in named[:2]} == {None}
    empty = token_output(frame(spark, []), f"{scratch_dir}/none", tokenizer=VOCABULARY, vocabulary=49_408, end_id=1)
    assert empty.count() == 0


def cut_ranges(n, windows, span):
    gone = np.zeros(n, bool)
    for p in windows:
        gone[p : p + span] = True
    return gone


@pytest.mark.parametrize("group_limit", [2048, 2])
def test_suffix_dedup_removes_every_copy(spark, group_limit):
    span = 40
    seen = collections.Counter(text_of(t)[p : p + span] for _, t in DOCS for p in range(len(text_of(t)) - span + 1))
    want = []
    for i, t in DOCS:
        b = text_of(t)
        gone = cut_ranges(len(b), [p for p in range(len(b) - span + 1) if seen[b[p : p + span]] > 1], span)
        want.append((i, len(b), int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    got = suffix_dedup(frame(spark, DOCS), span=span, k=8, group_limit=group_limit).collect()
    assert by_row((r.doc_id, r.n_bytes, sum(x.stop - x.start for x in r.removed), bytes(r.kept)) for r in got) == by_row(want)


def test_suffix_dedup_keeps_the_first(spark):
    docs = [(i, t) for i, t in enumerate(t for i, t in DOCS[:54])]
    span, first = 40, {}
    for i, t in docs:
        for p in range(len(text_of(t)) - span + 1):
            first.setdefault(text_of(t)[p : p + span], (i, p))
    want = []
    for i, t in docs:
        b = text_of(t)
        gone = cut_ranges(len(b), [p for p in range(len(b) - span + 1) if first[b[p : p + span]] != (i, p)], span)
        want.append((i, bytes(np.frombuffer(b, np.uint8)[~gone])))
    got = suffix_dedup(frame(spark, docs), span=span, k=8, keep="first").collect()
    assert by_row((r.doc_id, bytes(r.kept)) for r in got) == by_row(want)
    assert suffix_dedup(frame(spark, []), span=span, k=8).count() == 0


@pytest.mark.parametrize("group_limit", [2048, 2])
def test_automaton_dedup_spares_the_smallest_id(spark, group_limit):
    span, least = 6, {}
    split = [(i, text_of(t).split()) for i, t in DOCS]
    for i, w in split:
        for p in range(len(w) - span + 1):
            if i is not None:
                key = tuple(w[p : p + span])
                least[key] = min(least.get(key, i), i)
    want = []
    for i, w in split:
        hit = [p for p in range(len(w) - span + 1) if i is not None and least[tuple(w[p : p + span])] < i]
        gone = cut_ranges(len(w), hit, span)
        want.append((i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g)))
    got = automaton_dedup(frame(spark, DOCS), span=span, k=3, group_limit=group_limit).collect()
    assert by_row((r.doc_id, r.n_words, sum(x.stop - x.start for x in r.removed), bytes(r.kept)) for r in got) == by_row(want)
    if group_limit == 2:
        assert automaton_dedup(frame(spark, []), span=span, k=3).count() == 0


def shingles(t):
    table = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    w = text_of(t).translate(table).split()
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("stars", [True, False])
def test_jaccard_components(spark, monkeypatch, stars):
    if not stars:  # the probes alone must find every link
        monkeypatch.setattr(jaccard, "_similar", lambda *a: F.lit(False))
    sets = [shingles(t) for _, t in DOCS]
    root = list(range(len(DOCS)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(DOCS):
        known = least.get(find(x))
        least[find(x)] = i if known is None else known if i is None else min(i, known)
    want = [(i, len(sets[x]), least[find(x)] if sets[x] else i) for x, (i, _) in enumerate(DOCS)]
    got = jaccard.similarity_classes(frame(spark, DOCS)).collect()
    assert by_row((r.doc_id, r.n_shingles, r.component_id) for r in got) == by_row(want)
    if stars:
        assert jaccard.similarity_classes(frame(spark, [])).count() == 0


def plain_tree(train, depth=5):
    counts = {}
    for b in train:
        b = bytes(depth) + b + b"\xff"
        for p in range(depth, len(b)):
            for k in range(8):
                for d in range(depth + 1):
                    counts.setdefault((b[p - d : p], (1 << k) | (b[p] >> (8 - k))), [0, 0])[(b[p] >> (7 - k)) & 1] += 1
    block = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) for k, (a, b) in counts.items()}
    below = collections.defaultdict(float)
    for d in range(depth, -1, -1):
        for k in [k for k in counts if len(k[0]) == d]:
            total = block[k] if d == depth else math.log(0.5) + np.logaddexp(block[k], below[k])
            if d:
                below[k[0][1:], k[1]] += total

    def score(b):
        b, total = bytes(depth) + b + b"\xff", 0.0
        for p in range(depth, len(b)):
            for k in range(8):
                bit, chance = (b[p] >> (7 - k)) & 1, 0.5
                for d in range(depth, -1, -1):
                    key = (b[p - d : p], (1 << k) | (b[p] >> (8 - k)))
                    if key in counts:
                        own = (counts[key][bit] + 0.5) / (sum(counts[key]) + 1)
                        weight = 1.0 if d == depth else 1 / (1 + math.exp(min(700, below[key] - block[key])))
                        chance = weight * own + (1 - weight) * chance
                total += math.log10(chance)
        return total

    return score


@pytest.mark.parametrize("heavy", [10**6, 40])
def test_context_tree_scores(spark, heavy):
    docs = [d for d in DOCS if len(text_of(d[1])) < 900]
    table = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    low = [(i, text_of(t).translate(table)) for i, t in docs]
    train = [b for i, b in low if i is None or i % 3]
    score = plain_tree(train)
    words = collections.Counter(w for b in train for w in b.split())
    n, v = sum(words.values()) + len(train), len(words) + 1
    total = n + 0.5 * (v + 1)
    want = {}
    for i, b in low:
        base = sum(math.log10((words[w] + 0.5) / total) for w in b.split()) + math.log10((len(train) + 0.5) / total)
        want.setdefault(i, []).append((len(b.split()) + 1, sum(words[w] > 0 for w in b.split()) + 1, n, base, score(b)))
    learn = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    rows = context_tree_scores(frame(spark, docs), train=learn, heavy_grams=heavy, heavy_words=heavy).collect()
    assert len(rows) == len(docs)
    for i, expected in want.items():
        got = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows if r.doc_id == i)
        for a, b in zip(got, sorted(expected)):
            assert a == pytest.approx(b, rel=1e-9)


def test_context_tree_without_training_rows(spark):
    rows = context_tree_scores(frame(spark, [(1, "abc"), (2, None)]), train=F.lit(None).cast("boolean")).collect()
    assert all(r.bits_per_byte == pytest.approx(8) and r.n_known == 0 for r in rows)
    assert context_tree_scores(frame(spark, []), train=F.lit(True)).count() == 0


def test_contamination_with_short_and_repeated_items(spark):
    items = [(1, "The Quick-brown fox; jumps over the lazy dog again today, friends"), (2, "short ITEM"), (3, None), (4, "..."), (2, "lone"), (None, "nameless one"), (5, "q " * 12)]
    docs = [(1, "x THE quick brown fox jumps over the lazy dog again today friends y"), (2, "the quick brown fox jumps over the lazy dog"), (3, "a short item, lone nameless one"), (4, None), (5, ""), (6, "q " * 11), (6, "q " * 9), (7, "é short item" * 3)]
    import re

    def words(t):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)

    windows = [(i, tuple(w[p : p + 10])) for i, t in items for w in [words(t)] for p in range(max(1, len(w) - 9)) if w]
    want = []
    for i, t in docs:
        w, gone, found = words(t), set(), set()
        for name, window in windows:
            for p in range(len(w) - len(window) + 1):
                if tuple(w[p : p + len(window)]) == window:
                    gone |= set(range(p, p + len(window)))
                    found |= {str(name)} if name is not None else set()
        want.append((i, len(w), len(gone), sorted(found)))
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, print string")
    got = contamination(frame(spark, docs), bench).select("doc_id", "n_words", words_covered("hits"), "items").collect()
    assert by_row(got) == by_row(want)
    assert contamination(frame(spark, docs), bench.limit(0)).filter(F.size("hits") > 0).count() == 0
    assert contamination(frame(spark, []), bench).count() == 0


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["w"] * rng.randint(1, 60))) for i in range(1500)] + [(None, "a b"), (7, None), (7, None)]
    names = ["big", "big", "mid", None, "tiny"]
    df = frame(spark, docs, lambda i: names[0 if i is None else i % 5 if i < 1400 else 0])
    rows = mix_sources(df, doc_id="doc_id", source="source", size=word_count("text")).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
    weight = {s: 1 + k % 3 for k, s in enumerate(["big", "mid", "tiny", None])}
    capped, target = set(), {}
    while True:  # share, stop at three times the size, share again
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(w for t, w in weight.items() if t not in capped) for s in sizes}
        over = {s for s in sizes if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    assert len(rows) == len(docs) and {r.source: r.source_size for r in rows} == dict(sizes)
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        assert mine[0].target == pytest.approx(target[s])
        assert sum(r.copies * r.size for r in mine) == pytest.approx(target[s], abs=60)
        assert max(r.copies for r in mine) <= 3
    again = mix_sources(df.repartition(3), doc_id="doc_id", source="source", size=word_count("text")).select("row.doc_id", "row.source", "size", "source_size", "target", "copies")
    assert by_row(again.collect()) == by_row(rows)
    assert mix_sources(frame(spark, []), doc_id="doc_id", source="source", size=word_count("text")).count() == 0


def test_quality_learns_from_positives_and_unlabelled_texts(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["the", "of", "tree", "river", "stone", "walks"]) for _ in range(40)) + "." for _ in range(240)]
    bad = ["!!! ".join(rng.choice(["BUY", "NOW", "WIN"]) for _ in range(40)) for _ in range(80)]
    texts = good + bad
    docs = list(enumerate(texts)) + [(None, None), (5000, ""), (5001, "x" * 5000), (0, texts[0])]
    labels = spark.createDataFrame([(i, int(i < 240), "c") for i in range(320) if i % 2] + [(None, 1, "c"), (1, None, "c"), (3, 0, "c")], "doc_id long, quality int, text string")
    df = frame(spark, docs)
    model = learn_quality(df, labels, learn=lambda c: F.coalesce(c % 5 != 0, F.lit(False)))
    scores = {r.doc_id: r.p for r in df.select("doc_id", quality_score(model, "text").alias("p")).collect()}
    held = [i for i in range(320) if i % 5 == 0]
    assert np.mean([(scores[i] >= 0.3) == (i < 240) for i in held]) > 0.95
    assert all(0 <= p <= 1 for p in scores.values())
    unknown = learn_quality(frame(spark, []), labels.limit(0), learn=lambda c: F.lit(True))
    assert {r.p for r in df.limit(3).select(quality_score(unknown, "text").alias("p")).collect()} == {0.5}


def test_token_memory_is_bounded_by_bytes():
    """Long texts without spaces, as in Chinese or base64, are encoded and forgotten; frequent stretches outlive a generation."""
    rng = random.Random(6)
    coder = ChunkIds(VOCABULARY, remembered=4 << 20)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for turn in range(40):
        texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000)), " ".join(f"w{rng.randrange(10**9)}" for _ in range(3000)) + " frequent <|endoftext|>x"]
        for block in text_blocks(pa.array(texts)):
            ids, counts = coder.encode(block, 1)
            want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts[block.row0 : block.row0 + block.rows]]
            assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
        assert coder.young.nbytes <= 4 << 20 and coder.old.nbytes <= 5 << 20
    assert 0 < len(coder.old.keys) < 120_000


def test_token_output_of_many_long_texts_without_spaces(spark):
    rng = random.Random(12)
    texts = [(i, "".join(chr(rng.randrange(0x3040, 0x30FF)) for _ in range(2000)) * 17) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = {r.doc_id: r.n_tokens for r in token_output(df, tempfile.mkdtemp(dir="/tmp") + "/t", tokenizer=VOCABULARY, vocabulary=49_408, end_id=1).collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts}


@pytest.fixture(scope="module")
def colliding(spark):
    """Two different texts of over 200 bytes that a 32-bit hash takes for one."""
    text = F.concat_ws(" ", *[F.sha2(F.concat(F.lit(f"{j}:"), F.col("id").cast("string")), 256) for j in range(5)])
    pairs = spark.range(500_000).select(text.alias("text")).groupBy(F.hash("text").alias("h")).agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b")
    return tuple(pairs.orderBy("h").select("a", "b").first())


def test_texts_with_equal_short_hashes_stay_apart(spark, colliding):
    a, b = colliding
    other = " ".join(f"word{i}" for i in range(80))
    docs = [(None, a), (None, b), (None, other), (1, a), (1, b), (2, a)]
    df = frame(spark, docs)
    removed = {(r.doc_id, r.kept.decode() if r.kept else ""): len(r.removed) for r in suffix_dedup(df, span=200).collect()}
    assert removed[None, other] == 0 and (1, "") in removed and sum(n == 0 for n in removed.values()) == 1
    lone = frame(spark, [(1, a), (1, b), (2, a)])
    kept = sorted((r.doc_id, bytes(r.kept).decode()) for r in suffix_dedup(lone, span=200).collect())
    assert kept == [(1, ""), (1, b), (2, "")]
    gone = sorted((r.doc_id, bytes(r.kept).decode()) for r in automaton_dedup(lone, span=3).collect())
    assert gone == sorted([(1, a), (1, b), (2, "")])
    few = frame(spark, [(None, a), (None, b), (None, other)])
    assert len({r.component_id for r in jaccard.similarity_classes(few.withColumn("doc_id", F.when(F.col("text") == other, 9).otherwise(F.lit(None).cast("long"))), words=5, percent=75).collect()}) == 2
    docs3 = few.withColumns({"lang": F.lit("en")})
    assert sorted(r.text for r in corpus_pipeline.near_duplicates(spark, docs3, None).collect()) == sorted([a, b, other])
    bench = spark.createDataFrame([(7, " ".join(other.split()[5:30]))], "item_id long, text string")
    assert sorted((r.n_words, len(r.hits) > 0) for r in contamination(few, bench, span=10).collect()) == [(5, False), (5, False), (80, True)]
    assert {r.text for r in corpus_pipeline.decontaminate(spark, docs3, "/root/testdata/sf0.001").collect()} == {a, b, other}
    scores = context_tree_scores(lone, train=F.lit(True)).collect()
    assert len(scores) == 3 and len({(r.doc_id, round(r.score, 6)) for r in scores}) == 3


def test_counts_of_long_stretches_are_not_remembered():
    counts = ChunkCounts(MergeTable(VOCABULARY))
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(5)
    for _ in range(20):
        chunk = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400)) + "a" * 300 + "1,"
        assert counts[chunk.encode()] == len(tokenizer.encode(chunk, add_special_tokens=False).ids)
    assert counts[b"short"] == 1 and set(counts) == {b"short"}
    assert max(map(len, counts.words)) <= 256
