"""The Jaccard join against all pairs of plain shingle sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import jaccardjoin


def plain_set(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 3 else [tuple(w[i : i + 3]) for i in range(len(w) - 2)])


def brute(rows, share):
    sets = [plain_set(t) for _, t in rows]
    comp = list(range(len(rows)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= share * len(a | b):
                comp[top(i)] = top(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return out


def some_rows(seed=5, groups=14):
    """Families of texts, each a few words from the one before, with shared passages and common words."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 12, 60, 200, 400]))]
        if rng.random() < 0.5:
            base += passage
        w = base
        for _ in range(rng.randint(1, 12)):
            w = list(w if rng.random() < 0.5 else base)
            for _ in range(rng.randint(0, max(1, len(w) // 70))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
        rows += [rows[-1].upper(), rows[-1].replace(" ", "\x0b\n")]
    rows += ["", None, " \t", "Ü é", "ü é", "a\xa0b c", "a b", "A  b"]
    rng.shuffle(rows)
    return [(i * 7 % len(rows), t) for i, t in enumerate(rows)] + [(None, rows[0]), (None, "only without id"), (3, "w1 w2"), (3, rows[1])]


def check(spark, rows, share):
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, n int, token string")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, jaccardjoin.joined(df, share=share).collect()), key=key) == sorted(brute(rows, share), key=key)


@pytest.mark.parametrize("share", [90, 60])
def test_against_all_pairs(spark, share):
    check(spark, some_rows(share), share)


def test_by_blocks_alone(spark, monkeypatch):
    """One star round and small blocks: most links come from block pairs."""
    monkeypatch.setattr(jaccardjoin, "STARS", 1)
    monkeypatch.setattr(jaccardjoin, "BLOCK", 4)
    monkeypatch.setattr(jaccardjoin, "FLUSH", 50)
    monkeypatch.setattr(jaccardjoin, "BROADCAST_IDS", 0)
    check(spark, some_rows(8, 8), 85)


def test_prefixes_of_similar_sets_share_enough():
    rng = np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        gone = int(rng.integers(0, max(1, len(a) // 20) + 1))
        b = np.unique(np.concatenate((a[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64))))
        shared = len(np.intersect1d(a, b))
        if not len(b) or 100 * shared < 90 * (len(a) + len(b) - shared):
            continue
        level = lambda h: (h >> np.uint64(9)) % np.uint64(16)
        (x, lx), (y, ly) = (jaccardjoin.adaptive_prefix(s, level(s)) for s in (a, b))
        low = min(lx, ly)
        cut = lambda p, s, low=low: p[: len(s) - jaccardjoin.least_overlap(len(s), 90) + low]
        assert len(np.intersect1d(cut(x, a), cut(y, b))) >= low


def test_costly_prefixes_grow():
    rare, common = np.zeros(200, np.uint8), np.full(200, 12, np.uint8)
    hashes = np.arange(200, dtype=np.uint64) << np.uint64(40)
    assert jaccardjoin.adaptive_prefix(hashes, rare)[1] == 1
    prefix, matches = jaccardjoin.adaptive_prefix(hashes, common)
    assert matches > 1 and len(prefix) == 200 - 180 + matches


def test_counters(spark):
    texts = ["a b c d", "a b c", "x y z", None, ""] * 3 + ["a b c"]
    table = jaccardjoin.counters(spark.createDataFrame([(t,) for t in texts], "text string"))
    of = lambda t: jaccardjoin.levels(jaccardjoin.shingles(t), table).tolist()
    assert of("a b c") == [round(2 * np.log2(7))] and of("b c d") == [round(2 * np.log2(3))] and of("never seen before") == [0, ]


def test_very_long_and_empty(spark):
    rng = random.Random(1)
    long = [f"t{rng.randrange(10**6)}" for _ in range(60_000)]
    check(spark, [(1, " ".join(long)), (2, " ".join([*long[:-900], *long[:900]])), (3, " ".join(long[:50_000]))], 90)
    assert jaccardjoin.joined(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_each_step_is_dealt_once(spark, monkeypatch):
    """Postings and the texts of candidates are shuffled once, and classes go by numbers and not by their long keys."""
    plans, cut = {}, jaccardjoin.cut

    def seen(df, name):
        plans.setdefault(name, (dict(df.dtypes), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")))
        return cut(df, name)

    monkeypatch.setattr(jaccardjoin, "cut", seen)
    check(spark, some_rows(3, 6), 90)
    types, exchanges = plans["members"]
    assert types["cid"] == "bigint" and exchanges == 1
    assert plans["sets0"][1] == 1
    assert plans["open"][0]["comp"] == "bigint"


def test_rows_that_repeat_make_one_set(spark):
    """A class has the set of one row, however many rows have its id and text."""
    df = spark.createDataFrame([(1, "a b c d")] * 5 + [(2, "a b c e"), (None, "a b c d"), (1, "z")], "doc_id long, text string")
    key = jaccardjoin.text_key
    classes = df.where("doc_id is not null").distinct().select((F.col("doc_id") * 10 + F.length("text")).alias("cid"), F.col("doc_id").alias("rep"), key("text").alias("text_key"))
    got = jaccardjoin._class_sets(classes, classes.select("cid").where("cid <> 11"), df, "doc_id", "text").collect()
    assert sorted((r.cid, len(r.hashes)) for r in got) == [(17, 2), (27, 2)]
