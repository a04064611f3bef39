"""The weak-label classifier against human labels it has not seen, and its estimates."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import quality


def test_posterior_finds_the_good_labeller():
    rng = random.Random(3)
    counts = {}
    for _ in range(20_000):
        bad = rng.random() < 0.2
        sure = "b" if (bad and rng.random() < 0.8) or (not bad and rng.random() < 0.01) else "-"
        other = "b" if bad and rng.random() < 0.6 else "-"
        key = sure + other + rng.choice("bg")
        counts[key] = counts.get(key, 0) + 1
    p = quality.posterior(counts)
    assert p["bbg"] > 0.95 and p["--b"] < 0.4
    assert quality.posterior({}) == {}
    q = quality.posterior({"-b": 50, "-g": 900, "bb": 40, "b-": 40, "--": 900}, human=True)
    assert q["-b"] > 0.9 and q["-g"] < 0.05 and q["b-"] > 0.9 and q["--"] < 0.1


def test_accuracy_on_labels_not_seen(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    got = quality.classify(docs, labels.where(~unseen)).join(labels.where(unseen).withColumnRenamed("toxic", "abusive"), "doc_id")
    rows = got.select("quality", "abusive", "rejected").collect()
    bad = [r for r in rows if r.quality == 0 or r.abusive == 1]
    good = [r for r in rows if not (r.quality == 0 or r.abusive == 1)]
    assert sum(r.rejected for r in bad) / len(bad) > 0.93
    assert sum(r.rejected for r in good) / len(good) < 0.02


@pytest.mark.parametrize("labelled", [False, True])
def test_odd_rows(spark, labelled):
    texts = ["A plain sentence, with nothing odd about it at all."] * 30 + ["### *** $$$ %%% &&& !!! ### ***"] * 10 + ["you stupid worthless idiot scum"] * 5 + [None, "", " "]
    rows = [(i if i % 9 else None, t, 1, "m") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rejected int, m string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (31, 0, 0), (41, 1, 1), (None, 0, 1), (2, None, None)] if labelled else [], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    kept = quality.drop_rejected(docs, labels)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert sum(r.text == texts[0] for r in left) == 30
    assert sum(not (r.text or "").strip() for r in left) == 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 0


def test_unlabelled_documents_teach_at_any_number_of_labels(spark):
    """Bad text of a kind that no labelled document holds is learnt from the estimates, with over 1,000 labels too."""
    rng = random.Random(5)
    plain = lambda: " ".join(rng.choice(["river", "house", "garden", "music", "bread", "letter"]) for _ in range(20))
    odd = lambda: "### *** $$$ %%% &&& " * 4 + plain()
    abuse = lambda: plain() + " idiot morons zorblax"
    texts = [odd() if i % 10 == 0 else plain() for i in range(1_500)] + [abuse() if i % 4 == 0 else plain() for i in range(1_500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(1_500)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(got[i].rejected for i in range(1_500, 3_000, 4))
    assert not any(got[i].rejected for i in range(1_501, 3_000, 4))


def test_sample_holds_both_kinds(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 400)
    base = spark.createDataFrame([(i, f"text {i}") for i in range(4_000)], "doc_id long, whole string")
    for n in (999, 1_000, 2_000):
        told = spark.createDataFrame([(i, "g", "g") for i in range(n)], "doc_id long, human_poor string, human_toxic string")
        got = [r.doc_id for r in quality.draw(base, told, n, 4_000 - n).collect()]
        assert len(set(got)) == len(got)
        assert 140 < sum(i < n for i in got) < 260 and 140 < sum(i >= n for i in got) < 260


def plain_em(rows, human, rounds):
    """The estimates by loops over rows, votes and classes."""
    k = len(rows[0])
    weak = {0: {"-": 5.0, "g": 5.0, "b": 0.1}, 1: {"-": 5.0, "g": 0.5, "b": 5.0}}
    n = quality.TRUST_ROWS
    strong = {0: {"g": quality.TRUST * n, "b": (1 - quality.TRUST) * n}, 1: {"g": (1 - quality.TRUST) * n, "b": quality.TRUST * n}}
    heard = lambda r: r[:-1] if human else r
    kind = lambda r: "b" if "b" in heard(r) else "g" if "g" in heard(r) else "-"

    def counted(r):
        """(labeller, vote) of a row; with people what all heuristics say together is labeller k."""
        if not human:
            return list(enumerate(r))
        return [*enumerate(heard(r)), *([(k - 1, r[-1])] if r[-1] != "-" else []), (k, kind(r))]

    def factors(r):
        """(labeller, vote, power) that tell of a row: what all say together and, where some say bad, single votes."""
        if not human:
            return [(j, v, 1.0) for j, v in enumerate(r)]
        own = [(j, v, 1 / (k - 1) if v == "-" else 1.0) for j, v in enumerate(heard(r))] if kind(r) == "b" else []
        return [*own, (k, kind(r), 1.0), *([(k - 1, r[-1], 1.0)] if r[-1] != "-" else [])]

    bad = []
    for r in rows:
        b = 0.9 if kind(r) == "b" else 0.05
        bad.append(quality.TRUST if human and r[-1] == "b" else 1 - quality.TRUST if human and r[-1] == "g" else b)
    for _ in range(rounds):
        share = (sum(bad) + 1) / (len(rows) + 10)
        said = [[dict(strong[c] if human and j == k - 1 else weak[c]) for j in range(k + human)] for c in (0, 1)]
        for r, b in zip(rows, bad):
            for j, v in counted(r):
                said[0][j][v] += 1 - b
                said[1][j][v] += b
        new = []
        for r in rows:
            p = [1 - share, share]
            for c in (0, 1):
                for j, v, power in factors(r):
                    p[c] *= (said[c][j][v] / sum(said[c][j].values())) ** power
            new.append(p[1] / (p[0] + p[1]))
        bad = new
    return dict(zip(rows, bad))


@pytest.mark.parametrize("human", [False, True])
def test_estimates_against_plain_loops(human):
    rng = random.Random(6)
    rows = []
    for _ in range(600):
        bad = rng.random() < 0.3
        one = "b" if rng.random() < (0.7 if bad else 0.05) else "-"
        two = rng.choice("b-") if bad else rng.choice("gg-")
        rows.append(one + two + rng.choice("b--" if bad else "g--"))
    counts = {p: rows.count(p) for p in rows}
    assert quality.posterior(counts, human, rounds=12) == pytest.approx(plain_em(rows, human, 12), rel=1e-6, abs=1e-9)


def test_labellers_drive_the_scorer(spark):
    """What two labellers say of rows without human labels decides what the scorer learns."""
    rng = random.Random(7)
    plain = lambda: " ".join(rng.choice(["river", "house", "garden", "music", "bread", "letter"]) for _ in range(20))
    texts = [plain() + (" zorblax quibbet" if i % 5 == 0 else "") for i in range(1_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 400, 5)], "doc_id long, quality int, toxic int")
    quiet = "-" * 12
    told = lambda t: ("bb" if "zorblax" in t else "--") + quiet[2:]
    assert sum(r.rejected for r in quality.classify(docs, labels, vote=lambda t: quiet).collect()) == 0
    got = quality.classify(docs, labels, vote=told).collect()
    assert {r.doc_id for r in got if r.rejected} == set(range(0, 1_000, 5))


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000), (2, "|" * 1_000_000), (3, "plain words of a text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 3


def test_fit_is_the_least_loss():
    """No small change of a weight makes the objective less, and parts of the sample change nothing."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 9, 300)
    ids = rng.integers(0, 40, lengths.sum()).astype(np.int32)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    soft = np.clip(np.where(ids[first] < 12, 0.9, 0.1) + rng.normal(0, 0.05, 300), 0, 1)
    weight = rng.uniform(0.5, 1, 300)
    intercept, w = quality.fit_scorer(ids, lengths, soft, weight)

    def objective(b, w):
        z = np.array([b + sum(w.get(int(i), 0.0) for i in ids[a : a + n]) for a, n in zip(first, lengths)])
        return (weight / weight.sum()) @ (np.logaddexp(0, z) - soft * z) + quality.REGULAR * sum(map(abs, w.values()))

    least = objective(intercept, w)
    for i in range(40):
        for step in (-0.05, 0.05):
            assert objective(intercept, w | {i: w.get(i, 0.0) + step}) > least - 1e-5
    assert objective(intercept + 0.05, w) > least - 1e-5
    old, quality.FIT_PART = quality.FIT_PART, 50
    try:
        again = quality.fit_scorer(ids, lengths, soft, weight)
    finally:
        quality.FIT_PART = old
    assert again[0] == pytest.approx(intercept, abs=1e-3)
    assert quality.fit_scorer(ids[:0], lengths[:0], soft[:0], weight[:0]) == (-10.0, {})


def plain_scorer(rows, steps=6_000):
    """(intercept, weights) by plain descent with shrinkage on rows of (features, soft, weight)."""
    total = sum(w for _, _, w in rows)
    x, b = {}, 0.0
    for _ in range(steps):
        slope, up = {}, 0.0
        for ids, soft, w in rows:
            z = b + sum(x.get(i, 0.0) for i in ids)
            wrong = w / total * (1 / (1 + math.exp(-z)) - soft)
            up += wrong
            for i in ids:
                slope[i] = slope.get(i, 0.0) + wrong
        b -= 0.3 * up
        for i, g in slope.items():
            v = x.get(i, 0.0) - 0.3 * g
            x[i] = math.copysign(max(0.0, abs(v) - 0.3 * quality.REGULAR), v)
    return b, x


def test_query_against_plain_version(spark):
    """Votes, estimates by loops, descent by loops: poor, toxic and rejected of every row."""
    rng = random.Random(8)
    plain = lambda: " ".join(rng.choice(["river", "house", "garden", "music"]) for _ in range(4))
    texts = [plain() + rng.choice([" zorb", " zorb quib", ""]) + rng.choice([" vex", "", ""]) for _ in range(90)]
    told = {i: (int("zorb" not in texts[i]), int("vex" in texts[i])) for i in range(0, 90, 2)}
    poor = lambda t: ("b" if "quib" in t else "-") + ("b" if "zorb" in t and len(t) % 3 else "g" if "zorb" not in t else "-") + "-" * (quality.MODELS["poor"] - 2)
    toxic = lambda t: ("b" if "vex" in t else "-") + "-" * (quality.MODELS["toxic"] - 1)
    vote = lambda t: poor(t) + toxic(t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, (q, x) in told.items()], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels, vote=vote).collect()}
    chance = {}
    for name, of, bad in (("poor", poor, lambda q, x: q == 0), ("toxic", toxic, lambda q, x: x == 1)):
        patterns = [of(t) + ("-" if i not in told else "b" if bad(*told[i]) else "g") for i, t in enumerate(texts)]
        believed = plain_em(patterns, True, 100)
        silent = "-" * quality.MODELS[name]
        quiet = quality.WORTH / (quality.WORTH + sum(p[:-1] == silent and p[-1] != "-" for p in patterns))
        b, x = plain_scorer([(quality.features(t), believed[p], quiet if p == silent + "-" else 1.0) for t, p in zip(texts, patterns)])
        chance[name] = [1 / (1 + math.exp(-b - sum(x.get(i, 0.0) for i in quality.features(t)))) for t in texts]
    for i in range(90):
        assert got[i].poor == pytest.approx(chance["poor"][i], abs=0.1) and got[i].toxic == pytest.approx(chance["toxic"][i], abs=0.1)
        assert got[i].rejected == (max(chance["poor"][i], chance["toxic"][i]) >= quality.THRESHOLD)
    assert 10 < sum(r.rejected for r in got.values()) < 80
