"""Phrase fingerprints against a byte-by-byte parse and a plain order of documents."""

import random

import numpy as np
import xxhash

from colloquy.llm import lzprint


def plain_phrases(data):
    known, at = set(), 0
    for end in range(1, len(data) + 1):
        if data[at:end] not in known:
            known.add(data[at:end])
            at = end
    return known | ({data[at:]} if at < len(data) else set())


def texts():
    rng = random.Random(8)
    words = ["the", "er", "on", "é", "日本", "tion", "\n", "x"]
    return ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["", "a", "aa", "ab", "a" * 5000]


def test_parse():
    for t in texts():
        assert lzprint.phrases(t.encode()) == plain_phrases(t.encode())


def test_likeness_near_the_true_share():
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(2000)]
    a = " ".join(base)
    b = " ".join(base[:1000] + ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(1000)])
    x, y = lzprint.phrases(a.encode()), lzprint.phrases(b.encode())
    assert abs(lzprint.likeness(lzprint.fingerprint(a), lzprint.fingerprint(b)) - len(x & y) / len(x | y)) < 0.2
    assert lzprint.likeness(lzprint.fingerprint(a), lzprint.fingerprint(a)) == 1
    none = np.empty(0, np.uint32)
    assert lzprint.likeness(none, none) == 1 and lzprint.likeness(none, lzprint.fingerprint("a")) == 0


def check(spark, rows, part_bytes, monkeypatch):
    monkeypatch.setattr(lzprint, "PART_BYTES", part_bytes)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, place string")
    got = lzprint.compare_with_next(df).collect()
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest(r[1].encode(), 42)))
    want = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = map(lzprint.fingerprint, (t, edited, after))
        want.append((d, len(t), edited, lzprint.written(a), lzprint.written(b), lzprint.likeness(a, b), lzprint.likeness(a, c)))
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_next_document(spark, monkeypatch):
    rows = [(i * 7 % 65, t) for i, t in enumerate(texts())]
    check(spark, rows, 1000, monkeypatch)


def test_next_with_nulls_and_repeats(spark, monkeypatch):
    t = texts()
    rows = [(None, t[0]), (None, None), (5, t[1]), (5, t[1]), (5, t[2]), (-3, ""), (9, None), (9, t[3])]
    check(spark, rows, 50, monkeypatch)
    check(spark, rows, 1 << 20, monkeypatch)


def test_rows_without_ids_are_dealt_out(spark, monkeypatch):
    """Null ids do not all come to one range."""
    monkeypatch.setattr(lzprint, "PART_BYTES", 100)
    df = spark.createDataFrame([(None, f"text number {i}") for i in range(200)], "doc_id long, text string")
    counts = [r["count"] for r in lzprint.with_next(df).where("place = 0").groupBy("part").count().collect()]
    assert sum(counts) == 200 and max(counts) < 60


def test_one_and_none(spark, monkeypatch):
    check(spark, [(1, "abcdef")], 10, monkeypatch)
    assert lzprint.compare_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprint_column(spark):
    got = lzprint.fingerprints(spark.createDataFrame([(1, "abc"), (2, None), (3, "abc")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {1: lzprint.written(lzprint.fingerprint("abc")), 2: "", 3: lzprint.written(lzprint.fingerprint("abc"))}
