"""Fill-in-middle against cutting with a regular expression, and the way back."""

import hashlib
import random
import re

import numpy as np
import pytest

from colloquy.llm import fillmiddle


def plain(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(4)
    made = ["".join(rng.choice(["a", "bc ", "é", "日本", "\n", "\r\n", "\U0001f600", "<", "<P", "S>", "\x00", "\x85"]) for _ in range(rng.randint(1, 90))) for _ in range(120)]
    return made + ["", "\n", "\n\n\n", "one line", "x\n", "\nx", "a<M>b\nc", "<S", "<<P>\n>", "-" * 70_000 + "\n" + "y\n" * 5000, "long " * 40_000, "".join("z" * (i % 400) + "\n" for i in range(3000))]


def test_index_is_exact_and_bounded():
    rng = random.Random(1)
    for error in (1, 8, 64):
        for lines in ([1] * 2000, [rng.randint(1, 9) for _ in range(3000)], [rng.choice([1, 5000]) for _ in range(700)], [], [7]):
            offsets = np.concatenate(([0], np.cumsum(lines))).astype(np.int64)
            index = fillmiddle.fit(offsets, error)
            assert index.exact(np.arange(len(offsets))).tolist() == offsets.tolist()
            assert np.abs(index.residuals).max() <= error + 1
    assert len(fillmiddle.fit(np.arange(0, 50_000, 5)).starts) == 1


def test_against_regular_expression(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a\nb\nc\n"), (5, None), (7, "x\ny\nz"), (7, "x\ny\nz"), (7, "other\ntext\n")]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, output string, n int")
    for rate, spm in ((100, 50), (40, 100), (100, 0)):
        done = fillmiddle.transform(df, rate=rate, spm=spm)
        got = done.withColumn("back", fillmiddle.restored(done.output, done.form)).collect()
        key = lambda r: tuple(map(str, r))
        assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted((plain(d, t, rate, spm) for d, t in rows), key=key)
        assert all(r.back == r.text for r in got)


def test_stored_index_cuts_as_the_transformation(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in fillmiddle.boundary_index(df).collect():
        index = fillmiddle.RankIndex(np.array(r.starts), np.array(r.offsets), np.array(r.slopes), np.frombuffer(bytes(r.residuals), "<i2").astype(np.int64))
        assert index.exact(np.arange(r.n + 1)).tolist() == fillmiddle.boundaries(rows[r.doc_id][1]).tolist()
    with pytest.raises(ValueError):
        fillmiddle.boundary_index(df, error=0)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fillmiddle.transform(empty).collect() == [] and fillmiddle.boundary_index(empty).collect() == []
