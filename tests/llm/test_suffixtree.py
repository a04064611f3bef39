"""The suffix tree and the base score against plain counting."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from colloquy.llm import suffixtree as st


def rows():
    rng = random.Random(4)
    parts = ["th", "er", "on", "tion", "É", "a", "The"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(150)] + [None, "", " \t", "a\x0bb\xa0c", "x" * 300]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(3, texts[3])] * 2 + [(None, texts[4]), (3, "other text of this id")]


def is_held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


def plain_tree(train, share, gain):
    """Counts by context, retained contexts and a scorer, symbol by symbol."""
    counts = defaultdict(Counter)
    total = 0
    for t in train:
        s = b"\n" * st.DEPTH + st.symbols(t)
        for i in range(st.DEPTH, len(s)):
            total += 1
            for d in range(st.DEPTH + 1):
                counts[s[i - d : i]][s[i]] += 1
    ok = {c for c, n in counts.items() if sum(n.values()) >= share * total}
    kept = set()
    for c in ok:
        if c and c[1:] in ok:
            n, u = counts[c], counts[c[1:]]
            a, b = sum(n.values()), sum(u.values())
            if sum(x * math.log2(x / a * b / u[k]) for k, x in n.items()) >= gain * len(n):
                kept |= {c[i:] for i in range(len(c))}

    def p(c, sym):
        up = p(c[1:], sym) if c else 1 / 256
        n = counts.get(c, Counter())
        kinds = len(n) if c else 1
        return (n[sym] + kinds * up) / (sum(n.values()) + kinds)

    def score(t):
        s = b"\n" * st.DEPTH + st.symbols(t)
        out = 0.0
        for i in range(st.DEPTH, len(s)):
            c = next((s[i - d : i] for d in range(st.DEPTH, 0, -1) if s[i - d : i] in kept), b"")
            out += math.log10(p(c, s[i]))
        return out

    return kept, score, p


@pytest.mark.parametrize("frequent", [0, 5, 10_000])
def test_against_plain(spark, monkeypatch, frequent):
    monkeypatch.setattr(st, "FREQUENT", frequent)
    data = rows()
    df = spark.createDataFrame([(d, t, "x", 1.0) for d, t in data], "doc_id long, text string, key string, score double")
    got = st.score(df).collect()
    assert len(got) == len(data)
    train = [t for d, t in data if not is_held(d)]
    tokens = Counter(w for t in train for w in st.words(t))
    ends = len(train)
    total, v = sum(tokens.values()) + ends, len(tokens) + 1
    _, score, _ = plain_tree(train, st.LEAST_SHARE, st.LEAST_GAIN)
    want = []
    for d, t in data:
        w = st.words(t)
        base = sum(math.log10((tokens[x] + 1) / (total + v + 1)) for x in w) + math.log10((ends + 1) / (total + v + 1))
        want.append((d, is_held(d), len(w) + 1, sum(x in tokens for x in w) + 1, total, base, score(t)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-5)


def test_distributions_sum_to_one(spark):
    df = spark.createDataFrame([(t,) for _, t in rows()], "whole string")
    tree = st.Tree(st.grow(st.gram_counts(df, st.DEPTH + 1)))
    p = 10.0 ** tree.logs.reshape(tree.size, tree.width)
    assert np.allclose(p[:, :-1].sum(axis=1) + p[:, -1] * (257 - tree.width), 1, atol=1e-4) and tree.size > 10


def test_better_than_base_on_held_out(spark):
    from colloquy.llm.queries import op8_suffix_tree

    got = [r for r in op8_suffix_tree(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_empty_and_no_training(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert st.score(none).count() == 0
    held = next(i for i in range(50) if is_held(i))
    r = st.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)
    assert r.score == pytest.approx(5 * math.log10(1 / 256), rel=1e-5) and r.base_score == 0


@pytest.mark.parametrize("head", [0, 200])
def test_rare_and_six_byte_contexts_count(spark, monkeypatch, head):
    """A six-byte context of a share under 1e-5 decides, with sequences joined as well as sent to the tasks."""
    monkeypatch.setattr(st, "HEAD", head)
    monkeypatch.setattr(st, "GROUP", 500)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(5)) + " " + " ".join(rng.choice(["xbcdefp", "ybcdefq"]) for _ in range(30)) for _ in range(150)] + ["zbcdefr"] * 5 + ["\U0001f600 caf\u00e9 zbcdefr"]
    data = list(enumerate(texts))
    got = {r.doc_id: r.score for r in st.score(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    train = [t for d, t in data if not is_held(d)]
    kept, score, _ = plain_tree(train, 0, st.LEAST_GAIN)
    assert {b"xbcdef", b"ybcdef", b"zbcdef"} <= kept
    assert got == pytest.approx({d: score(t) for d, t in data}, rel=1e-5)


def test_rare_context_joins_at_any_size(spark):
    """A context seen 50 times among over 5,000,000 symbols joins: no share of the corpus is asked for."""
    a, b = int.from_bytes(b"qbcdefg"), int.from_bytes(b"xbcdefh")
    grams = spark.createDataFrame([(a, 50, 50), (b, 5_100_000, 5_100_000)], "code long, n long, m long")
    found, _ = st.chances(grams)
    logp = {r.code: r.logp for r in found.collect()}
    assert logp[a] > math.log10(0.9)


def test_sequences_come_from_symbols_made_once():
    """A text is taken apart once: its sequences and its words both come from its symbols."""
    texts = ["Ab  cd\tE", None, "", " x ", "ab cd e" * 50]
    read = [st.symbols(t) for t in texts]
    plain = [int.from_bytes((b"\n\n" + d)[i : i + 3], "big") for d in read for i in range(len(d))]
    assert st._grams(read, 3).tolist() == plain and st._grams([], 3).tolist() == []
    assert [d.split() for d in read] == [st.words(t) for t in texts]
    runs = [np.unique(np.array(r), return_counts=True) for r in ([3, 1, 3], [7], [1, 3, 9])]
    (code,), (n,), size = st._merged([c for c, _ in runs], [k for _, k in runs])
    assert dict(zip(code.tolist(), n.tolist())) == {1: 2, 3: 3, 7: 1, 9: 1} and size == 4


def test_steps_are_made_without_a_loop_over_words(monkeypatch):
    """Words, symbols and sequences of a step come from whole arrays and equal those made text by text."""
    import pyarrow as pa

    texts = ["  Ab \t\ncD\x0b\x0ce ", "", " \t", None, "x", "\u00c9\x85\xa0\u00fc\u2003Z A\x1cB\x00c\x1f", "ab cd " * 40]
    lists = st._split(pa.array(texts))
    assert [[w.encode() for w in x or []] for x in lists.to_pylist()] == [st.words(t) for t in texts]
    read = st._joined(lists)
    assert read == [st.symbols(t) for t in texts]
    for size in (1, 3, 7):
        plain = [int.from_bytes((b"\n" * (size - 1) + d)[i : i + size], "big") for d in read for i in range(len(d))]
        assert st._grams(read, size).tolist() == plain
    codes = np.unique(np.random.default_rng(1).integers(0, 1 << 56, 3000))
    at, place, shift = st._slots(codes[::2])
    assert codes[::2].tolist() == codes[::2][place[st._find(at, shift, codes[::2])]].tolist() and (st._find(at, shift, codes[1::2]) < 0).all()


def test_tasks_send_a_sequence_once(spark, monkeypatch):
    """Training and held-out rows of a task share a row of sums; sums that were sent early add up."""
    data = [(i, t) for i, (_, t) in enumerate(rows())]
    df = spark.createDataFrame(data, "doc_id long, whole string")
    want = {}
    for d, t in data:
        s = b"\n\n" + st.symbols(t)
        for i in range(len(s) - 2):
            n = want.setdefault(int.from_bytes(s[i : i + 3], "big"), [0, 0])
            n[0] += not is_held(d)
            n[1] += 1
    marked = np.array([2, 3, 3, 9, 10])
    (sent,) = st._sent(np.unique(marked), np.array([1, 2, 1, 1]))
    assert sent.to_pydict() == {"code": [1, 4, 5], "n": [1, 0, 1], "m": [3, 1, 1]}
    for flush, together in ((st.FLUSH, st.SORTED), (100, 300)):
        monkeypatch.setattr(st, "FLUSH", flush)
        monkeypatch.setattr(st, "SORTED", together)
        got = st.gram_counts(df, 3, st.held_out()).collect()
        assert len(got) == len(want) and {r.code: [r.n, r.m] for r in got} == want
        counted = {bytes(r.word): r.n for r in st.word_counts(df).collect()}
        assert counted == Counter(w for _, t in data for w in st.words(t))
