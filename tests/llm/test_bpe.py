"""The encoder against the library on whole texts."""

import hashlib
import random

import numpy as np
import pytest

from colloquy.llm import bpe


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def whole(lib, t):
    return np.asarray(lib.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def rand_text(rng, n):
    parts = ["the", "'re", "'", " ", "  ", "\n", "\t", "<|endoftext|>", "é", "日本", "😀", "123", "!!", "...", "thonthwhon", " ", "\u0085", "\x1c", "a", "Z", "_", "‍", "ß", "'ll"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_against_library(spark, lib):
    rng = random.Random(3)
    texts = [rand_text(rng, rng.randint(0, 80)) for _ in range(200)] + [None, "", " ", "a b", "a  b", " a", "a "]
    texts += ["x" * 900, "thon" * 400, " " * 500, "a" + " " * 300 + "b", "!" * 700, "日" * 300, "1" * 500, "<|endoftext|>" * 60]
    texts += ["".join(rng.choice("thonerandingwhes") for _ in range(1500)) for _ in range(20)]
    texts += [rand_text(rng, 400) for _ in range(20)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[-1], None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = bpe.decode(bpe.encode(df, long_chars=200, part_chars=64).select("doc_id", "text", "token_ids"), to="back").collect()
    assert len(got) == len(rows)
    for r in got:
        assert bytes(r.token_ids) == whole(lib, r.text), r.text
        ids = np.frombuffer(bytes(r.token_ids), "<u4").tolist()
        assert r.back == lib.decode(ids, skip_special_tokens=False) == (r.text or "")


def test_decode_of_broken_bytes(lib):
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert bpe.text_of(np.asarray(ids, "<u4").tobytes(), bpe.default_path()) == lib.decode(ids, skip_special_tokens=False)


def test_query(spark, lib):
    from colloquy.llm.queries import op2_bpe

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in op2_bpe(spark, d).collect():
        ids = whole(lib, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df).count() == 0


def test_long_stretches_with_the_production_sizes(spark, lib, monkeypatch):
    """Unsplit stretches of all lengths go through halves and joins, over tasks where they pass a part."""
    rng = random.Random(8)
    base64 = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(200_000))
    letters = "".join(rng.choice("thonerandingwhes") for _ in range(120_000))
    texts = [f"before  {letters}\n\nafter", base64, "a b " + letters[:20_000] + " c", " " * 70_000 + "x", "".join(rng.choice("日本語の") for _ in range(70_000))]
    texts += [letters[: bpe.STRETCH_CHARS + k] for k in range(-2, 3)] + [f"x\n\n{letters[:60]}\n\n{letters[60:150]}'ll 12", "\n" * 40 + letters[:40], f"<|endoftext|>{letters[:90]}<|endoftext|>"]
    joins = []
    old = bpe.Bpe.join
    monkeypatch.setattr(bpe.Bpe, "join", lambda self, a, b: joins.append(1) or old(self, a, b))
    direct = bpe.Bpe(bpe.default_path())
    assert direct.encode(texts[5:]) == [whole(lib, t) for t in texts[5:]] and joins
    monkeypatch.undo()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode(df).collect():
        assert bytes(r.token_ids) == whole(lib, texts[r.doc_id]), r.doc_id
