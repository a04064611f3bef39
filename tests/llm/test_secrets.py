"""Secret scans against a plain Python scan."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from colloquy.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
SECRETS, OTHERS = (0, 2, 4), (1, 3, 5)


def brute(text, scope=secrets.SCOPE):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    weak = [(m.start(), 5, m.end()) for m in re.finditer(r"""https?://[^\x00-\x20"'<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}""", text)]
    for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
        r = m[0]
        upper, lower, digit = (re.search(c, r) for c in ("[A-Z]", "[a-z]", "[0-9]"))
        if digit and upper and re.fullmatch("[A-Z0-9]+", r) and len(r) <= 40:
            weak.append((m.start(), 3, m.end()))
        elif digit and upper and lower and 20 <= len(r) <= 256:
            weak.append((m.start(), 4, m.end()))
    kept = []
    for s, k, e in weak:
        gaps = [(max(s2 - e, s - e2), k2) for s2, k2, e2 in base + weak]
        fit = OTHERS if k == 4 else SECRETS
        if not any(g < 0 and k2 < 3 for g, k2 in gaps) and any(0 <= g <= scope and k2 in fit for g, k2 in gaps):
            kept.append((s, k, e))
    return sorted(base), sorted(base + kept)


def listed(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def rand_text(rng):
    parts = ["password", "PassWd", "api_key", "secret", "token", "=", ":", ' "', "'", " ", "\n", "é", "😀", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "beef",
             "a1B2c3D4e5F6g7H8i9J0k1", "http://x.example/a?b=1", "10.0.0.1", "word ", "zz-", "=abcdefghijkl", "tokentoken=shortvalue12"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))


def test_against_plain_scan(spark):
    rng = random.Random(5)
    texts = [rand_text(rng) for _ in range(300)] + [None, "", "token=secret=abcdefghijklmnop", 'token="token" : abcdefghijkl', "x " * 5000 + "AKIA" + "Q" * 30 + " y" * 40 + " 10.1.2.3"]
    rows = [(i % 300, t, i, "b") for i, t in enumerate(texts)] + [(1, texts[1], 1, "b")] * 3 + [(None, texts[2], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, whole long, spans string")
    got = secrets.scan(df).select("row.doc_id", "row.text", secrets.listed("base").alias("b"), secrets.listed("spans").alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        base, spans = brute(r.text)
        assert (r.b, r.s) == (listed(base), listed(spans)), r.text


def test_weak_alone_is_not_reported(spark):
    df = spark.createDataFrame([(1, "see http://x.example/ and AAAA1111BBBB2222"), (2, "a1B2c3D4e5F6g7H8i9J0k1 at http://x.example/")], "doc_id long, text string")
    got = {r.doc_id: r.s for r in secrets.scan(df).select("row.doc_id", secrets.listed("spans").alias("s")).collect()}
    assert got == {1: "", 2: "weak_secret:0:22,endpoint:26:43"}


def test_redact(spark):
    df = spark.createDataFrame([(1, "é password=abcdefabcdefabcdef end", "x"), (2, "clean", None), (3, None, "x")], "doc_id long, text string, row string")
    got = {r.doc_id: (r.text, r.row) for r in secrets.redact(df).collect()}
    assert got == {1: ("é [SECRET] end", "x"), 2: ("clean", None), 3: (None, "x")}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.scan(df).count() == 0


def test_query_against_plain_scan(spark):
    from colloquy.llm.queries import op1_secret_scan

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op1_secret_scan(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        base, spans = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest() and r.spans == listed(spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]


def test_a_text_full_of_spans(spark):
    """Work grows with the spans, not with their square."""
    import time

    text = " ".join(f"{i:016x}" for i in range(20_000)) + " password=aaaaaaaaaaaa http://x.example/"
    df = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r.spans for r in secrets.scan(df).select("row.doc_id", "spans").collect()}
    assert time.perf_counter() - began < 20
    assert [(s.start, s.kind, s.end) for s in got[1]] == [(i * 17, 2, i * 17 + 16) for i in range(20_000)] + [(340_000, 0, 340_021), (340_022, 5, 340_039)]
    assert got[2] == []


def test_hot_copies_of_a_text(spark):
    text = "a1B2c3D4e5F6g7H8i9J0k1 at http://x.example/"
    rows = [(i, text) for i in range(500)] + [(1000 + i, f"{text} number {i}") for i in range(20)] + [(2000 + i, "") for i in range(100)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", F.size("spans").alias("n")).collect()
    assert sorted((r.doc_id, r.n) for r in got) == sorted((d, 2 if t else 0) for d, t in rows)
