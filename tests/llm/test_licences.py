"""Licence scans against every window of words and every template."""

import random
import time

from colloquy.llm import licences as lic

T = lic.Templates()


def brute(text):
    """All windows of words against all templates, then the stated order of windows that overlap."""
    found = lic.WORD.finditer(text or "")
    spans = [(m[0].lower(), *m.span()) for m in found]
    w = [s[0] for s in spans]
    windows = []
    for name, _, b in T.items:
        for i in range(len(w)):
            best = None
            for j in range(i + 1, min(len(w), i + 2 * b.total() + 2)):
                own = lic.bigrams(w[i : j + 1])
                score = lic.dice(own, b)
                if score >= lic.LEAST and (best is None or score > -best[1]):
                    best = (-(own & b).total(), -score, i, j, name)
            if best and (w[i], w[i + 1]) in b:  # others lose to the window without their first word
                windows.append(best)
    kept = []
    for x in sorted(windows):
        if all(x[3] < k[2] or x[2] > k[3] or (k[:4] == x[:4] and k[4] != x[4]) for k in kept):
            kept.append(x)
    return sorted((n, spans[i][1], spans[j][2], -s) for _, s, i, j, n in kept)


def texts():
    rng = random.Random(7)
    notices = [t for ts in lic.TEMPLATES.values() for t in ts if len(t) < 400]
    common = ["the", "license", "public", "under", "work", "version", "thon", "free", "licensed", "2"]
    out = []
    for _ in range(50):
        w = rng.choice(notices).split()
        for _ in range(rng.randint(0, len(w) // 8)):
            w[rng.randrange(len(w))] = "changed"
        if rng.random() < 0.3:
            w.insert(rng.randrange(len(w)), "and then")
        parts = [rng.choice(common) for _ in range(rng.randint(0, 12))], w, [rng.choice(common) for _ in range(rng.randint(0, 12))]
        text = "".join(x + rng.choice([" ", " ", "\n", "  -- "]) for p in parts for x in p)
        out.append(text.upper() if rng.random() < 0.2 else text)
    out += ["İİ Released under the MIT License. Copyright 2024. Licensed under the MIT License. See LICENSE for details"]
    return out + [None, "", "\n\n", "license", "under the"]


def test_against_all_windows(spark):
    some = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(some)] + [(None, some[0], "x")], "doc_id long, text string, dice string")
    got = {}
    for r in lic.scan(df).collect():
        got.setdefault(r.doc_id, []).append((r.licence, r.start, r.end, r.dice))
    want = {i: b for i, t in enumerate(some) if (b := brute(t))}
    assert {k: sorted(v) for k, v in got.items() if k is not None} == want and want
    assert got.get(None) == got.get(0)


def test_notice_inside_a_line():
    text = "Copyright 2024 A. Person. Licensed under the MIT License. See LICENSE for details, or ask the author of this line."
    assert [(n, text[i:j]) for n, i, j, _ in T.scan(text)] == [("MIT", "Licensed under the MIT License")]


def test_every_template_is_found_as_itself():
    for name, ts in lic.TEMPLATES.items():
        for t in ts:
            assert name in [r[0] for r in T.scan(f"some words before it {t} and some after it")]


def test_versions_are_told_apart():
    assert [r[0] for r in T.scan("This work is licensed under the GNU General Public License, version 2.")] == ["GPL-2.0"]
    assert [r[0] for r in T.scan("This work is licensed under the GNU Lesser General Public License, version 3.")] == ["LGPL-3.0"]


def test_very_long_texts():
    began = time.perf_counter()
    T.scan("\n" * 200_000 + "Licensed under the MIT License." + "\n" * 200_000)
    T.scan("apache\n" * 100_000)
    T.scan("licensed under the mit " * 10_000)
    assert len(T.scan("x " * 50_000 + "Released under the MIT License. " * 200)) == 200
    assert time.perf_counter() - began < 10


def test_given_lines(spark):
    from colloquy.llm.queries import op10_licences

    d = "/root/testdata/sf0.01"
    want = set()
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        want |= {(r.doc_id, lines[x]) for x in lines if x in (r.text or "")}
    got = {(r.doc_id, r.licence) for r in op10_licences(spark, d).where("dice = 1").collect()}
    assert got == want and want


def test_empty_table(spark):
    assert lic.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
