"""Edit matching against a plain edit-distance table."""

import random

from colloquy.llm import decontaminate as d


def plain(item, text):
    """Least edit distance of item to any part of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def edit(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s))
        s = s[:i] + rng.choice(["", "z", s[i] + "q"]) + s[i + 1 :]
    return s


def some():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    items = [" ".join(word() for _ in range(rng.randint(2, 30))) for _ in range(12)] + ["", None, "ab"]
    texts = []
    for _ in range(80):
        t = " ".join(word() for _ in range(40))
        item = rng.choice(items[:12])
        texts.append(t[:50] + " " + edit(rng, item, rng.randint(0, len(item) // 10)) + " " + t[50:])
    return items, [*texts, None, "", items[0].upper(), items[3].replace(" ", "\n\n")]


def test_myers_is_the_edit_distance():
    items, texts = some()
    for item in filter(None, items):
        for t in texts[:20]:
            assert d.myers(d.bits(item), len(item), t)[0] == plain(item, t)


def test_matches_against_all_pairs(spark):
    items, texts = some()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[0], 2)] * 2, "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(None, "x", 1)], "item_id long, text string, doc_id long")
    got = d.matches(docs, bench).collect()
    want = {(i, j): x for i, t in enumerate(texts) for j, it in enumerate(items) if d.normal(it) and (x := plain(d.normal(it), d.normal(t))) <= d.budget(len(d.normal(it)))}
    assert {(r.doc_id, r.item_id): r.distance for r in got if r.doc_id is not None} == want
    assert len(got) == len(want) + 2 * sum(i == 0 for i, _ in want)
    for r in got:
        part = d.normal(texts[r.doc_id or 0])[r.start : r.end]
        assert plain(part, d.normal(items[r.item_id])) <= r.distance
    clean = d.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect() if r.doc_id is not None) == sorted(set(range(len(texts))) - {i for i, _ in want})


def test_blocks_are_whole(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_CHARS", 40)
    items, texts = some()
    docs = spark.createDataFrame(list(enumerate(texts[:10])), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.matches(docs, bench).collect()}
    assert got == {(i, j) for i, t in enumerate(texts[:10]) for j, it in enumerate(items) if d.normal(it) and plain(d.normal(it), d.normal(t)) <= d.budget(len(d.normal(it)))}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert d.matches(docs, items).count() == d.matches(none, items).count() == 0
    assert d.drop_contaminated(docs, items).count() == 1


def test_other_names_and_a_very_long_text(spark):
    item = "which river runs through the old town of this question"
    docs = spark.createDataFrame([(1, "word " * 300_000 + item.replace("old", "odd") + " word" * 10, 7), (2, "clean text", 8)], "id long, body string, key long")
    bench = spark.createDataFrame([(5, item)], "n long, question string")
    kept = d.drop_contaminated(docs, bench, "body", "n", "question")
    assert kept.columns == docs.columns and [r.id for r in kept.collect()] == [2]
    assert [(r.doc_id, r.item_id, r.distance) for r in d.matches(docs, bench, "id", "body", "n", "question").collect()] == [(1, 5, 1)]
