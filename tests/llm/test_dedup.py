"""Near-duplicate groups against all pairs of plain shingle sets."""

import random

import numpy as np
import pytest

from colloquy.llm import dedup


def words(text):
    return (text or "").encode().lower().split()


def plain_set(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows, share=85):
    return [r[:4] for r in brute_groups(rows, share)]


def brute_groups(rows, share):
    """(doc_id, set size, least id reachable, kept, group number) of each row."""
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
        least = (min(ids) if ids else None) if sets[i] else d
        out.append((d, len(sets[i]), least, d is not None and d == least, top(i)))
    return out


def some_rows():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 40, 120, 300]))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 45))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
        rows += [rows[-1].upper(), rows[-1].replace(" ", "\n\t")]
    rows += ["", None, " \n", "one", "One ", "a b c d", "a b c d", "é é é é é", "É é é é é"]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)] + [(0, rows[0]), (0, rows[0]), (None, rows[1]), (None, "nobody else has these few words"), (6, "two texts of one id here now")]


@pytest.mark.parametrize("share", [85, 80])
@pytest.mark.parametrize("stars", [1, 2])
def test_groups_against_all_pairs(spark, monkeypatch, stars, share):
    monkeypatch.setattr(dedup, "BLOCK", 4)
    monkeypatch.setattr(dedup, "STARS", stars)
    rows = some_rows()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, kept int")
    got = [tuple(r) for r in dedup.near_duplicates(df, share=share).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows, share), key=key)
    kept = dedup.drop_duplicates(df, share=share).collect()
    ids = [r.doc_id for r in kept if words(r.text) and r.doc_id is not None]
    one_each = {g: c for _, n, c, _, g in brute_groups(rows, share) if n and c is not None}  # one id may name two groups
    assert sorted(ids) == sorted(one_each.values())
    assert sum(not words(r.text) for r in kept) == sum(not words(t) for _, t in rows)
    assert kept[0].component_id == "x"


def test_closure_finds_links_that_stars_miss():
    """In a block, links between members that are not linked to one hub are found."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = []
    for k in range(40):
        s = base.copy()
        s[k * 4 : k * 4 + 4] = rng.integers(0, 2**63, 4).astype(np.uint64)
        sets.append(np.unique(s))
    names = [bytes([k]) * 16 for k in range(40)]
    sigs, hashes = [dedup.signature(x).tobytes() for x in sets], [x.tobytes() for x in sets]
    assert len(dedup.block_links(names, names, [0] * 40, 0, sigs, hashes, False)) == 39


def test_pruning_keeps_true_links():
    rng = np.random.default_rng(4)
    lost = 0
    for _ in range(300):
        a = rng.integers(0, 2**63, 200).astype(np.uint64)
        b = a.copy()
        b[:16] = rng.integers(0, 2**63, 16).astype(np.uint64)
        assert dedup.is_link(np.unique(a), np.unique(b))
        x, y = dedup.signature(a)[None], dedup.signature(b)[None]
        lost += not len(dedup.survivors(x, y))
    assert lost == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dedup.near_duplicates(df).count() == 0
    assert dedup.drop_duplicates(df).count() == 0


def test_clashing_columns_and_one_id_with_two_texts(spark):
    """Columns named as the operator's own stay; each of two groups that one id names keeps a row."""
    rows = [(1, "first text about the river and the old bridge", "a", 7), (1, "second text of other words in another garden", "b", 8), (2, "first text about the river and the old bridge", "c", 9), (3, "second text of other words in another garden", "d", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, comp string, __id long").withColumnRenamed("comp", "component_id")
    kept = dedup.drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.component_id for r in kept.collect()) == ["a", "b"]


def test_a_very_long_text_and_a_hot_class(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(200_000))
    rows = [(i, "the same words of a text that very many rows hold") for i in range(3000)] + [(5000, long), (5001, long + " and a little more")] + [(6000 + i, None) for i in range(50)]
    got = {r.doc_id: r for r in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].component_id == 0 for i in range(3000)) and got[5001].component_id == 5000
    assert all(got[6000 + i].kept for i in range(50))
