"""Fuzzy names against all pairs, and what a pair scores against a plain table of subsequences."""

import itertools
import random

import pytest

from colloquy.functions import likeness
from colloquy.operators import matching, upkeep


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_scores_of_pairs():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc é日") for _ in range(rng.randint(0, 70))) for _ in range(2))
        assert likeness.common(a, b) == plain_common(a, b)
    w = likeness.weighted_ratio
    assert w("abc", "abc") == 100 and w("", "abc") == 0 and w("abcd", "abce") == 75
    assert w("new york mets", "mets new york") == 95  # the same words
    assert round(w("golden ring", "golden ring of the north star"), 4) == 90  # a part of the longer
    assert round(w("ring", "a very fine ring of gold"), 4) == 90
    assert w("ab", "abcdefghijklmnopqrstuvwx") == 60  # over eight times as long
    assert likeness.word_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert likeness.part_ratio("abcd", "xxabxd") == 75 and round(likeness.part_ratio("abcd", "xxabc"), 2) == 85.71


def some_names(n=260):
    rng = random.Random(7)
    vocab = ["gold", "ring", "golden", "store", "north", "line", "the", "of", "store2", "a", "an"]
    names = {"a", "b", "ab", "abc", "ac", "é", "日本", "日本店"}
    while len(names) < n:
        kind = rng.random()
        if kind < 0.4:
            name = " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 5)))
        elif kind < 0.7:
            name = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 60)))
        else:
            name = list(rng.choice(sorted(names)))
            for _ in range(rng.randint(1, 4)):
                if rng.random() < 0.5 and len(name) > 1:
                    del name[rng.randrange(len(name))]
                else:
                    name.insert(rng.randint(0, len(name)), rng.choice("abcdex "))
            name = "".join(name)
        if name.strip():
            names.add(name)
    return sorted(names)


@pytest.mark.parametrize("least, kind", [(85.0, "weighted"), (70.0, "words"), (92.0, "weighted"), (86.0, "words")])
def test_no_pair_is_lost(spark, least, kind):
    names = some_names()
    of = likeness.weighted_ratio if kind == "weighted" else likeness.word_ratio
    want = {(a, b): round(of(a, b), 6) for a, b in itertools.permutations(names, 2) if of(a, b) >= least}
    df = spark.createDataFrame([(n, "t") for n in names], "name string, group string")
    got = {(r.name, r.other): round(r.score, 6) for r in matching.scored_pairs(df, df, least, kind).collect()}
    assert got == want and len(want) > 100


def test_groups_and_best(spark):
    rows = [("alphabet", "x"), ("alphabets", "x"), ("alphabetic", "y"), ("alphabot", None), ("zz", None), ("", "x"), (None, "x")]
    df = spark.createDataFrame(rows, "name string, type string")
    want = {}
    for a, s in rows:
        for b, t in rows:
            if a and b and a != b and (s is None or t is None or s == t) and likeness.weighted_ratio(a, b) >= 85:
                want[a, s] = max(want.get((a, s), (0, "")), (likeness.weighted_ratio(a, b), b))
    assert {(r.name, r.type): (r.score, r.canonical) for r in matching.names_alike(df, df).collect()} == want and len(want) == 3


def test_far_edits_are_found(spark):
    a, b = "abcdefghijklmnopqrstuvwxyzabcd", "abdefghijklmnoqrstuvwxyzabcd"[:27]
    df = spark.createDataFrame([(a, "t"), (b, "t")], "name string, type string")
    assert {r.name for r in matching.names_alike(df, df).collect()} == {a, b}


def test_names_of_one_kind_merge_without_pairs(spark):
    nodes = spark.createDataFrame([(i, "same name", "t", 0, 0, None) for i in range(500)] + [(900, "same nam", "t", 0, 0, None), (901, "other", "t", 0, 9, None)], "entity_id long, name string, type string, community int, degree int, expired_at int")
    got = {r.source_id: (r.canonical_id, r.score) for r in upkeep.merge_pairs(nodes).collect()}
    assert got == {i: (0, 100) for i in range(1, 500)} | {900: (0, 94)}


def test_speakers(spark):
    queries = [("q1", "t", "Anna Li", [1.0, 0.0]), ("q2", "t", "Li Anna", [0.0, 1.0]), ("q3", "t", "Bob", None), ("q4", "u", "Anna Li", [1.0, 0.0]), ("q5", "t", "Ana Lee", [1.0, 0.0])]
    speakers = [(1, "t", "Anna Li", [1.0, 0.1]), (2, "t", "Bobby", [1.0, 1.0]), (3, "t", "Carla", None)]
    q = spark.createDataFrame(queries, "query string, tenant string, name string, vector array<double>")
    s = spark.createDataFrame(speakers, "candidate long, tenant string, name string, vector array<double>")
    got = {r["query"]: (r.candidate, r.verdict) for r in matching.speaker_verdicts(matching.speaker_scores(q, s)).collect()}
    assert got == {"q1": (1, "CONFIRMED"), "q2": (1, "AMBIGUOUS"), "q3": (2, "INFERRED"), "q4": (None, "NO_MATCH"), "q5": (1, "INFERRED")}


def pairs_joined(spark, names, least, kind="weighted"):
    """How many candidates are found of names of one type."""
    df = spark.createDataFrame([(n, "t") for n in names], "name string, group string")
    return matching.candidate_pairs(df, df, least, kind, words_near=False).count()


def test_words_of_one_length_make_no_pairs(spark):
    names = [f"e{i}" for i in range(100000, 100400)]
    assert pairs_joined(spark, names, 85.0) == 0
    df = spark.createDataFrame([(n, t) for n in [*names, "e100", "e100000 x"] for t in ("x", None)], "name string, type string")
    want = {}
    for a, b in itertools.permutations([*names, "e100", "e100000 x"], 2):
        s = likeness.weighted_ratio(a, b)
        if s >= 85:
            want[a] = max(want.get(a, (0, "")), (s, b))
    got = matching.names_alike(df, df).collect()
    assert {(r.name, r.type): (r.score, r.canonical) for r in got} == {(n, t): v for n, v in want.items() for t in ("x", None)}


def test_edits_score_without_texts(spark):
    df = spark.createDataFrame([(n, "t") for n in ("abcdefgh", "abcdefgx", "abcdefg", "日本語の店頭販売", "日本語の店舗販売")], "name string, group string")
    found = matching.candidate_pairs(df, df, 85.0, "words", one_way=True).collect()
    assert {(r.name, r.other): r.edits for r in found} == {("abcdefgh", "abcdefgx"): 2, ("abcdefg", "abcdefgh"): 1, ("abcdefg", "abcdefgx"): 1, ("日本語の店舗販売", "日本語の店頭販売"): 2}


def test_names_taken_apart_are_never_broadcast(spark, capsys):
    names = spark.createDataFrame([(f"e{i}", "t") for i in range(60)] + [("e1 e2", "t")], "name string, type string")
    nodes = spark.createDataFrame([(i, f"e{i}", "t", 1, 1, None) for i in range(60)], "entity_id long, name string, type string, community long, degree long, expired_at long")
    for df in (matching.names_alike(names, names), upkeep.merge_pairs(nodes)):
        df.collect()
        capsys.readouterr()
        df.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
