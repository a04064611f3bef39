"""Running sums, paths, change logs, lanes, robust centroids and depths against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import changes, graphs, retrieval, scans, sequences, substrings, upkeep


def test_running_sums_over_few_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 5, -2])) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    for inclusive in (True, False):
        want, held = {}, {}
        for k, i, v in sorted(rows, key=lambda r: r[1]):
            before = held.get(k, 0)
            held[k] = before + (v or 0)
            want[k, i] = held[k] if inclusive else before
        got = {(r.k, r.i): r.s for r in scans.running_sum(df, ["k"], [F.col("i")], F.col("v"), "s", inclusive).collect()}
        assert got == want


def plain_path(links, start, end):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    if start not in near or end not in near:
        return []
    paths = [[start]]
    seen = {start}
    while paths:
        done = sorted(p for p in paths if p[-1] == end)
        if done:
            return done[0]
        paths = [p + [n] for p in paths for n in near[p[-1]] if n not in seen]
        seen |= {p[-1] for p in paths}
    return []


def test_path_between(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(9)] + [(20, 21)]
    mesh = [(rng.randrange(14), rng.randrange(14)) for _ in range(20)] + [(None, 1)]
    for links, ends in ((chain, [(0, 9), (9, 2), (0, 20), (3, 3), (0, 99)]), (mesh, [(0, 13), (5, 2)])):
        df = spark.createDataFrame(links, "a long, b long")
        for start, end in ends:
            got = [r.node for r in graphs.path_between(df, start, end).orderBy("place").collect()]
            assert got == plain_path([e for e in links if None not in e], start, end), (start, end)


def test_change_log(spark):
    rows = [
        ("s", 1, "insert", "r", "t", 2, 10, None, None), ("s", 2, "merge", "r", "t", 3, 11, None, None), ("s", 3, "supersede", "r", "t", None, 20, None, "u"), ("s", 4, "supersede", "r", "t", 1, 21, None, None),
        ("s", 5, "merge", "r", "t", 1, 22, None, None), ("s", 6, "supersede", "r", "u", 9, 30, "q", None), ("s", 7, "merge", "x", "y", 1, 31, None, None), ("s", 8, "insert", "n", "t", 1, None, None, None),
        ("s", 9, "supersede", "n", "t", 1, 40, None, None), ("s", 10, "insert", "r", "t", 7, 50, None, None), ("s", 11, "what", "r", "t", 7, 50, None, None), (None, 1, "insert", "r", "t", 1, 5, None, None),
    ]
    df = spark.createDataFrame(rows, "source string, position long, op string, relation string, target string, weight long, at long, new_relation string, new_target string")
    edges, events = changes.applied(df)
    got = sorted(((r.source, r.relation, r.target, r.position, r.weight, r.valid_at, r.invalid_at, r.superseded_by) for r in edges.collect() if r.source), key=str)
    assert got == [("s", "n", "t", 8, 1, None, None, None), ("s", "q", "u", 6, 9, 30, None, None), ("s", "r", "t", 1, 5, 10, 20, "s|r|u"), ("s", "r", "t", 10, 7, 50, None, None), ("s", "r", "u", 3, 5, 20, 30, "s|q|u")]
    told = [(r.position, r.target, r.event) for r in events.where("source = 's'").orderBy("position", F.desc("event")).collect()]
    assert told == [
        (1, "t", "insert"), (2, "t", "merge"), (3, "t", "supersede"), (3, "u", "insert"), (4, "t", "refused: superseded"), (5, "t", "refused: superseded"), (6, "u", "supersede"), (6, "u", "insert"),
        (7, "y", "refused: missing"), (8, "t", "insert"), (9, "t", "refused: undated"), (10, "t", "insert"), (11, "t", "refused: unknown"),
    ]


def test_lanes(spark):
    rows = [(1, 1, 0, 10), (1, 2, 1, 3), (1, 3, 3, 5), (1, 4, 4, 6), (1, 5, 10, 11), (2, 1, 0, 1)]
    df = spark.createDataFrame(rows, "k long, i long, a long, b long")
    got = {(r.k, r.i): r.lane for r in sequences.assigned_lanes(df, "k", "i", "a", "b").collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 2, (1, 5): 0, (2, 1): 0}


def test_robust_centroids(spark):
    rows = [("a", [2.0, 0.0], 1), ("a", [1.0, 0.1], 1), ("a", [0.0, -9.0], 50), ("a", None, 3), ("a", [0.0, 0.0], 3), ("b", [1.0, 0.0], 3), ("b", [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "k string, v array<double>, s int")
    got = {r.k: r for r in retrieval.robust_centroids(df, "k", "s", 0.7, "v").collect()}
    assert (got["a"].members, got["a"].dropped, got["a"].seconds) == (2, 1, 2) and got["a"].centroid[0] > 0.99  # the long one has one vote
    assert (got["b"].members, got["b"].dropped) == (2, 0) and round(got["b"].centroid[0] / got["b"].centroid[1], 6) == 3


def test_long_chains_are_no_circles(spark):
    tags = spark.createDataFrame([(f"t{i}",) for i in range(23)], "tag string")
    needs = spark.createDataFrame([(f"t{i + 1}", f"t{i}") for i in range(22)], "tag string, on string")
    assert {r.tag: r.depth for r in upkeep.dependency_order(tags, needs).collect()} == {f"t{i}": i for i in range(23)}


def test_substrings(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab日 ") for _ in range(rng.randint(0, 9))) for _ in range(120)] + [None]
    a, b = texts[:60], texts[40:]
    got = {tuple(r) for r in substrings.contained(spark.createDataFrame([(x,) for x in a], "x string"), spark.createDataFrame([(x,) for x in b], "y string")).collect()}
    assert got == {(x, y) for x in a for y in b if x and y and x in y}


def test_graph_channel_ranks_by_relations(spark):
    asked = spark.createDataFrame([("q", "ring"), ("q", "the gold ring of"), ("none", "zzz"), ("q", None)], "query string, keyword string")
    edges = spark.createDataFrame([("gold ring", "shop", "r"), ("gold ring", "shop", "s"), ("ring", "bank", "r")], "source string, target string, relation string")
    sources = spark.createDataFrame([("gold ring", 1), ("ring", 2), ("shop", 3), ("shop", 1), ("bank", 4), ("lone", 5)], "name string, chunk long")
    got = {(r["query"], r.chunk): r.score for r in retrieval.graph_channel(asked, sources, edges).collect()}
    assert got == {("q", 1): 1.0, ("q", 2): 0.5, ("q", 3): 0.5, ("q", 4): 0.25}


@pytest.mark.parametrize("chunks", [1, 2, 5])
def test_graph_channel_keeps_the_best_chunks(spark, chunks):
    rng = random.Random(chunks)
    names = [f"part {i}" for i in range(12)]
    edges = spark.createDataFrame([(rng.choice(names), rng.choice(names), rng.choice("rs")) for _ in range(30)], "source string, target string, relation string").distinct()
    sources = spark.createDataFrame([(rng.choice(names), rng.randint(0, 30)) for _ in range(80)], "name string, chunk long")
    asked = spark.createDataFrame([(f"q{i}", rng.choice([*names, "1", "part"])) for i in range(15)], "query string, keyword string")
    want = {}
    for r in retrieval.graph_channel(asked, sources, edges).collect():
        want.setdefault(r["query"], []).append((-r.score, r.chunk))
    got = {}
    for r in retrieval.graph_channel(asked, sources, edges, chunks=chunks).collect():
        got.setdefault(r["query"], []).append((-r.score, r.chunk))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v)[:chunks] for q, v in want.items()} and want


def test_written_steps_can_be_removed(spark):
    import os

    from colloquy.session import _shared, remove_settled, settled

    assert settled(spark.range(3), "three").count() == 3
    folder = _shared(spark).removeprefix("file://")
    assert os.path.isdir(folder)
    remove_settled(spark)
    assert not os.path.exists(folder)
    remove_settled(spark)
