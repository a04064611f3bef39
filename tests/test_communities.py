"""Communities by modularity against a plain greedy merger on small graphs."""

import random

import pytest

from colloquy.operators import communities

#: A friendship graph of 34 people, well known from the literature.
CLUB = "1-2 1-3 2-3 1-4 2-4 3-4 1-5 1-6 1-7 5-7 6-7 1-8 2-8 3-8 4-8 1-9 3-9 3-10 1-11 5-11 6-11 1-12 1-13 4-13 1-14 2-14 3-14 4-14 6-17 7-17 1-18 2-18 1-20 2-20 1-22 2-22 24-26 25-26 3-28 24-28 25-28 3-29 24-30 27-30 2-31 9-31 1-32 25-32 26-32 29-32 3-33 9-33 15-33 16-33 19-33 21-33 23-33 24-33 30-33 31-33 32-33 9-34 10-34 14-34 15-34 16-34 19-34 20-34 21-34 23-34 24-34 27-34 28-34 29-34 30-34 31-34 32-34 33-34"


def quality(edges, of):
    m = sum(w for _, _, w in edges)
    inner, total = {}, {}
    for a, b, w in edges:
        for x in (a, b):
            total[of[x]] = total.get(of[x], 0) + w
        if of[a] == of[b]:
            inner[of[a]] = inner.get(of[a], 0) + w
    return sum(inner.get(c, 0) / m - (t / (2 * m)) ** 2 for c, t in total.items())


def greedy(edges):
    """Merge the two communities that gain most until none gains."""
    of = {x: x for a, b, _ in edges for x in (a, b)}
    best = quality(edges, of)
    while True:
        found = None
        for x, y in {tuple(sorted((of[a], of[b]))) for a, b, _ in edges if of[a] != of[b]}:
            q = quality(edges, {n: x if c == y else c for n, c in of.items()})
            if q > best + 1e-12 and (found is None or q > found[0]):
                found = q, x, y
        if not found:
            return best
        best, x, y = found
        of = {n: x if c == y else c for n, c in of.items()}


def connected(edges, group):
    seen, todo = set(), [min(group)]
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += near[x] & group
    return seen == group


def graphs():
    rng = random.Random(3)
    yield [(int(a), int(b), 1.0) for a, b in (e.split("-") for e in CLUB.split())]
    planted = {}
    for a in range(48):
        for b in range(a):
            if rng.random() < (0.6 if a // 8 == b // 8 else 0.04):
                planted[b, a] = float(rng.randint(1, 4))
    yield [(a, b, w) for (a, b), w in planted.items()]
    yield [(i, i + 1, 1.0) for i in range(30)] + [(0, 30, 1.0), (7, 7, 3.0)]


@pytest.mark.parametrize("number", range(3))
def test_no_worse_than_greedy(spark, number):
    edges = list(graphs())[number]
    df = communities.collapsed(spark.createDataFrame(edges, "a long, b long, w double"), weight="w")
    found, qualities = communities.leiden(df)
    last = len(qualities) - 1
    rows = found.collect()
    of = {r.node: r.community for r in rows if r.level == last}
    assert set(of) == {x for a, b, _ in edges for x in (a, b)}
    assert abs(quality(edges, of) - qualities[-1]) < 1e-9 and all(x <= y + 1e-9 for x, y in zip(qualities, qualities[1:]))
    assert qualities[-1] >= greedy(edges) - 1e-9
    assert communities.weighted_modularity(df, found.where(f"level = {last}")).first().q == round(qualities[-1], 6)
    for c in set(of.values()):
        group = {n for n, x in of.items() if x == c}
        assert min(group) == c and connected(edges, group)
    if number == 0:
        again = communities.partition(df).collect()
        assert {(r.node, r.community) for r in again} == set(of.items())


def test_weights_and_empty(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (2, 1, 2.0), (3, 3, 1.0), (None, 4, 1.0), (5, 6, None), (1, 7, -1.0)], "a long, b long, w double")
    assert sorted(tuple(r) for r in communities.collapsed(df, weight="w").collect()) == [(1, 2, 3.0), (3, 3, 1.0)]
    assert communities.partition(communities.collapsed(df.limit(0), weight="w")).collect() == []


def test_steps_keep_links_before_they_are_made_distinct(spark, capsys):
    """A small frontier is joined below the links' DISTINCT, so only what it touches is dealt."""
    from colloquy.operators import graphs

    spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 4), (9, 8)], "x long, y long").createOrReplaceTempView("raw_links")
    links = spark.sql("SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM raw_links")
    front = graphs.settled(spark.createDataFrame([(2,)], "node long"), "frontier")
    step = graphs.stepped(links, front)
    step.explain()
    plan = capsys.readouterr().out.split("Initial Plan")[-1]
    sides = plan.split("Union")[1]
    assert plan.count("LeftSemi") >= 2 and sides.index("HashAggregate") < sides.index("LeftSemi")
    assert sorted(r.node for r in step.collect()) == [1, 3]
    assert sorted(map(tuple, graphs.neighbours(links, front, 2).collect())) == [(1, 1), (2, 0), (3, 1), (4, 2)]


def test_paths_join_links_by_semi_joins(spark):
    """Links from a front, in both directions; loops and links without an end lead nowhere new."""
    from colloquy.operators import graphs, upkeep

    links = spark.createDataFrame([(1, 2), (3, 2), (2, 2), (3, 4), (None, 1), (9, 8)], "a long, b long")
    front = spark.createDataFrame([(2,)], "node long")
    assert sorted(map(tuple, graphs.touching(links.where("a <> b"), front).collect())) == [(2, 1), (2, 3)]
    assert {r.node: r.path for r in upkeep.paths(links.where("a is not null"), 1, 3).collect()} == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 2, 3, 4]}
    assert [r.node for r in graphs.path_between(links, 1, 4).orderBy("place").collect()] == [1, 2, 3, 4]
    assert graphs.path_between(links, 1, 9).count() == 0 and graphs.path_between(links, 1, None).count() == 0


def test_a_round_deals_edges_once(spark, capsys):
    """Edges are kept by one end and dealt by the other; scores are those of plain sums, a node without other ends stays."""
    edges = communities.collapsed(spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (1, 3, 1.0), (3, 4, 1.0), (9, 9, 3.0)], "a long, b long, w double"), weight="w")
    both = communities._dealt(communities._both(edges), 3)
    labels = communities._nodes(edges, both).withColumn("community", communities.F.when(communities.F.col("node") == 2, 3).otherwise(communities.F.col("node"))).withColumn("coarse", communities.F.col("node"))
    scored = communities._scored(both, 3, labels, 16.0)
    rows = {r.node: r for r in scored.collect()}
    capsys.readouterr()
    scored.explain()
    plan = capsys.readouterr().out.split("Initial Plan")[-1]
    both.unpersist()
    assert plan.count("Exchange hashpartitioning") <= 4  # three of a round, one of the kept edges
    assert (rows[1].target, rows[1].own) == (3, 0.0) and abs(rows[1].gain - (2.0 - 2.0 * 7.0 / 16)) < 1e-9
    assert (rows[2].own, rows[2].target, rows[2].alone) == (2.0, 1, False) and abs(rows[2].own_value - (2.0 - 3.0 * 4.0 / 16)) < 1e-9
    assert rows[9].target is None and rows[9].gain == 0.0 and rows[9].alone and rows[9].loop == 3.0
