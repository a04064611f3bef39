"""Contracts of single operators on small made-up rows."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as fn
from colloquy.operators import graphs, retrieval, scores, sequences, tabular, tagging
from colloquy.sources import parsers
from colloquy.streaming import sessions


def test_null_valid_at_is_always_visible(spark):
    e = spark.createDataFrame([(1, None, 5, 3), (2, 10, None, None), (3, 10, 15, None), (4, 10, None, 1)], "edge_id int, valid_at int, invalid_at int, expired_at int")
    assert sorted(r.edge_id for r in graphs.as_of(e, 20).collect()) == [1, 2]
    assert sorted(r.edge_id for r in graphs.as_of(e, 20, include_soft=True).collect()) == [1, 2, 4]


def test_greedy_packs(spark):
    s = spark.createDataFrame([(1, i, n) for i, n in enumerate([30, 30, 10, 0, 70, 5])], "recording_id int, idx int, tokens int")
    got = {r.idx: r.pack for r in sequences.packed(s, 60).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 4: 2, 5: 3}


def test_frames(spark):
    rows = [("a", i, q) for i, q in enumerate([1, 2, 2, 9, 3, 3, 10])]
    f = spark.createDataFrame(rows, "session_id string, arrival long, seq long")
    got = [r.event for r in sequences.accepted_frames(f).orderBy("arrival").collect()]
    assert got == ["ok", "ok", "duplicate", "vad_reset", "out_of_order", "out_of_order", "ok"]


def test_streamed_frames_tell_the_same(spark, tmp_path):
    rows = [("a", i, q) for i, q in enumerate([1, 2, 2, 9, 3, 3, 10])] + [("b", 1, 5)]
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.createDataFrame(rows, "session_id string, arrival long, seq long").write.parquet(src)
    stream = spark.readStream.schema("session_id string, arrival long, seq long").parquet(src)
    q = sessions.frame_events(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out).where("session_id = 'a'").orderBy("arrival").collect()
    assert [r.event for r in got] == ["ok", "ok", "duplicate", "vad_reset", "out_of_order", "out_of_order", "ok"]


def test_streamed_windows(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 60) as ts, 'x' as event_type from range(20)").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(src)
    q = sessions.monitoring_windows(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.read.parquet(out).orderBy("start").collect()] == [5, 5, 5]


def test_merge_strategies(spark):
    rows = [("rules", 10, False, 1, "l", "pass", 1), ("model", 20, False, 1, "l", "fail", 2), ("review", 5, True, 1, "l", "pass", 3), ("rules", 10, False, 1, "k", "a", 4)]
    a = spark.createDataFrame(rows, "group_key string, priority int, is_manual boolean, target_id int, label_key string, value string, assignment_id int")
    got = {r.label_key: r for r in tagging.merged(tagging.cells(a), ["rules", "model", "review"]).collect()}
    assert (got["l"]["all"], got["l"].agreed, got["l"].by_priority, got["l"].manual_wins) == ("fail,pass", "", "fail", "pass")
    m = {r.label_key: r for r in tagging.matrix(tagging.cells(a), ["rules", "model", "review"]).collect()}
    assert m["k"].missing and not m["k"].conflict and m["l"].conflict


def test_drift_bounds(spark):
    rows = [("t", "a", "l")] * 40 + [("t", "b", "r")] * 40 + [("u", "a", "l")] * 40 + [("u", "a", "r")] * 40
    d = spark.createDataFrame(rows, "tag string, b string, side string")
    jsd = {r.tag: (r.jsd, r.breach) for r in scores.jensen_shannon(d, ["tag"], "b", "side", "l", "r").collect()}
    assert jsd == {"t": (1.0, True), "u": (0.0, False)}
    psi = {r.tag: r.psi for r in scores.psi(d, ["tag"], "b", "side", "l", "r").collect()}
    assert psi["u"] == 0 and psi["t"] > 0.2


def test_neighbours_and_paths(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6)], "a long, b long")
    got = {r.node: r.length for r in graphs.shortest_paths(links, 1, 3).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}


def test_transition_labels(spark):
    rows = [(None, 0, "start"), (0, 0, "stay"), (0, 1, "advance"), (0, 2, "jump"), (2, 1, "backtrack"), (1, None, "change")]
    df = spark.createDataFrame(rows, "b int, n int, want string")
    assert all(r.want == r.got for r in df.select("want", sequences.transition_label(F.col("b"), F.col("n")).alias("got")).collect())


def test_texts(spark):
    df = spark.createDataFrame([("mail a.b@x.org, 192.168.0.1 or 138-1234-5678", '["a", " b ", "", "a"]'), ("你好", "broken")], "t string, j string")
    a, b = df.select(fn.scrubbed(F.col("t")).alias("s"), fn.members(F.col("j")).alias("m"), fn.token_estimate(F.col("t")).alias("n"), fn.language(F.col("t")).alias("l")).collect()
    assert a.s == "mail a.***@x.org, 192.168.**.** or 138-1234-5678" and a.m == ["a", "b"] and b.m == [] and b.n == 2 and (a.l, b.l) == ("en", "zh-CN")
    assert fn.likeness("kitten", "sitting") == pytest.approx(200 * 4 / 13) and fn.likeness("", "a") == 0


def test_canonical_checksum(spark):
    df = spark.createDataFrame([('{"b": 1.0, "a": [2]}',), ('{"a":[2],"b":1}',), (None,)], "j string")
    x, y, z = [r[0] for r in df.select(fn.canonical_checksum("j")).collect()]
    assert x == y and z is None


def test_parsers(spark):
    lines = spark.createDataFrame([("SPEAKER f 1 1.5 2.0 <NA> <NA> s1 <NA>",), ("SPKR-INFO f",), ("SPEAKER f 1 x y a b c d",)], "value string")
    assert [tuple(r) for r in parsers.rttm(lines).collect()] == [("f", "s1", 1.5, 3.5)]
    out = spark.createDataFrame([(1, '("entity"<|>"A"<|>"t"<|>"d")##("relationship"<|>"A"<|>"B"<|>"r"<|>2)##junk<|COMPLETE|>')], "k int, o string")
    e, r = parsers.extraction(out, "k", "o")
    assert [tuple(x) for x in e.collect()] == [(1, "A", "t", "d")] and [tuple(x) for x in r.collect()] == [(1, "A", "B", "r", 2.0)]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(retrieval.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None]


def test_pair_rules(spark):
    cols = "recording_id int, ended_sec int, agent_id int, customer int, right_recording_id int, right_started_sec int, right_agent_id int, right_customer int"
    rows = [(1, 100, 1, 7, 2, 150, 1, 7), (3, 100, 1, 7, 4, 150, 1, 8), (5, 100, 1, None, 6, 90, 1, 8), (7, 100, 1, None, 8, 150, 2, 8)]
    got = {r.recording_id: r.verdict for r in tabular.evaluate_pairs(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: "merge", 3: "reject", 5: "needs_review", 7: "needs_review"}


def test_visits_never_mix_customers(spark):
    from colloquy.operators import receptions

    cols = "tenant_id string, store_id long, agent_id long, recording_id long, started_sec long, ended_sec long, customer long"
    rec = spark.createDataFrame([("t", 1, 1, i, i * 100, i * 100 + 50, c) for i, c in enumerate([7, None, 8, 7, None])], cols)
    pairs = spark.createDataFrame([(0, 1, "merge"), (1, 2, "merge"), (2, 3, "reject"), (3, 4, "merge")], "recording_id long, right_recording_id long, verdict string")
    got = {r.recording_id: r.visit for r in receptions.grouped(rec, pairs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}


def test_diarization_error(spark):
    from colloquy.operators import receptions

    cols = "recording_id long, speaker string, start_sec long, end_sec long"
    ref = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 10, 20)], cols)
    hyp = spark.createDataFrame([(1, "x", 0, 12), (1, "y", 12, 18)], cols)
    r = receptions.error_rate(ref, hyp, collar=0.0).first()
    assert (r.missed, r.false_alarm, r.confused, r.rate) == (199, 0, 201, 0.2)


def frames_of(spans, n, wide):
    out = {}
    for who, a, b in spans:
        first, last = int(max(0.0, a - wide) / 0.01), int(min(n * 0.01, b + wide) / 0.01)
        out.setdefault(who, set()).update(range(first, min(last, n - 1) + 1))
    return out


def test_diarization_error_against_single_frames():
    import itertools
    import math
    import random

    from colloquy.operators import receptions

    rng = random.Random(3)
    for _ in range(40):
        some = lambda names: [(rng.choice(names), a := rng.randint(0, 80) / 4, a + rng.randint(1, 20) / 4) for _ in range(rng.randint(1, 8))]
        ref, hyp = some("abc"), some("xyzw")
        common = {(r, h): 0.0 for r in sorted({x[0] for x in ref}) for h in sorted({x[0] for x in hyp})}
        merged = lambda spans, who: {i for s, a, b in spans if s == who for i in range(int(a * 4), int(b * 4))}
        for r, h in common:
            common[r, h] = len(merged(ref, r) & merged(hyp, h))
        of = {}
        for (r, h), _ in sorted(common.items(), key=lambda x: (-x[1], x[0])):
            if r not in of.values() and h not in of:
                of[h] = r
        n = math.ceil(max(x[2] for x in ref + hyp) / 0.01)
        rf, hf = frames_of(ref, n, 0.25), frames_of(hyp, n, 0.0)
        want = [0, 0, 0, 0]
        for f in range(n):
            r, h = {w for w, s in rf.items() if f in s}, {of.get(w, "~" + w) for w, s in hf.items() if f in s}
            want[0] += bool(r and not h)
            want[1] += bool(h and not r)
            want[2] += bool(r and h and r != h)
            want[3] += bool(r)
        assert receptions.frame_errors(ref, hyp) == tuple(want)
    assert list(itertools.islice(receptions._sweep([]), 1)) == []


def test_visits_keep_splits_and_names(spark):
    from colloquy.operators import receptions

    cols = "tenant_id string, store_id long, agent_id long, recording_id long, started_sec long, ended_sec long, customer long, explicit string"
    rec = spark.createDataFrame([("t", 1, 1, i, i * 100, i * 100 + 50, None, e) for i, e in enumerate([None, None, None, "x", None, "x"])], cols)
    pairs = spark.createDataFrame([(i, i + 1, "merge") for i in range(3)], "recording_id long, right_recording_id long, verdict string")
    splits = spark.createDataFrame([(2, 0)], "a long, b long")
    got = {r.recording_id: r.visit for r in receptions.grouped(rec, pairs, splits).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 2}


@pytest.mark.parametrize(
    "text, masked",
    [
        ("x13812345678", "x138****5678"), ("010-12345678", "010****5678"), ("0755-1234567", "075****4567"), ("138-1234-5678", "138-1234-5678"), ("11010119900307391X", "11*************91X"),
        ("440106198201154318", "44**********18"), ("6225880212345678901", "62***************1"), ("622588021234567", "622588021234567"), ("999.999.1.1", "999.999.1.1"), ("10.1.2.3", "10.1.**.**"), ("a@b.org", "a***@b.org"), ("", ""), (None, None),
    ],
)
def test_masks(spark, text, masked):
    got = spark.createDataFrame([(text,)], "t string").select(fn.scrubbed(F.col("t")), F.size(fn.redactions(F.col("t")))).first()
    assert got[0] == masked and (text is None or (got[1] > 0) == (text != masked))


def test_languages_bytes_and_identifiers(spark):
    df = spark.createDataFrame([("café",), ("a日",), ("привет",), ("12",), ("é" * 200,), ("order no: AB-12, X9, m@x.org",)], "t string")
    rows = df.select(fn.language(F.col("t")).alias("l"), fn.cut_bytes(F.col("t")).alias("c"), fn.protected_identifiers(F.col("t")).alias("p")).collect()
    assert [r.l for r in rows] == ["en", "zh-CN", "und", "und", "en", "en"]
    assert rows[4].c == "é" * 128 and rows[5].p == ["AB-12", "X9", "m@x.org"]


def test_names_alike_against_all_pairs(spark):
    import random

    from colloquy.functions import likeness
    from colloquy.operators import matching

    rng = random.Random(2)
    names = sorted({("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))), rng.choice(["p", "q"])) for _ in range(150)})
    want = {}
    for n, t in names:
        for c, u in names:
            if n != c and t == u and (score := likeness.weighted_ratio(n, c)) >= 85:
                want[n, t] = max(want.get((n, t), (0, "")), (score, c))
    df = spark.createDataFrame(names, "name string, type string")
    assert {(r.name, r.type): (r.score, r.canonical) for r in matching.names_alike(df, df).collect()} == want and want


def test_nearest_baseline_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.randint(0, 3), rng.randint(0, 2), i, rng.randint(0, 30), rng.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, job int, id long, at long, base boolean")
    got = {r.candidate_id: r.baseline_id for r in tabular.nearest_baseline(df.where("not base"), df.where("base"), ["k"]).collect()}
    want = {c[2]: min((b for b in rows if b[4] and b[0] == c[0]), key=lambda b: (b[1] != c[1], abs(b[3] - c[3]), -b[2]))[2] for c in rows if not c[4]}
    assert got == want


def test_speaker_verdicts(spark):
    from colloquy.operators import matching

    rows = [("a", 1, 0.9, 0.8), ("a", 2, 0.7, 0.9), ("b", 1, 0.9, 0.1), ("c", 1, 0.9, None), ("d", 3, 0.75, 0.9), ("d", 1, 0.75, None), ("e", 1, 0.1, 1.0)]
    got = {r["query"]: (r.candidate, r.verdict, r.reconfirm) for r in matching.speaker_verdicts(spark.createDataFrame(rows, "query string, candidate long, score double, cosine double")).collect()}
    assert got == {"a": (1, "CONFIRMED", False), "b": (1, "AMBIGUOUS", True), "c": (1, "AMBIGUOUS", True), "d": (1, "INFERRED", False), "e": (None, "NO_MATCH", False)}


def plain_equal_error(same, diff, max_far):
    """Every threshold in order, the best one carried along, as the rule is stated."""
    import math

    points = [(t, sum(x >= t for x in diff) / len(diff), sum(x < t for x in same) / len(same)) for t in [math.inf, *sorted({*same, *diff}, reverse=True), -math.inf]]
    best = (math.inf, None, 0.0, 0.0)
    for t, far, frr in points:
        gap, mean = abs(far - frr), (far + frr) / 2
        if gap < best[0] - mean or (abs(gap - (best[0] - mean)) < 1e-12 and mean < best[0]):
            best = (mean, t, far, frr)
    ties = [(a, r) for _, a, r in points if abs(abs(a - r) - abs(best[2] - best[3])) < 1e-9]
    far, frr = sum(a for a, _ in ties) / len(ties), sum(r for _, r in ties) / len(ties)
    strict = [t for t, a, _ in points[1:-1] if a <= max_far]
    return (far + frr) / 2, best[1] if math.isfinite(best[1]) else None, far, frr, min(strict) if strict and 0 <= min(strict) <= 1 else None


@pytest.mark.parametrize("shift", [0.0, 0.2, 0.9])
def test_equal_error_against_every_threshold(spark, shift):
    import random

    from colloquy.operators import evaluations

    rng = random.Random(9)
    same = [round(min(1.0, rng.random() * 0.6 + shift), 2) for _ in range(150)]
    diff = [round(rng.random() * 0.7, 2) for _ in range(170)]
    df = spark.createDataFrame([(x, True) for x in same] + [(x, False) for x in diff], "score double, same boolean")
    got = evaluations.equal_error(df, "score", "same", 0.05).first()
    assert tuple(got) == pytest.approx(plain_equal_error(same, diff, 0.05))
    assert evaluations.equal_error(df.where("same"), "score", "same").count() == 0


def test_bootstrap_draws_by_digits(spark):
    """A chance and the bounds it is compared with, at the bounds themselves."""
    import math

    from colloquy.operators import evaluations

    edges = [math.ceil(c * 2**32) for c in evaluations.DRAWN]
    chances = sorted({x for c in edges for x in (c - 1, c, c + 1) if 0 <= x < 2**32} | {0, 2**32 - 1})
    df = spark.createDataFrame([(x, f"{x:08x}") for x in chances], "x long, h string")
    got = {r.x: r.n for r in df.select("x", evaluations._times(F.col("h")).alias("n")).collect()}
    assert got == {x: sum(x / 2**32 >= c for c in evaluations.DRAWN) for x in chances}


def test_bootstrap_bound(spark):
    import hashlib

    from colloquy.operators import evaluations

    values, rounds = [0.1, -0.2, 0.3, 0.05, 0.4], 100
    means = []
    for r in range(rounds):
        n = total = 0
        for i, v in enumerate(values):
            digest = hashlib.md5(f"{0xA6D10}|{r // 4}|{i}".encode()).hexdigest()  # noqa: S324
            chance = int(digest[r % 4 * 8 : r % 4 * 8 + 8], 16) / 2**32
            times = sum(chance >= c for c in evaluations.DRAWN)
            n, total = n + times, total + times * round(v * 10**6)
        means += [total / n / 10**6] if n else []
    want = sorted(means)[len(means) // 20 - 1]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", 0, 7.0), ("b", 1, None)], "k string, i long, v double")
    assert {r.k: r.bound for r in evaluations.bootstrap_bound(df, "k", "i", "v", rounds).collect()} == {"a": want, "b": 7.0}
    assert -0.2 < want < sum(values) / 5


def test_prompt_batches_cut_long_texts(spark):
    from colloquy.operators import upkeep

    df = spark.createDataFrame([(1, 0, "a" * 4), (1, 1, "b" * 5), (1, 2, ""), (1, 3, "c" * 23), (1, 4, "d")], "k long, i long, t string")
    got = sorted(tuple(r) for r in upkeep.prompt_batches(df, "k", "i", "t", 10).collect())
    assert got == [(1, 0, 0, 0, 4), (1, 0, 1, 0, 5), (1, 1, 3, 0, 10), (1, 2, 3, 10, 20), (1, 3, 3, 20, 23), (1, 3, 4, 0, 1)]
    with pytest.raises(ValueError):
        upkeep.prompt_batches(df, "k", "i", "t", 0)


def test_circles_are_told(spark):
    from colloquy.operators import upkeep

    tags = spark.createDataFrame([("a",), ("b",)], "tag string")
    with pytest.raises(ValueError):
        upkeep.dependency_order(tags, spark.createDataFrame([("a", "b"), ("b", "a")], "tag string, on string"))


def test_gold_documents(spark):
    rows = ['[{"query": "q1", "gold_context_ids": ["1", "2"]}, {"gold_answer": "none"}]', '{"query": "q2"}', "{broken", None]
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    assert sorted((r["query"], len(r.gold_context_ids or [])) for r in parsers.gold_examples(df).collect()) == [("q1", 2), ("q2", 0)]
    seg = '{{"case_id": "{}", "scenario": "s", "segments": [{{"segment_id": "a", "start_sec": 0, "end_sec": 1, "transcript": ""}}, {{"segment_id": "{}", "start_sec": 1, "end_sec": 2}}], "boundary_after_segment_ids": ["{}"]}}'
    df = spark.createDataFrame([(seg.format("ok", "b", "a"),), (seg.format("twice", "a", "a"),), (seg.format("unknown", "b", "z"),)], "value string")
    assert [(r.case_id, r.segment_id, r.boundary) for r in parsers.dialogue_gold(df).orderBy("segment_id").collect()] == [("ok", "a", True), ("ok", "b", False)]


def streamed(spark, tmp_path, make, rows, schema, parts):
    """The rows of a streamed operator over files that come one after another, and one more row at the end that lets all others end."""
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for i, part in enumerate(parts):
        spark.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.mode("append").parquet(f"{src}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).collect()


def test_streamed_chunks(spark, tmp_path):
    import datetime

    from colloquy.streaming import incremental

    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [(1, i, n, at(0)) for i, n in enumerate([30, 30, 10, 0, 70, 5])] + [(2, 0, 7, at(60)), (1, 4, 70, at(70)), (1, 6, 9, at(70)), (2, 1, 1, at(180)), (2, 2, 1, at(300))]
    schema = "recording_id long, idx long, tokens long, ts timestamp"
    got = [(r.chunk, r.first, r.last, r.tokens) for r in streamed(spark, tmp_path, lambda s: incremental.chunks(s, 60), rows, schema, [[0, 1, 2], [1, 3, 4, 5], [6], [7, 8], [9], [10]]) if r.recording_id == 1]
    assert sorted(got) == [(0, 0, 1, 60), (1, 2, 2, 10), (2, 4, 4, 70), (3, 5, 5, 5), (4, 6, 6, 9)]


def test_graph_kept_from_a_stream(spark, tmp_path):
    from colloquy.streaming import incremental

    schema = "source string, target string, relation string, weight long, rank long"
    for i in range(3):
        spark.createDataFrame([("a", "b", "r", 1, i), ("a", f"x{i}", "r", 2, 0)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    incremental.keep_graph(stream, str(tmp_path / "graph"), str(tmp_path / "cp")).awaitTermination()
    got = {r.target: (r.weight, r["rank"]) for r in incremental.current_graph(spark, str(tmp_path / "graph"), 2).collect()}
    assert got == {"b": (3, 2), "x0": (2, 0), "x1": (2, 0), "x2": (2, 0)}


def test_neighbours_in_cells_against_one_order(spark):
    import random

    rng = random.Random(5)
    rows = [("t", rng.randint(0, 1), i, s := rng.randint(-500, 3000), s + rng.randint(1, 200), None, None) for i in range(150)]
    df = spark.createDataFrame(rows, "tenant_id string, store_id long, recording_id long, started_sec long, ended_sec long, agent_id long, customer long")
    want, crowded = set(), set()
    for store in (0, 1):
        mine = sorted((r for r in rows if r[1] == store), key=lambda r: (r[3], r[2]))
        for i, r in enumerate(mine):
            want |= {(r[2], x[2]) for x in mine[i + 1 : i + 4] if x[3] - r[4] <= 60}
            if i + 3 < len(mine) and mine[i + 3][3] - r[4] <= 60:
                crowded.add(r[2])
    assert {(r.recording_id, r.right_recording_id) for r in tabular.neighbour_pairs(df, 60, 3).collect()} == want
    assert {r.recording_id for r in tabular.crowded_windows(df, 60, 2).collect()} == crowded and crowded


def test_nearest_centres_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    c = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(7)], "label long, centroid array<double>")
    want = {i: i % 7 for i in range(30)}
    for most in (5_000, 2):
        monkeypatch.setattr(retrieval, "CENTRES", most)
        assert {r.vec_id: r.nearest for r in retrieval.nearest(v, c, "label").collect()} == want


def test_mixed_tokens(spark):
    got = spark.createDataFrame([("Ab 数据库 c",)], "t string").select(retrieval.mixed_tokens(F.col("t"))).first()[0]
    assert sorted(got) == sorted(["ab", "数据库", "c", "数据", "据库", "a", "b"])


def test_local_search_starts_without_links(spark, tmp_path):
    """The seeds are given, not read from the links: without links they are all that is found, as in the SQL."""
    from colloquy.plans.registry import QUERIES

    for name in ("lineitem", "part"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        rows.limit(0 if name == "lineitem" else 5).write.parquet(f"{tmp_path}/{name}.parquet")
    assert sorted(map(tuple, QUERIES["gr10_local_search"](spark, str(tmp_path)).collect())) == [(7, 0.5), (9, 0.5)]


def _plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out.split("Initial Plan")[-1]


def test_next_recordings_come_without_a_join(spark, capsys):
    df = spark.createDataFrame([("t", 1, 1, 0, 10, 1, 1), ("t", 1, 2, 20, 30, 1, 1), (None, 1, 3, 0, 10, 1, 1), (None, 1, 4, 20, 30, 1, 1)], "tenant_id string, store_id long, recording_id long, started_sec long, ended_sec long, agent_id long, customer long")
    pairs = tabular.neighbour_pairs(df, 60, 3)
    plan = _plan(pairs, capsys)
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert [(r.recording_id, r.right_recording_id, r.right_started_sec) for r in pairs.collect()] == [(1, 2, 20)]
    assert [tuple(r) for r in tabular.evaluate_pairs(pairs, keep=("started_sec",)).select("verdict", "right_started_sec").collect()] == [("merge", 20)]


def test_baselines_are_dealt_once(spark, capsys, monkeypatch):
    monkeypatch.setattr(tabular, "TASK_ROWS", 4, raising=False)
    df = spark.range(10).selectExpr("id % 2 as k", "id % 3 as job", "id", "id * 7 % 5 as at")
    assert _plan(tabular.nearest_baseline(df.where("id < 5"), df.where("id >= 5"), ["k"]), capsys).count("Exchange ") == 1


def test_proposals_fold_visits_once(spark, capsys):
    from colloquy.plans.registry import QUERIES

    assert "MapInArrow" not in _plan(QUERIES["rec13_proposals"](spark, "/root/testdata/sf0.001"), capsys)


def test_bootstrap_query_draws_all_rounds_in_many_tasks(spark, monkeypatch):
    from colloquy.operators import evaluations
    from colloquy.plans.registry import ORACLES, QUERIES

    asked, plain = [], evaluations.bootstrap_bound
    monkeypatch.setattr(evaluations, "bootstrap_bound", lambda rows, key, order, value, iterations=plain.__defaults__[0]: asked.append(iterations) or plain(rows, key, order, value, iterations))
    df = QUERIES["ev26_bootstrap_bound"](spark, "/root/testdata/sf0.001")
    assert asked == [2000] and "range(0, 500)" in ORACLES["ev26_bootstrap_bound"]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    assert f", {parts})" in [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(id" in line][0].split("REPARTITION_BY_NUM")[0]
