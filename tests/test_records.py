"""Answers in two formats, exports and lists on small rows."""

import re

from colloquy.operators import browse, tabular
from colloquy.sources import records as op

ANSWERS = [
    (1, '("实体"<|>A<|>t<|>"d e")##("关系"<|>A<|>owns<|>B<|>why<|>9)##junk<|COMPLETE|>(entity<|>x<|>y<|>z)'), (2, "entity,\"A, B\",'t', d\n\n(relation,A,owns,B,'why, so')\nentity,short"),
    (3, None), (4, ""), (5, "  \n (entity,,x,y) "), (6, "##"), (7, "(entity<|> \"q\" <|>''<|>\")"), (8, 'Entity,a,b,c'), (9, 'other, "a, b", c'),
]


def plain(text):
    out = []
    content = (text or "").split("<|COMPLETE|>")[0]
    for r in content.split("##") if "##" in content else content.split("\n"):
        r = r.strip()
        if not r:
            continue
        r = r[1:-1] if r.startswith("(") and r.endswith(")") else r
        fields = r.split("<|>") if "<|>" in r else [m.group(0) for m in re.finditer(r"\"([^\"]*)\"|'([^']*)'|([^,]+)", r)]
        cut = lambda f: f[1:-1] if len(f) > 1 and f[0] in "\"'" and f[-1] == f[0] else f
        out.append([cut(f.strip()).strip() for f in fields])
    return out


def test_records_in_both_formats(spark):
    df = spark.createDataFrame(ANSWERS, "k long, said string")
    got = {}
    for r in op.records(df, "k", "said").orderBy("k", "place").collect():
        got.setdefault(r.k, []).append(r.fields)
    assert got == {k: p for k, t in ANSWERS if (p := plain(t))}
    e, r = op.entities_and_relations(df, "k", "said")
    assert {tuple(x) for x in e.drop("place").collect()} == {(1, "A", "t", "d e"), (2, "A, B", "t", "d"), (7, "q", "", '"')}
    assert {tuple(x) for x in r.drop("place").collect()} == {(1, "A", "B", "owns", "why"), (2, "A", "B", "owns", "why, so")}
    assert {x.k: (x.entities, x.relations, x.parsed) for x in op.parsed(df, "k", "said").collect()} == {**{k: (0, 0, False) for k in (3, 4, 5, 6, 8, 9)}, 1: (1, 1, True), 2: (1, 1, True), 7: (1, 0, True)}


def test_transcripts_mask_and_keep_order(spark):
    rows = [(1, 2, 5.0, 6.0, "write to me@example.com"), (1, 1, 0.0, 1.0, "hello"), (1, 3, 7.0, 8.0, None), (2, 4, 0.0, 1.0, "other")]
    df = spark.createDataFrame(rows, "recording_id long, segment_id long, start_sec double, end_sec double, transcript string")
    got = {r.kind: r.body for r in op.transcripts(df, "recording_id", 1).collect()}
    assert got["transcript"] == "hello\nwrite to me@example.com\n" and "me@example.com" not in got["scrubbed_transcript"] and got["scrubbed_transcript"].startswith("hello\n")
    assert op.transcripts(df, "recording_id", 9).count() == 0
    bundle = op.export({"segment": (df, "segment_id", ["start_sec"])}, "recording_id", 2).collect()
    assert [tuple(r) for r in bundle] == [("segment", "4", '{"start_sec":0.0}')]


def test_lists_and_profiles(spark):
    df = spark.createDataFrame([(i, i % 2, f"n{i % 3}", i // 2) for i in range(10)], "recording_id long, agent_id long, agent_name string, started_sec long")
    page = browse.recording_list(df, {}, None, "-started_sec", 1, 2, name="n0")
    assert [(r.recording_id, r.total) for r in page.collect()] == [(9, 4), (6, 4)]
    assert browse.recording_list(df, {}, ("started_sec", 1, 2), "started_sec", 1, 9, owner=1, name="n0").count() == 2
    said = spark.createDataFrame([(1, 0.0, 2.0, "a", 0.5, " x　y\n"), (1, 3.0, 4.5, "", None, None), (2, None, None, None, None, "")], "recording_id long, start_sec double, end_sec double, speaker string, vad double, transcript string")
    assert {tuple(r) for r in tabular.speech_profile(said).collect()} == {(1, 4.5, 2, 1, 0.5, 2), (2, 0.0, 1, 0, None, 0)}
