"""Dialogue units of a stream, however it is cut, against those of the whole."""

import datetime
import random

import pytest

from colloquy.operators import dialogue
from colloquy.streaming import dialogue as stream
from tests.test_operators import streamed

SCHEMA = "recording_id long, segment_id long, start_sec double, end_sec double, transcript string, scenario string, speaker string, vad double, embedding array<double>, topic_hint string, stage_hint string, ts timestamp"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def some_rows(n=40):
    rng = random.Random(6)
    says = ["您好", "想看项链，预算不高", "足金的克重和工费", "太贵，再便宜一点", "嗯", "", "  ", "试驾", "分期首付", " 慢走，再见 ", "说" * 70, None]
    rows = []
    for recording in (1, 2):
        at = 0.0
        for i in range(n):
            end = at + rng.randint(1, 9)
            vector = rng.choice([None, [1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 0.0], [1.0]])
            rows.append((recording, i, at, end, rng.choice(says), ["gold_jewelry", "automotive"][recording % 2], rng.choice(["a", "b", "", None]), rng.randint(0, 100) / 100, vector, rng.choice([None, None, "活动"]), rng.choice([None, None, None, "needs"]), START + datetime.timedelta(seconds=at)))
            at = end + rng.choice([0, 0, 0, 1, 4, 9])
    return rows


def plain(rows):
    return sorted(tuple(r[c] for c in ("recording_id", "unit", "start_sec", "end_sec", "segments", "stage", "topic", "summary", "confidence", "stage_confidence", "score", "reason")) for r in rows)


@pytest.mark.parametrize("cuts", [(80,), (7, 21, 22, 40, 63, 80)])
def test_any_cut_gives_the_units_of_the_whole(rocks, tmp_path, cuts):
    rows = sorted(some_rows(), key=lambda r: (r[2], r[0]))
    whole = plain(dialogue.units(rocks.createDataFrame(rows, SCHEMA).drop("ts")).collect())
    later = [(9, 0, 0.0, 1.0, "x", "generic", None, 1.0, None, None, None, START + datetime.timedelta(minutes=m)) for m in (60, 120)]
    parts, before = [], 0
    for c in cuts:
        parts.append(list(range(max(0, before - 3), c)))  # the last three come again
        before = c
    got = streamed(rocks, tmp_path, stream.units, rows + later, SCHEMA, [*parts, [80], [81]])
    assert plain(r for r in got if r.recording_id != 9 and r.error is None) == whole and len(whole) > 10
    assert not [r for r in got if r.error]


def test_errors_and_idle(rocks, tmp_path):
    row = lambda i, at, text, minute=0, recording=1: (recording, i, at, at + 1, text, "generic", None, 1.0, None, None, None, START + datetime.timedelta(minutes=minute))
    rows = [row(1, 0.0, "a"), row(2, 1.0, "b"), row(1, 0.0, "other"), row(0, 0.5, "late"), row(0, 0.0, "x", 60, 9), row(3, 2.0, "c", 61), row(0, 0.0, "x", 200, 8), row(1, 1.0, "x", 300, 8)]
    got = streamed(rocks, tmp_path, stream.units, rows, SCHEMA, [[0, 1], [2, 3], [4], [5], [6], [7]])
    assert sorted((r.segment_id, r.error) for r in got if r.error) == [(0, "out_of_order"), (1, "conflict")]
    assert sorted((r.unit, r.segments, r.summary, r.reason) for r in got if r.recording_id == 1 and not r.error) == [(0, 2, "a b", "recording_start"), (1, 1, "c", "idle")]


def test_conflicting_segments(spark):
    rows = [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, 1, "d")]
    assert [tuple(r) for r in dialogue.conflicting(spark.createDataFrame(rows, "recording_id long, segment_id long, transcript string")).collect()] == [(1, 2)]
