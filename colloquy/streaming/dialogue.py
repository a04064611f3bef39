"""Dialogue units of a stream of transcribed segments, as ``operators.dialogue.units`` gives for the whole.

A recording's state is its open unit in sums (counts of stages and topics, the first 180 characters of
text), what the next boundary needs of the last segment, and a map of the segments seen. Needs the
RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from colloquy.operators import dialogue as d

COLUMNS = ["recording_id", "segment_id", "start_sec", "end_sec", "transcript", "scenario", "speaker", "vad", "embedding", "topic_hint", "stage_hint"]
SCHEMA = "recording_id long, unit long, start_sec double, end_sec double, segments long, stage string, topic string, summary string, confidence long, stage_confidence long, score int, reason string, segment_id long, error string"


def _stripped(text: str | None) -> str:
    return re.sub(r"^\s+|\s+$", "", text or "")


def _half_up(part: int, whole: int) -> int:
    return (2 * part + whole) // (2 * whole)


def _inferred(text: str, scenario: str, hint: str | None, before: str | None) -> tuple[str, int]:
    if hint is not None:
        return hint, d.SAID
    told = []
    for place, (stage, phrases) in enumerate(d.PHRASES.get(scenario, {}).items()):
        found = [p for p in phrases if p in text]
        if found:
            told.append((sum(map(len, found)), -place, stage, len(found)))
    if told:
        strength, _, stage, n = max(told)
        return stage, min(9600, 6400 + 500 * n + 100 * strength)
    return (before, d.CARRIED) if before not in (None, d.UNKNOWN) else (d.UNKNOWN, d.NONE)


def _far(a: list | None, b: list | None) -> float | None:
    if a is None or b is None or len(a) != len(b):
        return None
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return min(2.0, max(0.0, 1 - sum(x * y for x, y in zip(a, b)) / n)) if n > 0 else None


def _boundary(last: dict, now: dict) -> tuple[int, str]:
    """Score (hundredths) and reason of the boundary between two segments."""
    signals = []
    pause = now["start"] - last["end"]
    if pause >= d.MEDIUM_SEC:
        signals.append(("long_pause", d.LONG_PAUSE) if pause >= d.LONG_SEC else ("pause", d.PAUSE))
    away = _far(last["vector"], now["vector"])
    if away is not None and away >= d.APART_AT:
        signals.append(("semantic_shift", d.FAR if away >= d.FAR_AT else d.APART))
    for what, none, code, points in (("stage", d.UNKNOWN, "business_stage_change", d.STAGE), ("topic", d.NO_TOPIC, "topic_change", d.TOPIC), ("speaker", None, "speaker_change", d.SPEAKER)):
        was, is_ = last[what] or none, now[what] or none
        if was != is_ and none not in (was, is_):
            signals.append((code, points))
    return min(100, sum(p for _, p in signals)), "+".join(c for c, _ in signals)


class Units(StatefulProcessor):
    """One recording's units; a repeat changes nothing, other contents of a number or a late number make an error row."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "said string")
        self.seen = handle.getMapState("seen", "segment_id long", "contents string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.open.get()[0]) if self.open.exists() else {"unit": 0, "n": 0, "order": None, "high": 0, "idle": False}
        out = []
        for r in sorted(pd.concat(list(rows)).to_dict("records"), key=lambda r: (r["start_sec"], r["end_sec"], r["segment_id"])):
            at = int(r["ts"].timestamp() * 1000)
            if state["n"] and at - state["high"] >= self.idle_ms:  # the pause counts, whether or not the timer ran in between
                out.append(self._closed(state, key[0]))
                state["idle"] = True
            state["high"] = max(state["high"], at)
            out += self._take(state, key[0], r)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(max(state["high"], timerValues.getCurrentWatermarkInMs() + 1) + self.idle_ms)
        self.open.update((json.dumps(state),))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = json.loads(self.open.get()[0])
        out = [self._closed(state, key[0])] if state["n"] else []
        state["idle"] = True
        self.open.update((json.dumps(state),))
        yield self._frame(out)

    def _take(self, state: dict, recording, r: dict) -> list[dict]:
        number = int(r["segment_id"])
        clean = {c: (None if isinstance(v, float) and math.isnan(v) else list(map(float, v)) if c == "embedding" and v is not None else v) for c, v in r.items() if c in COLUMNS}
        contents = hashlib.sha256(json.dumps(clean, sort_keys=True, default=str).encode()).hexdigest()
        error = lambda e: [{"recording_id": recording, "segment_id": number, "error": e}]
        if self.seen.containsKey((number,)):
            return [] if self.seen.getValue((number,))[0] == contents else error("conflict")
        order = [float(r["start_sec"]), float(r["end_sec"]), number]
        if state["order"] and order < state["order"]:
            return error("out_of_order")
        self.seen.updateValue((number,), (contents,))
        state["order"] = order
        text = _stripped(clean["transcript"])
        last = state["last"] if state["n"] else None
        stage, sure = _inferred(clean["transcript"] or "", clean["scenario"], clean["stage_hint"] if text else None, last and last["stage"])
        topic = last["topic"] if last and not text else (clean["topic_hint"] if text and clean["topic_hint"] else d.TOPICS.get(stage, d.NO_TOPIC))
        now = {"start": order[0], "end": order[1], "stage": stage, "topic": topic, "speaker": clean["speaker"], "vector": clean["embedding"] if text else None}
        score, reason = _boundary(last, now) if last else (0, "idle" if state["idle"] else "recording_start")
        out = []
        if last and score >= d.BOUNDARY:
            out.append(self._closed(state, recording))
        if not state["n"]:
            state |= {"start": order[0], "end": order[1], "stages": {}, "topics": {}, "text": "", "sure": 0, "vad": 0, "score": score, "reason": reason}
        n, total = state["stages"].get(stage, (0, 0))
        state["stages"][stage] = (n + 1, total + sure)
        state["topics"][topic] = state["topics"].get(topic, 0) + 1
        if text and len(state["text"]) <= d.SUMMARY:
            state["text"] = (state["text"] + " " + text if state["text"] else text)[: d.SUMMARY + 1]
        state |= {"n": state["n"] + 1, "end": max(state["end"], order[1]), "sure": state["sure"] + sure, "vad": state["vad"] + math.floor(clean["vad"] * 10000 + 0.5), "last": now, "idle": False}
        return out

    def _closed(self, state: dict, recording) -> dict:
        """The open unit's row; the next one is numbered on."""
        stage = max(state["stages"], key=lambda s: state["stages"][s][0])  # the first seen on a tie
        count, sure = state["stages"][stage]
        text, n = state["text"], state["n"]
        row = {
            "recording_id": recording, "unit": state["unit"], "start_sec": state["start"], "end_sec": state["end"], "segments": n, "stage": stage, "topic": max(state["topics"], key=state["topics"].get),
            "summary": text if len(text) <= d.SUMMARY else text[: d.SUMMARY - 1] + "…", "confidence": min(10000, _half_up(65 * state["sure"] + 35 * state["vad"], 100 * n)), "stage_confidence": _half_up(sure, count), "score": state["score"], "reason": state["reason"],
        }
        state["unit"], state["n"] = state["unit"] + 1, 0
        return row

    def _frame(self, rows: list[dict]) -> pd.DataFrame:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        frame = pd.DataFrame(rows, columns=names)
        for c in ("unit", "segments", "confidence", "stage_confidence", "score", "segment_id"):
            frame[c] = frame[c].astype("Int64")
        for c in ("stage", "topic", "summary", "reason", "error"):
            frame[c] = frame[c].astype(object).where(frame[c].notna(), None)
        return frame

    def close(self) -> None:
        pass


def units(segments: DataFrame, idle: str = "300 seconds", late: str = "5 minutes") -> DataFrame:
    """The rows of ``operators.dialogue.units`` of a stream of segments with an event time ``ts``, and error rows.

    However the stream is cut into batches, the units are those of the whole if segments of a
    recording come in order; a number that comes again with the same contents changes nothing, with others
    or behind a later one it makes a row with ``error``. A recording without segments for ``idle`` of event time closes
    its unit; if it goes on, the next unit starts anew (reason idle) and numbers go on. Segments more than
    ``late`` of event time behind the latest are left out by the watermark.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = segments.select(*COLUMNS, "ts").withWatermark("ts", late)
    return rows.groupBy("recording_id").transformWithStateInPandas(statefulProcessor=Units(wait), outputStructType=SCHEMA, outputMode="append", timeMode="EventTime")
