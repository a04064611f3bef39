"""Conversation structure repair: rank-convergence parallel Viterbi over long conversations.

A conversation should read: nothing, or turn pairs of user and assistant after at most one system
turn. Each row is kept, given the other role, or deleted, and empty turns are inserted anywhere;
blank and repeated rows must go. The cheapest edits come from four states (nothing yet, after the
system turn, after the user, after the assistant) and backward costs: of each place and state the
least cost of all that follows.

1. Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any size is
   spread over tasks, and become blocks of at most ``BLOCK_ROWS`` steps. A conversation that lies
   whole within a partition and a block is solved there.
2. The others are pieces, one a partition. Every piece goes backward from a speculative cost vector
   (the one at a conversation's end) at the same time. In fix-up passes the pieces whose follower's
   first vector is not the one that they started from run again, until all vectors agree up to a
   constant. After a few rows costs rarely depend on what follows by more than a constant, so one
   or two passes do; at most there are as many as a conversation has pieces.
3. Stitched costs decide each edit. Every block tells where it leads from each of the four states;
   following these from the start gives each block the state it begins with, and from there blocks
   are traced independently. Of several cheapest edits the first in alphabetical order is taken.

Rows of one conversation, turn, role and text that make up over a ``HOT``-th of all rows are counted
before they are dealt. A sha256 of a conversation's text is one value over all of it in order: it
is taken from a sorted stream of blocks, one block in memory at a time.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.shared import cut

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 20
#: Keys with over this part of all rows are counted first; there are fewer than this many.
HOT = 1000
#: Repeated texts are broadcast up to so many (some 60 bytes each), beyond that joined by key.
BROADCAST_ROWS = 100_000
SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
#: State that a role's initial leads to; the states are start, system, user, assistant.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The one role that may be put in at a state, and where it leads.
NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
FOUND, CUT_OFF, GONE = 0, 1, 2
_INITIALS = "sua"
Vector = tuple[int, int, int, int]


def _closed(v: list[int]) -> Vector:
    """Costs with insertions before the place."""
    two = min(v[2], INSERT + v[3])
    return min(v[0], INSERT + two), min(v[1], INSERT + two), two, min(v[3], INSERT + v[2])


_NEVER = 1 << 30
#: Costs after the last row: ending is allowed at the start and after the assistant.
END: Vector = _closed([0, _NEVER, _NEVER, 0])


def kind_of(role: str, fault: int) -> int:
    """A step's number: its fault and the class of its role's initial."""
    at = _INITIALS.find(role[:1]) if role else -1
    return 4 * fault + (at if at >= 0 else 3)


@lru_cache(maxsize=100_000)
def _costs(after: Vector, kind: int) -> Vector:
    """Costs before a step, from those after it."""
    fault, initial = divmod(kind, 4)
    out = [v + DELETE for v in after]
    if fault != GONE:
        extra = TRUNCATED if fault == CUT_OFF else 0
        for state in range(4):
            to = STEPS[state].get(_INITIALS[initial]) if initial < 3 else None
            if to is not None:
                out[state] = min(out[state], extra + after[to])
            out[state] = min(out[state], extra + REROLE + after[NEXT[state][1]])
    return _closed(out)


@lru_cache(maxsize=100_000)
def before(after: Vector, kind: int) -> Vector:
    """Costs before a step up to a constant: the least is zero."""
    v = _costs(after, kind)
    least = min(v)
    return tuple(x - least for x in v)


@lru_cache(maxsize=100_000)
def move(after: Vector, kind: int, state: int) -> tuple[str, int]:
    """The first in order of the cheapest edits of a step, insertions before it included, and the state it leads to."""
    costs, letters = _costs(after, kind), ""
    fault, initial = divmod(kind, 4)
    extra = TRUNCATED if fault == CUT_OFF else 0
    while True:
        if DELETE + after[state] == costs[state]:
            return letters + "D", state
        to = NEXT[state][1]
        if INSERT + costs[to] == costs[state]:
            letters, state = letters + "I", to
            continue
        keep = STEPS[state].get(_INITIALS[initial]) if initial < 3 else None
        if fault != GONE and keep is not None and extra + after[keep] == costs[state]:
            return letters + "K", keep
        return letters + "R", to


#: Insertions after the last row.
TAIL = ("", "II", "I", "")


def vectors(kinds: bytes, end: Vector) -> list[Vector]:
    """Costs up to a constant before each step and, last, after all."""
    out = [end]
    for kind in reversed(kinds):  # a run of deletions changes costs by a constant only
        out.append(end if kind >= 4 * GONE else before(out[-1], kind))
        end = out[-1]
    return out[::-1]


def walk(kinds: bytes, end: Vector, state: int) -> Iterator[tuple[str, int, int]]:
    """(letters, state before, state after) of each step from ``state`` on."""
    costs = vectors(kinds, end)
    for i, kind in enumerate(kinds):
        letters, to = move(costs[i + 1], kind, state)
        yield letters, state, to
        state = to


def exits(kinds: bytes, end: Vector) -> list[tuple[int, int]]:
    """(state, number of turns) that a block leads to and leaves, from each of the four states."""
    out = []
    for start in range(4):
        state, n = start, 0
        for letters, _, state in walk(kinds, end, start):  # noqa: B007
            n += len(letters) - letters.count("D")
        out.append((state, n))
    return out


def trace(kinds: bytes, runs: list[int], roles: list[str], texts: list[str], end: Vector, state: int, last: bool) -> tuple[str, int, list[dict]]:
    """(edits, cost, turns that are left) of a block; roles and texts are those of its undeletable steps in order."""
    edits, cost, turns, at = [], 0, [], 0

    def put(letters: str, state: int) -> int:
        for _ in range(letters.count("I")):
            turns.append({"role": NEXT[state][0], "text": ""})
            state = NEXT[state][1]
        return state

    for (letters, now, to), kind, run in zip(walk(kinds, end, state), kinds, runs):
        fault = kind // 4
        edits.append(letters + "D" * (run - 1))
        cost += INSERT * letters.count("I")
        now = put(letters, now)
        if letters[-1] == "D":
            cost += DELETE * run
        else:
            kept = letters[-1] == "K"
            turns.append({"role": roles[at] if kept else NEXT[now][0], "text": texts[at]})
            cost += (0 if kept else REROLE) + (TRUNCATED if fault == CUT_OFF else 0)
        at += fault != GONE
        state = to
    if last:
        edits.append(TAIL[state])
        cost += INSERT * len(TAIL[state])
        put(TAIL[state], state)
    return "".join(edits), cost, turns


class Block:
    """Steps of one conversation while they are gathered."""

    def __init__(self) -> None:
        self.kinds, self.runs, self.roles, self.texts = bytearray(), [], [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.chars = self.turns = 0
        self.first = self.last = None
        self.turn_from = self.turn_to = None

    def full(self) -> bool:
        return len(self.kinds) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def add(self, turn: int | None, role: str, text: str, n: int, seen: bool) -> None:
        """A row and n - 1 copies of it; ``seen`` says that it repeats an earlier one."""
        bare = text.rstrip(SPACE)
        initial = role[:1]
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += (n - 1) * (initial * 2 not in LEGAL)
        self.last = initial
        if turn is not None and turn != self.turn_to:
            self.turn_from = turn if self.turn_from is None else self.turn_from
            self.turn_to, self.turns = turn, self.turns + 1
        gone = n - 1
        if not bare:
            self.blank, gone = self.blank + n, n
        elif seen:
            self.duplicate, gone = self.duplicate + n, n
        else:
            cut_off = bare[-1] not in ".!?"
            self.duplicate += n - 1
            self.truncated += cut_off
            self.kinds.append(kind_of(role, CUT_OFF if cut_off else FOUND))
            self.runs.append(1)
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(text) + len(role)
        if gone and self.kinds and self.kinds[-1] >= 4 * GONE:
            self.runs[-1] += gone
        elif gone:
            self.kinds.append(kind_of("", GONE))
            self.runs.append(gone)

    def row(self, conv: int | None, pid: int, k: int, closed: bool) -> dict:
        made = {
            "conv_id": conv, "ckey": "" if conv is None else str(conv), "pid": pid, "k": k, "closed": closed, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "first": self.first, "last": self.last, "turn_from": self.turn_from, "turn_to": self.turn_to, "turns": self.turns, "kinds": None, "runs": None, "roles": None, "texts": None, "audit": None, "cost": None, "left": None,
        }
        if closed:
            made["audit"], made["cost"], made["left"] = trace(bytes(self.kinds), self.runs, self.roles, self.texts, END, 0, True)
        else:
            made |= {"kinds": bytes(self.kinds), "runs": self.runs, "roles": self.roles, "texts": self.texts}
        return made


_STATS = "conv_id long, ckey string, pid int, k int, closed boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, turn_from long, turn_to long, turns long"
_BLOCKS = _STATS + ", kinds binary, runs array<long>, roles array<string>, texts array<string>, audit string, cost long, left array<struct<role:string,text:string>>"


def _sent(rows: Iterable[dict], ddl: str, size: int = 200) -> Iterator:
    """Rows as record batches of a schema, at most so many or a few blocks' text at once."""
    import pyarrow as pa

    plain = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    plain |= {"array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<struct<role:string,text:string>>": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))}
    schema = pa.schema([(n, plain[t]) for n, t in (f.split(" ") for f in ddl.split(", "))])
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(map(len, row.get("texts") or ())) + sum(len(t["text"]) for t in row.get("left") or ())
        if len(held) >= size or weight >= 4 * BLOCK_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def blocks_of(rows: Iterable[tuple], pid: int) -> Iterator[dict]:
    """Blocks of a partition's sorted rows (conv, turn, role, text, n, late)."""
    waiting = None  # the last block of a conversation that may be whole
    for number, (conv, group) in enumerate(itertools.groupby(rows, key=lambda r: r[0])):
        if waiting is not None:
            yield waiting[0].row(*waiting[1:], closed=waiting[2:] == (pid, 0) and number > 1)
        block, k, last = Block(), 0, None
        for _, turn, role, text, n, late in group:
            if block.full():
                yield block.row(conv, pid, k, False)
                block, k = Block(), k + 1
            block.add(turn, role, text, n, late or (turn, role, text) == last)
            last = (turn, role, text)
        waiting = (block, conv, pid, k)
    if waiting is not None:
        yield waiting[0].row(*waiting[1:], closed=False)


def _marked(turns: DataFrame) -> DataFrame:
    """Rows with ``n``, how many copies they stand for, and ``late``, whether an earlier turn has the same role and text."""
    keyed = turns.withColumn("ckey", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumn("tk", F.coalesce(F.col("turn").cast("string"), F.lit("")))
    keyed = keyed.withColumn("tkey", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))
    seen = cut(keyed.groupBy("ckey", "tkey", "turn", "tk").agg(F.count("*").alias("n")), "turn-counts")
    total = seen.agg(F.sum("n")).first()[0] or 0
    hot = seen.where((F.col("n") > total / HOT) & (F.col("n") > 1)).select("ckey", "tkey", "tk")
    one = keyed.withColumn("n", F.lit(1).cast("long"))
    if not hot.isEmpty():
        same = ["ckey", "tkey", "tk"]
        counted = keyed.join(F.broadcast(hot), same, "left_semi").groupBy(*keyed.columns).agg(F.count("*").alias("n"))
        one = one.join(F.broadcast(hot), same, "left_anti").select(counted.columns).unionByName(counted)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = cut(seen.groupBy("ckey", "tkey").agg(F.min(place).alias("since"), F.count("*").alias("c")).where("c > 1").select("ckey", "tkey", "since"), "turns-again")
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    late = F.col("since").isNotNull() & ~F.col("turn").eqNullSafe(F.col("since.turn"))
    return one.join(again, ["ckey", "tkey"], "left").select("conv_id", "turn", "role", "text", "n", late.alias("late"), "tkey")


def _blocks(turns: DataFrame) -> DataFrame:
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.substring("role", 1, 64), F.substring("text", 1, 64), "tkey"]

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        yield from _sent(blocks_of(rows, pid), _BLOCKS)

    return _marked(turns).repartitionByRange(*order).sortWithinPartitions(*order).drop("tkey").mapInArrow(run, _BLOCKS)


def _written(v: Vector) -> str:
    return ",".join(map(str, v))


def _read(v: str) -> Vector:
    return tuple(map(int, v.split(",")))


def _backward(steps: DataFrame) -> DataFrame:
    """(ckey, pid, k, begins, ends): costs before and after each block of the pieces, from each piece's ``end`` on."""
    schema = "ckey string, pid int, k int, begins string, ends string"

    def run(batches: Iterator) -> Iterator:
        def found() -> Iterator[dict]:
            rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
            for (ckey, pid), group in itertools.groupby(rows, key=lambda r: r[:2]):
                now = None
                for _, _, k, kinds, end in group:
                    now = now or _read(end)
                    first = vectors(kinds, now)[0]
                    yield {"ckey": ckey, "pid": pid, "k": k, "begins": _written(first), "ends": _written(now)}
                    now = first

        yield from _sent(found(), schema)

    kept = steps.select("ckey", "pid", "k", "kinds", "end")
    return kept.repartition("ckey", "pid").sortWithinPartitions("ckey", "pid", F.desc("k")).mapInArrow(run, schema)


def _stitched(steps: DataFrame) -> DataFrame:
    """Costs around every block (as :func:`_backward`) after all fix-up passes."""
    pieces = steps.select("ckey", "pid").distinct()
    follows = cut(pieces.withColumn("next", F.lead("pid").over(W.partitionBy("ckey").orderBy("pid"))), "pieces")
    known = cut(_backward(steps.withColumn("end", F.lit(_written(END)))), "costs")
    while True:
        begins = known.where("k = 0").select("ckey", F.col("pid").alias("next"), F.col("begins").alias("end"))
        last = known.groupBy("ckey", "pid").agg(F.max_by("ends", "k").alias("used"))
        stale = cut(follows.join(begins, ["ckey", "next"]).join(last, ["ckey", "pid"]).where("end <> used").select("ckey", "pid", "end"), "stale")
        if stale.isEmpty():
            return known
        again = _backward(steps.join(stale, ["ckey", "pid"]))
        known = cut(known.join(stale.select("ckey", "pid"), ["ckey", "pid"], "left_anti").unionByName(again), "costs")


def _entries(steps: DataFrame, costs: DataFrame) -> DataFrame:
    """(ckey, pid, k, ends, state, place, final): the state and number of turns that each block begins with."""
    told = "ckey string, pid int, k int, ends string, leads array<long>"
    schema = "ckey string, pid int, k int, ends string, state int, place long, final boolean"

    def leads(batches: Iterator) -> Iterator:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        found = ({"ckey": c, "pid": p, "k": k, "ends": e, "leads": [x for pair in exits(kinds, _read(e)) for x in pair]} for c, p, k, e, kinds in rows)
        yield from _sent(found, told)

    def follow(batches: Iterator) -> Iterator:
        def found() -> Iterator[dict]:
            rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
            for ckey, group in itertools.groupby(rows, key=lambda r: r[0]):
                state, place, held = 0, 0, None
                for _, pid, k, ends, to in group:
                    if held:
                        yield held
                    held = {"ckey": ckey, "pid": pid, "k": k, "ends": ends, "state": state, "place": place, "final": False}
                    state, place = to[2 * state], place + to[2 * state + 1]
                yield held | {"final": True}

        yield from _sent(found(), schema)

    of = steps.join(costs.select("ckey", "pid", "k", "ends"), ["ckey", "pid", "k"]).select("ckey", "pid", "k", "ends", "kinds")
    return of.mapInArrow(leads, told).repartition("ckey").sortWithinPartitions("ckey", "pid", "k").mapInArrow(follow, schema)


_SOLVED = _STATS + ", audit string, cost long, left array<struct<role:string,text:string>>, place long"


def solved(turns: DataFrame) -> DataFrame:
    """Blocks of all conversations in order of (ckey, pid, k) with their edits, cost, turns that are left and counts.

    ``turns`` has conv_id, turn (integers), role and text, none of the latter two null.
    """
    made = cut(_blocks(turns), "blocks")
    names = [f.split(" ")[0] for f in _SOLVED.split(", ")]
    whole = made.where("closed").withColumn("place", F.lit(0).cast("long")).select(*names)
    parts = made.where("not closed")
    steps = parts.select("ckey", "pid", "k", "kinds")
    entries = _entries(steps, _stitched(steps))

    def run(batches: Iterator) -> Iterator:
        def found() -> Iterator[dict]:
            for b in batches:
                for r in b.to_pylist():
                    r["audit"], r["cost"], r["left"] = trace(r["kinds"], r["runs"], r["roles"], r["texts"], _read(r["ends"]), r["state"], r["final"])
                    yield {c: r[c] for c in names}

        yield from _sent(found(), _SOLVED)

    traced = parts.drop("audit", "cost", "left").join(entries, ["ckey", "pid", "k"]).mapInArrow(run, _SOLVED)
    return cut(whole.unionByName(traced), "repaired")


def _spaced(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The four columns under fixed names; a missing role or text is one space."""
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return conversations.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"))


def repaired_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, role, text): the turns of every repaired conversation, numbered from 0.

    Rows go by turn, missing turns first, then by role and text (their first 64 characters, then a
    hash). A missing role or text counts as one space, a missing conversation as one of its own.
    Conversations of which nothing is left are not in the result; extra columns play no part.
    """
    done = solved(_spaced(conversations, conv, turn, role, text))
    return done.select("conv_id", "place", F.posexplode("left").alias("i", "t")).select("conv_id", (F.col("place") + F.col("i")).alias("position"), "t.role", "t.text")


def _stream_report(parts: DataFrame) -> DataFrame:
    """The report of conversations of several blocks: blocks come in order, one at a time."""
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches: Iterator) -> Iterator:
        def found() -> Iterator[dict]:
            rows = (r for b in batches for r in b.to_pylist())
            for _, group in itertools.groupby(rows, key=lambda r: r["ckey"]):
                told = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
                audit, sha, any_left = [], hashlib.sha256(), False
                start = end = last = None
                turns = 0
                for r in group:
                    for name in told:
                        told[name] += r[name]
                    told["illegal"] += last is not None and last + r["first"] not in LEGAL
                    last = r["last"]
                    if r["turns"]:
                        start = r["turn_from"] if start is None else start
                        turns += r["turns"] - (r["turn_from"] == end)
                        end = r["turn_to"]
                    audit.append(r["audit"])
                    for t in r["left"]:
                        sha.update((("\n" if any_left else "") + t["role"] + ":" + t["text"]).encode())
                        any_left = True
                gaps = end - start + 1 - turns if turns else 0
                yield {"conv_id": r["conv_id"], "gaps": gaps, **told, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

        yield from _sent(found(), schema)

    return parts.repartition("ckey").sortWithinPartitions("ckey", "pid", "k").mapInArrow(run, schema)


def report(conversations: DataFrame, every: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    Counts are those of the rows by their first fault; gaps are turn numbers missing between the
    least and the largest; illegal are neighbours whose roles don't follow each other; audit spells
    the edits (Delete, Insert, Keep, Rerole). ``every`` may name conversations (conv_id) to report
    even without rows, with zeros, an empty audit and the hash of nothing. Nulls, ties and other
    columns as in :func:`repaired_turns`.
    """
    done = solved(_spaced(conversations, conv, turn, role, text))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    lines = F.array_join(F.transform("left", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.coalesce(F.col("turn_to") - F.col("turn_from") + 1 - F.col("turns"), F.lit(0).cast("long"))
    out = done.where("closed").select("conv_id", gaps.alias("gaps"), *counts, F.sha2(lines, 256).alias("repaired_sha256")).unionByName(_stream_report(done.where("not closed")))
    if every is None:
        return out
    key = lambda d: d.withColumn("ckey", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    none = key(every.select(F.col("conv_id").cast("long")).distinct()).join(done.select("ckey").distinct(), "ckey", "left_anti")
    zero = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.unionByName(none.select("conv_id", *zero, F.lit("").alias("audit"), F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256")))


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by crc32(``conv_id:turn``) % 20, to try the repair on.

    0 drops the row, 1 empties its text, 2 takes out its ``[.!?]``, 3 repeats it, 4 makes it the user's.
    A missing value is one space, but for the turn's own column.
    """
    rows = _spaced(conversations, conv, turn, role, text)
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    coded = rows.withColumn("code", code).where("code <> 0")
    changed = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return coded.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("copy")).drop("copy")
