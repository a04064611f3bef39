"""Repair of conversations against a plain search over whole conversations."""

import hashlib
import random
import re
import zlib

import pytest

from colloquy.llm import repair

WORD = re.compile(r"[^\x20\x09-\x0D]")
FORM = re.compile(r"(s?(ua)+)?\Z")
AFTER = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        found = WORD.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, edits, turns): all states forward, with the first of the cheapest edits of each."""

    def inserted(best):
        for _ in range(3):
            for state, (cost, edits, turns) in list(best.items()):
                for initial, name in NAMES.items():
                    if initial in AFTER[state]:
                        offer = (cost + 2, edits + "I", [*turns, (name, "")])
                        to = AFTER[state][initial]
                        best[to] = min(best.get(to, offer), offer)
        return best

    best = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults(rows)):
        new = {}

        def offer(state, cost, edits, turns, new=new):
            new[state] = min(new.get(state, (cost, edits, turns)), (cost, edits, turns))

        for state, (cost, edits, turns) in best.items():
            offer(state, cost + 3, edits + "D", turns)
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if role[:1] in AFTER[state]:
                offer(AFTER[state][role[:1]], cost + more, edits + "K", [*turns, (role, text)])
            for initial, name in NAMES.items():
                if initial in AFTER[state]:
                    offer(AFTER[state][initial], cost + 2 + more, edits + "R", [*turns, (name, text)])
        best = inserted(new)
    found = min(best[s] for s in ("", "a") if s in best)
    assert FORM.match("".join(r[:1] for r, _ in found[2]))
    return found


def plain_report(rows):
    """rows: (conv, turn, role, text) with nulls."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        f = faults(own)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, edits, left = cheapest(own)
        text = "\n".join(f"{r}:{t}" for r, t in left)
        out.append((conv, gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest()))
    return out


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            out += [(conv, turn, "user" if code == 4 else role, text)] * (1 + (code == 3))
    return out


def some_rows(n, long=0):
    rng = random.Random(n)
    rows = []
    roles = ["user", "assistant", "system", "tool", "", None, "unknown", "admin"]
    for conv in range(n):
        weights = rng.choice([(8, 8, 1, 0, 0, 0, 0, 0), (5, 5, 2, 2, 1, 1, 1, 1), (1, 1, 1, 8, 0, 1, 0, 0)])
        size = long if long and conv == 2 else rng.randint(1, 12)
        for i in range(size):
            role = ("system" if i == 0 and rng.random() < 0.4 else ("user", "assistant")[i % 2]) if rng.random() < 0.7 else rng.choices(roles, weights)[0]
            text = rng.choice(["Yes.", "no", "ok!", " ", "", None, "\n\t", "half", "日本。?", "x" * 70 + rng.choice("ab") + "."]) if rng.random() < 0.4 else f"text {rng.randint(0, 10**6)}."
            rows.append((conv, rng.choice([None, i]) if rng.random() < 0.1 else i + (i > 6) * 2, role, text))
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (n, 0, "user", "Same.")] + [(n, 0, "user", "Same.")] * 40
    return rows


def check(spark, rows, partitions):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, kinds string").repartition(partitions)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, repair.report(df).collect()), key=key) == sorted(plain_report(rows), key=key)


def test_against_search(spark):
    check(spark, some_rows(150), 3)


def test_long_conversations_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "HOT", 1)  # repeated rows stay rows
    monkeypatch.setattr(repair, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(repair.Block, "full", lambda self: len(self.kinds) >= 5)
    check(spark, some_rows(12, long=400), 2)


def test_blocks_and_vectors():
    rng = random.Random(3)
    for _ in range(300):
        kinds = bytes(rng.randrange(12) for _ in range(rng.randint(0, 40)))
        at = rng.randint(0, len(kinds))
        late, early = kinds[at:], kinds[:at]
        whole = repair.vectors(kinds, repair.END)
        assert repair.vectors(early, repair.vectors(late, repair.END)[0]) == whole[: at + 1]
        for start in range(4):
            state, n = repair.exits(early, whole[at])[start]
            assert repair.exits(kinds, repair.END)[start] == (repair.exits(late, repair.END)[state][0], n + repair.exits(late, repair.END)[state][1])


def test_fix_up_passes_reach_the_true_costs(spark):
    """Roles that fit nowhere keep the parity of what follows, so vectors differ over all pieces."""
    rng = random.Random(9)
    rows = [(1, i, "tool", f"t{i}.") for i in range(101)] + [(2, i, rng.choice(["tool", "user"]), f"t{i}.") for i in range(101)]
    check(spark, rows, 4)


def test_damage(spark):
    rows = some_rows(80)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, repair.damaged(df).collect()), key=key) == sorted(plain_damage(rows), key=key)


def test_repaired_turns_and_missing_conversations(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (2, 0, "assistant", "Hello."), (3, 0, "user", " ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, repair.repaired_turns(df).collect()))
    assert got == [(1, 0, "user", "Hi."), (1, 1, "assistant", "Again."), (2, 0, "user", ""), (2, 1, "assistant", "Hello.")]
    told = {r.conv_id: tuple(r) for r in repair.report(df, spark.createDataFrame([(1,), (9,), (None,)], "conv_id long")).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert told[9] == (9, 0, 0, 0, 0, 0, 0, "", nothing) and told[None][1:] == told[9][1:] and told[3] == (3, 0, 1, 0, 0, 0, 3, "D", nothing)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(empty).collect() == [] and repair.repaired_turns(empty).collect() == []


@pytest.mark.parametrize("size", [200_000])
def test_very_long_text(spark, size):
    check(spark, [(1, 0, "user", "x " * size), (1, 1, "assistant", "y" * size + "."), (2, 0, "user", None)], 2)
