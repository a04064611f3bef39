"""Language-model scoring with a probabilistic suffix tree.

A document is its words (A-Z lower-cased, split at the contract's white space) and one end.
Symbols of the tree are the bytes of the words, a space after each word and a line feed as
the end; before a document stand ``DEPTH`` line feeds, so its first contexts are those of a start.

Learning counts all sequences of ``DEPTH`` + 1 bytes over the whole corpus, those of the training
rows apart; the counts of shorter ones are sums of these. A context joins the tree if its
next-symbol distribution diverges from that of its longest shorter suffix: count times the
Kullback-Leibler divergence (bits) is at least ``LEAST_GAIN`` bits per distinct symbol; the
suffixes of a context that joins come with it. No context is left out for being rare, so the
tree grows with the corpus and never comes to one place: the contexts of over ``TOP`` bytes are
dealt out by their last three, so that all suffixes of a context lie in one group, and the
groups are sized to about ``GROUP`` sequences. What is left is a table with the log10 chance of
every sequence of the corpus. Its ``HEAD`` most frequent sequences go to the tasks; the other
sequences of a document are counted there and joined with the table. Both ways are exact.

Distributions are smoothed down the tree: a context's symbol counts plus the parent's
distribution times the number of distinct symbols seen (at the root the uniform one over 256
bytes, once), so each sums to one.
A text's score adds log10 of the next symbol's chance in its longest suffix state.

The unigram base score needs the training count of every word of every document. Counts of
the ``FREQUENT`` most frequent words (a bounded table) go to the tasks; the other words of a
document are joined with the count table. Both ways are exact.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import cut

DEPTH = 6
#: No context needs a share of the symbols; the divergence test alone decides.
LEAST_SHARE = 0.0
LEAST_GAIN = 4.0
FREQUENT = 100_000
END = 10
FLUSH = 3_000_000
#: Contexts of up to this many bytes (65,536 of two at most) are judged on the driver.
TOP = 2
GROUP = 200_000
HEAD = 1_000_000
#: Bytes of text, about, and rows (under 256) that a task takes apart at once.
STEP_BYTES, STEP_ROWS = 1 << 20, 200
#: Sequences, about, that a task sorts at once.
SORTED = 4_000_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def symbols(text: str | None) -> bytes:
    """A document's symbols, without those before its start."""
    w = words(text)
    return b" ".join(w) + b" \n" if w else b"\n"


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 7, is 2; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def _split(texts):
    """The lists of words of an array of texts, as :func:`words` has them; null where there are none."""
    import pyarrow as pa
    import pyarrow.compute as pc

    low = pc.ascii_lower(pc.ascii_trim_whitespace(texts))
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(pc.binary_length(low), 0), pa.scalar(None, low.type), low))


def _joined(lists) -> list[bytes]:
    """What :func:`symbols` gives for the texts of these lists of words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return [b"\n" if t is None else t + b" \n" for t in pc.binary_join(lists, " ").cast(pa.binary()).to_pylist()]


def _grams(docs: list[bytes], size: int) -> np.ndarray:
    """Codes of the byte sequences of this size (under 8) that end in a symbol of a document, from the documents' symbols."""
    data = b"".join([b"\0" * (8 - size), *(b"\n" * (size - 1) + d for d in docs)])
    code = np.ndarray(max(0, len(data) - 7), ">u8", data, 0, (1,)).astype(np.uint64).view(np.int64)  # the eight bytes from each on
    code &= (1 << 8 * size) - 1
    ends = np.cumsum([len(d) + size - 1 for d in docs])
    keep = np.ones(len(code), bool)  # sequences that end before a document's first symbol
    for e in ends[:-1].tolist():
        keep[e - size + 1 : e] = False
    return code[keep]


def gram_counts(docs: DataFrame, size: int, held=None) -> DataFrame:
    """(code, n, m) over all texts, n without the rows where ``held`` is true; tasks send partial sums."""
    def count(batches: Iterator) -> Iterator:
        codes, counts, waiting = [], [], 0
        for c, n in _runs(marked(batches)):
            codes.append(c)
            counts.append(n)
            waiting += len(c)
            if waiting > FLUSH:
                codes, counts, waiting = _merged(codes, counts)
                if waiting > FLUSH:
                    yield from _sent(codes[0], counts[0])
                    codes, counts, waiting = [], [], 0
        if codes:
            codes, counts, _ = _merged(codes, counts)
            yield from _sent(codes[0], counts[0])

    def marked(batches: Iterator) -> Iterator:
        for batch in batches:
            for at, k in _steps(batch.column(0)):
                part = batch.slice(at, k)
                read = _joined(_split(part.column(0)))
                marks = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)  # the lowest bit is a held-out row's
                yield (_grams(read, size) << 1) | np.repeat(marks, [len(d) for d in read])

    told = docs.select("whole", (F.lit(False) if held is None else held).alias("held")).mapInArrow(count, "code long, n long, m long")
    return told.repartition("code").groupBy("code").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))  # the tasks' rows are sums already


def _runs(some: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct codes and their numbers, of about ``SORTED`` codes each."""
    held, have = [], 0
    for code in itertools.chain(some, [None]):
        if code is not None:
            held.append(code)
            have += len(code)
        if have > SORTED or (code is None and have):
            c = np.concatenate(held)
            held, have = [], 0
            c.sort()
            first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            yield c[first], np.diff(first, append=len(c))


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list, list, int]:
    """The sums of sorted runs as one; a stable sort merges runs."""
    c, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(c, kind="stable")
    c, n = c[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.zeros(0, np.int64)
    return [c[first]], [np.add.reduceat(n, first) if len(c) else n], len(first)


def _sent(marked: np.ndarray, counts: np.ndarray, step: int = 50_000) -> Iterator:
    """Rows (code, n, m) of sorted codes with a lowest bit that is 1 for held-out rows."""
    import pyarrow as pa

    codes = marked >> 1
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    learnt, every = (np.add.reduceat(x, first) for x in (np.where(marked & 1, 0, counts), counts))
    codes = codes[first]
    for i in range(0, len(codes), step):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + step], pa.int64()) for x in (codes, learnt, every)], names=["code", "n", "m"])


class Tree:
    """Retained contexts by depth with smoothed distributions, as arrays to look up."""

    def __init__(self, tables: dict[int, pd.DataFrame], depth: int = DEPTH):
        """tables[d]: (ctx, sym, n) of the contexts of d bytes that joined."""
        self.depth = depth
        seen = np.unique(np.concatenate([t.sym.to_numpy(np.int64) for t in tables.values()]))
        self.column = np.full(256, len(seen), np.int64)  # the last column is any symbol never seen
        self.column[seen] = np.arange(len(seen))
        self.width = len(seen) + 1
        rows, self.keys, self.first = [], {}, {}
        up_keys, up_p, at = None, None, 0
        for d in range(depth + 1):
            t = tables[d]
            keys = np.unique(t.ctx.to_numpy(np.int64)) if d else np.zeros(1, np.int64)
            counts = np.zeros((len(keys), self.width))
            np.add.at(counts, (np.searchsorted(keys, t.ctx.to_numpy(np.int64)), self.column[t.sym.to_numpy(np.int64)]), t.n.to_numpy(float))
            if d == 0:
                up = np.full((1, self.width), 1 / 256)
            else:
                up = up_p[np.searchsorted(up_keys, keys & ((1 << 8 * (d - 1)) - 1))] if len(keys) else counts
            kinds = np.ones((1, 1)) if d == 0 else (counts > 0).sum(1, keepdims=True)
            p = (counts + kinds * up) / (counts[:, :-1].sum(1, keepdims=True) + kinds) if len(keys) else counts
            up_keys, up_p = keys, p
            rows.append(np.log10(p).astype(np.float32))
            self.keys[d], self.first[d] = keys, at
            at += len(keys)
        self.logs = np.concatenate(rows).ravel()
        self.slots = {d: _slots(self.keys[d]) for d in range(1, depth + 1)}
        self.size = at

    def chances(self, code: np.ndarray) -> np.ndarray:
        """log10 of the chance of each sequence's last symbol after the others."""
        state = np.zeros(len(code), np.int64)
        ctx = code >> 8
        open_ = np.arange(len(code))
        for d in range(self.depth, 0, -1):
            if not len(open_) or not len(self.keys[d]):
                continue
            found = _look_up(self.slots[d], ctx[open_] & ((1 << 8 * d) - 1))
            hit = found >= 0
            state[open_[hit]] = found[hit] + self.first[d]
            open_ = open_[~hit]
        return self.logs[state * self.width + self.column[code & 255]].astype(float)


_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """An open-addressed table of sorted keys, at most half full: (key or -1, place) by slot, and the shift."""
    power = max(4, int(math.ceil(math.log2(max(1, len(keys)) * 2))))
    shift, mask = 64 - power, (1 << power) - 1
    at, place = np.full(1 << power, -1, np.int64), np.full(1 << power, -1, np.int32)
    todo, s = np.arange(len(keys)), ((keys.astype(np.uint64) * _MULTIPLY) >> np.uint64(shift)).astype(np.int64)
    while len(todo):
        free = np.flatnonzero(at[s] < 0)
        _, first = np.unique(s[free], return_index=True)
        put = free[first]
        at[s[put]], place[s[put]] = keys[todo[put]], todo[put]
        left = np.ones(len(todo), bool)
        left[put] = False
        todo, s = todo[left], (s[left] + 1) & mask
    return at, place, shift


def _find(at: np.ndarray, shift: int, wanted: np.ndarray) -> np.ndarray:
    """The slot of each code, -1 where it has none."""
    s = ((wanted.view(np.uint64) * _MULTIPLY) >> np.uint64(shift)).view(np.int64)
    key = at[s]
    other = np.flatnonzero(key != wanted)
    now, key, mask = s[other], key[other], len(at) - 1
    s[other] = -1
    while len(other):
        open_ = key >= 0
        other, now = other[open_], (now[open_] + 1) & mask
        key = at[now]
        hit = key == wanted[other]
        s[other[hit]] = now[hit]
        other, now, key = other[~hit], now[~hit], key[~hit]
    return s


def _look_up(slots: tuple[np.ndarray, np.ndarray, int], wanted: np.ndarray) -> np.ndarray:
    at, place, shift = slots
    s = _find(at, shift, wanted)
    return np.where(s >= 0, place[s], -1)


def grow(counts: DataFrame, depth: int = DEPTH, least_share: float = LEAST_SHARE, least_gain: float = LEAST_GAIN) -> dict[int, pd.DataFrame]:
    """The tables of a whole :class:`Tree` from (code, n) of depth + 1 bytes, on the driver.

    For small corpora, to look at; :func:`score` takes :func:`chances`.
    """
    counts = cut(counts.where("n > 0"), "grams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent: dict[int, DataFrame] = {}
    for d in range(depth + 1):
        mask = (1 << 8 * d) - 1
        one = counts.groupBy(F.expr(f"shiftright(code, 8) & {mask}L").alias("ctx"), F.expr("code & 255L").alias("sym")).agg(F.sum("n").alias("n"))
        enough = one.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where(F.col("total") >= least_share * total)
        frequent[d] = cut(one.join(enough, "ctx"), f"contexts{d}")
    joined: dict[int, DataFrame] = {}
    for d in range(depth, 0, -1):
        mask = (1 << 8 * (d - 1)) - 1
        up = frequent[d - 1].select(F.col("ctx").alias("up"), "sym", F.col("n").alias("un"), F.col("total").alias("ut"))
        gain = F.sum(F.col("n") * F.log2(F.col("n") / F.col("total") * F.col("ut") / F.col("un")))
        told = frequent[d].withColumn("up", F.expr(f"ctx & {mask}L")).join(up, ["up", "sym"]).groupBy("ctx").agg(gain.alias("gain"), F.max("kinds").alias("kinds"))
        own = told.where(F.col("gain") >= least_gain * F.col("kinds")).select("ctx")
        if d < depth:
            own = own.union(joined[d + 1].select(F.expr(f"ctx & {(1 << 8 * d) - 1}L").alias("ctx"))).distinct()
        joined[d] = cut(own, f"joined{d}")
    tables = {0: frequent[0]} | {d: frequent[d].join(joined[d], "ctx", "left_semi") for d in joined}
    return {d: t.select("ctx", "sym", "n").toArrow().to_pandas() for d, t in tables.items()}


class Level:
    """Distinct sequences of d + 1 bytes, sorted, with training counts and sums of their contexts of d bytes."""

    def __init__(self, pair: np.ndarray, n: np.ndarray):
        self.pair, self.n = pair, n.astype(float)
        self.at = np.cumsum(np.diff(pair >> 8, prepend=-1) != 0) - 1
        size = int(self.at[-1]) + 1 if len(pair) else 0
        self.kinds = np.bincount(self.at, self.n > 0, size)[self.at]
        self.total = np.bincount(self.at, self.n, size)[self.at]

    def shorter(self, d: int) -> tuple[Level, np.ndarray]:
        """The level of contexts of d bytes, and each sequence's place there."""
        pair, up = np.unique(self.pair & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        return Level(pair, np.bincount(up, self.n, len(pair))), up

    def smoothed(self, up: np.ndarray) -> np.ndarray:
        return (self.n + self.kinds * up) / np.maximum(self.total + self.kinds, 1)

    def diverges(self, n: np.ndarray, total: np.ndarray, least_gain: float) -> np.ndarray:
        """Whether each sequence's context passes the test against its suffix's counts."""
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(self.n > 0, self.n * np.log2(self.n / self.total * total / n), 0.0)
        return (self.total > 0) & (np.bincount(self.at, gain, self.at[-1] + 1)[self.at] >= least_gain * self.kinds)

    def whole(self, some: np.ndarray) -> np.ndarray:
        """True for all sequences of a context where any is."""
        return (np.bincount(self.at, some, self.at[-1] + 1) > 0)[self.at]


def _deep(code: np.ndarray, n: np.ndarray, top: dict[str, np.ndarray], depth: int, least_gain: float) -> np.ndarray:
    """log10 of the chance of each sequence whose state is longer than ``TOP`` bytes; NaN for others.

    Takes distinct sorted sequences: all of the corpus that share some suffixes of over ``TOP`` bytes.
    """
    levels, ups = {depth: Level(code, n)}, {}
    for d in range(depth - 1, TOP, -1):
        levels[d], ups[d + 1] = levels[d + 1].shorter(d)
    pair = levels[TOP + 1].pair & ((1 << 8 * (TOP + 1)) - 1)
    at = np.minimum(np.searchsorted(top["pair"], pair), max(0, len(top["pair"]) - 1))
    known = top["pair"][at] == pair if len(top["pair"]) else np.zeros(len(pair), bool)
    if not known.any():
        return np.full(len(code), np.nan)
    up_n, up_total = (np.where(known, top[k][at], 0.0) for k in ("n", "total"))
    up_p = 10.0 ** top["tree"].chances(pair)
    p, joined = {}, {}
    for d in range(TOP + 1, depth + 1):
        x = levels[d]
        if d > TOP + 1:
            below, up = levels[d - 1], ups[d]
            up_n, up_total, up_p = below.n[up], below.total[up], p[d - 1][up]
        p[d] = x.smoothed(up_p)
        joined[d] = x.diverges(up_n, up_total, least_gain)
    for d in range(depth, TOP + 1, -1):
        x = levels[d - 1]
        joined[d - 1] = x.whole(joined[d - 1] | (np.bincount(ups[d], joined[d], len(x.pair)) > 0))
    out = np.full(len(levels[TOP + 1].pair), np.nan)
    for d in range(TOP + 1, depth + 1):
        if d > TOP + 1:
            out = out[ups[d]]
        out = np.where(joined[d], np.log10(np.where(joined[d], p[d], 1.0)), out)
    return out


def _tables(levels: dict[int, Level], joined: dict[int, np.ndarray]) -> dict[int, pd.DataFrame]:
    keep = {d: joined[d] & (x.n > 0) for d, x in levels.items()}
    return {d: pd.DataFrame({"ctx": x.pair[keep[d]] >> 8, "sym": x.pair[keep[d]] & 255, "n": x.n[keep[d]]}) for d, x in levels.items()}


def chances(grams: DataFrame, depth: int = DEPTH, least_gain: float = LEAST_GAIN) -> tuple[DataFrame, Tree]:
    """(code, m, logp) for every row of (code, n, m), and the tree of contexts of up to ``TOP`` bytes.

    logp is null where no longer context of the sequence joined: the small tree knows its chance.
    """
    spark = grams.sparkSession
    short = grams.where("n > 0").groupBy(F.expr(f"code & {(1 << 8 * (TOP + 1)) - 1}L").alias("pair")).agg(F.sum("n").alias("n")).orderBy("pair").toArrow()
    levels, ups = {TOP: Level(short.column("pair").to_numpy().astype(np.int64), short.column("n").to_numpy())}, {}
    for d in range(TOP - 1, -1, -1):
        levels[d], ups[d + 1] = levels[d + 1].shorter(d)
    full = Tree(_tables(levels, {d: np.ones(len(x.pair), bool) for d, x in levels.items()}), TOP)
    x = levels[TOP]
    top = {"pair": x.pair, "n": x.n, "total": x.total, "tree": full}
    sent = spark.sparkContext.broadcast(top)
    groups = max(1, -(-grams.count() // GROUP))

    def judge(table):
        import pyarrow as pa

        code, n, m = (table.column(c).to_numpy() for c in ("code", "n", "m"))
        order = np.argsort(code)
        logp = _deep(code[order], n[order], sent.value, depth, least_gain)
        return pa.table({"code": pa.array(code[order]), "m": pa.array(m[order]), "logp": pa.array(logp, pa.float64(), mask=np.isnan(logp))})

    suffix = F.xxhash64(F.expr(f"shiftright(code, 8) & {(1 << 8 * (TOP + 1)) - 1}L"))
    dealt = grams.groupBy(F.pmod(suffix, F.lit(groups)).alias("part"))
    found = cut(dealt.applyInArrow(judge, "code long, m long, logp double"), "chances")
    deep = found.where("logp is not null").select(F.expr(f"shiftright(code, 8) & {(1 << 8 * TOP) - 1}L").alias("ctx")).distinct().toArrow().column("ctx").to_numpy()
    joined = {TOP: np.isin(x.pair >> 8, deep)}
    for d in range(TOP, 0, -1):
        x, below, up = levels[d], levels[d - 1], ups[d]
        if len(x.pair):
            joined[d] = x.whole(joined.get(d, False) | x.diverges(below.n[up], below.total[up], least_gain))
            joined[d - 1] = below.whole(np.bincount(up, joined[d], len(below.pair)) > 0)
        else:
            joined[d - 1] = np.zeros(0, bool)
    joined[0] = np.ones(len(levels[0].pair), bool)
    return found, Tree(_tables(levels, joined), TOP)


def head_and_tail(found: DataFrame, short: Tree) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Sorted codes of about ``HEAD`` most frequent sequences at most with their chances, and (word, logp) of the others."""
    step = F.floor(F.log2("m") * 16)
    sizes = sorted(((r.step, r["count"]) for r in found.groupBy(step.alias("step")).count().collect()), reverse=True)
    least, have = float("inf"), 0
    for k, n in sizes:
        have += n
        if have > HEAD:
            break
        least = k
    frequent = step >= F.lit(least)
    head = found.where(frequent).select("code", "logp").orderBy("code").toArrow()
    codes = head.column("code").to_numpy().astype(np.int64)
    logs = head.column("logp").to_numpy().astype(float)
    logs = np.where(np.isnan(logs), short.chances(codes), logs)
    sent = found.sparkSession.sparkContext.broadcast(short)

    def fill(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            code, p = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            p = np.where(np.isnan(p), sent.value.chances(code), p)
            yield pa.RecordBatch.from_arrays([_as_words(code), pa.array(p)], names=["word", "logp"])

    return codes, logs, found.where(~frequent).select("code", "logp").mapInArrow(fill, "word binary, logp double")


def _steps(texts) -> Iterator[tuple[int, int]]:
    """(first, number) of rows of bounded size together, or of one longer text."""
    import pyarrow.compute as pc

    at = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > at and (size + (n or 0) > STEP_BYTES or i - at == STEP_ROWS):
            yield at, i - at
            at, size = i, 0
        size += n or 0
    if len(texts) > at:
        yield at, len(texts) - at


def _as_words(code: np.ndarray):
    """Sequences as binary values that no word equals: a line feed, then the bytes."""
    import pyarrow as pa

    data = (code.astype(np.int64) | (END << 56)).astype(">i8").tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(code), [None, pa.py_buffer(data)]).cast(pa.binary())


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over all tokens, the ends not among them; tasks send partial sums."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, have = [], 0

        def merged():
            return pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"])

        for batch in batches:
            for at, k in _steps(batch.column(0)):
                found = _split(batch.column(0).slice(at, k)).flatten().value_counts()
                held.append(pa.RecordBatch.from_arrays([found.field(0).cast(pa.binary()), found.field(1)], names=["word", "n"]))
                have += len(found)
                if have > FLUSH:
                    now = merged()
                    held, have = now.to_batches(), len(now)
                    if have > FLUSH // 2:
                        yield from now.to_batches(max_chunksize=50_000)
                        held, have = [], 0
        if held:
            yield from merged().to_batches(max_chunksize=50_000)

    return train.select("whole").mapInArrow(count, "word binary, n long").repartition("word").groupBy("word").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from the rows that are not held out. A null or empty text is the end alone. Rows
    that repeat an id and a text have equal results and keep their number. Without training
    rows all counts are 0 and the tree is its root with an even distribution.
    """
    size = DEPTH + 1
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("whole"))
    train = base.where(~held_out())
    counts = cut(word_counts(train), "words")
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    ends = train.count()
    known_total, kinds = (sums.n or 0) + ends, sums.v + (1 if ends else 0)
    heavy = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    spark = docs.sparkSession
    codes, logs_, tail = head_and_tail(*chances(cut(gram_counts(base, size, held_out()), "grams"), DEPTH))
    sent = spark.sparkContext.broadcast((codes, logs_, heavy.column("word").to_pylist(), heavy.column("n").to_pylist()))

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        head_codes, shift, head_logs, frequent, frequent_n = _ready(sent)
        told_type = pa.struct([("n", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64())])

        def rows(of: np.ndarray, ids, keys: np.ndarray, word, times: np.ndarray, told=None):
            arrays = [ids.take(pa.array(of)), pa.array(keys[of]), word, pa.array(times), pa.nulls(len(of), told_type) if told is None else told]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "word", "times", "told"])

        for batch in batches:
            for at, k in _steps(batch.column(1)):
                ids, texts = batch.column(0).slice(at, k), batch.column(1).slice(at, k)
                lists = _split(texts)
                read = _joined(lists)
                code = _grams(read, size)
                slot = _find(head_codes, shift, code)
                ends = np.cumsum([len(d) for d in read])
                score = np.add.reduceat(np.where(slot >= 0, head_logs[slot], 0.0), np.concatenate(([0], ends[:-1])))
                left = np.flatnonzero(slot < 0)
                owner = np.searchsorted(ends, left, side="right").astype(np.uint64)  # under 256
                other, number = np.unique((owner << np.uint64(56)) | code[left].view(np.uint64), return_counts=True)
                keys = np.array([xxhash.xxh3_64_intdigest(t or b"") for t in texts.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
                told_words = lists.flatten().dictionary_encode()
                kinds, place = told_words.dictionary.cast(pa.binary()), told_words.indices.to_numpy().astype(np.int64)
                owner = pc.list_parent_indices(lists).to_numpy()
                c = frequent_n[pc.fill_null(pc.index_in(kinds, value_set=frequent), -1).to_numpy(zero_copy_only=False)]  # -1 for others
                told = pa.StructArray.from_arrays(
                    [
                        pa.array(np.bincount(owner, minlength=k).astype(np.int64)), pa.array(np.bincount(owner[c[place] >= 0], minlength=k).astype(np.int64)),
                        pa.array(np.bincount(owner, np.log10(np.maximum(c, 0) + 1)[place], k).astype(float)), pa.array(score),
                    ],
                    fields=list(told_type),
                )
                rare_ = c[place] < 0
                rest, times = np.unique((owner[rare_].astype(np.int64) << 32) | place[rare_], return_counts=True)
                # a document's own row: its word has a space, so no word equals it and the rows are dealt out
                own = [b" " + x.tobytes() + (b"" if d is None else d.to_bytes(8, "little", signed=True)) for x, d in zip(keys, ids.to_pylist())]
                yield rows(np.arange(k), ids, keys, pa.array(own, pa.binary()), np.zeros(k, np.int64), told)
                if len(rest):
                    yield rows(rest >> 32, ids, keys, kinds.take(pa.array(rest & ((1 << 32) - 1))), times.astype(np.int64))
                if len(other):
                    word = _as_words((other & np.uint64((1 << 56) - 1)).astype(np.int64))
                    yield rows((other >> np.uint64(56)).astype(np.int64), ids, keys, word, number.astype(np.int64))

    parts = base.mapInArrow(pieces, "doc_id long, key long, word binary, times long, told struct<n:long,known:long,logs:double,score:double>")
    rare = counts.select("word", F.col("n").alias("c"), F.lit(None).cast("double").alias("logp")).union(tail.select("word", F.lit(None).cast("long").alias("c"), "logp"))
    found = parts.join(rare.hint("shuffle_hash"), "word", "left")  # the distinct ones are few beside their occurrences, which need no sort
    end_log = math.log10(ends + 1)
    told = lambda c: F.coalesce(F.sum(f"told.{c}"), F.lit(0))
    summed = found.groupBy("doc_id", "key").agg(
        F.count("told").alias("m"), F.sum("told.n").alias("n"),
        (told("known") + F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("times"))), F.lit(0))).alias("known"),
        (told("logs") + F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1))).alias("logs"), (told("score") + F.sum(F.col("times") * F.coalesce("logp", F.lit(0.0)))).alias("score"),
    )
    m, n_tokens = F.col("m"), (F.col("n") / F.col("m")).cast("long") + 1
    return summed.select(
        "doc_id", held_out().alias("held_out"), n_tokens.alias("n_tokens"),
        ((F.col("known") / m).cast("long") + (1 if ends else 0)).alias("n_known"), F.lit(known_total).cast("long").alias("train_tokens"),
        (F.col("logs") / m + end_log - n_tokens * math.log10(known_total + kinds + 1)).alias("base_score"),
        (F.col("score") / m).alias("score"), F.explode(F.sequence(F.lit(1), m)).alias("copy"),
    ).drop("copy")


@lru_cache(maxsize=1)
def _ready(sent) -> tuple:
    import pyarrow as pa

    codes, logs, heavy, n = sent.value
    at, place, shift = _slots(codes)
    return at, shift, np.append(logs, 0.0)[place], pa.array(heavy, pa.binary()), np.append(np.array(n, np.int64), -1)
