"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct three-word shingles (hashed to 64 bits); documents with equal
sets form a class and count as one. All shingles are put in one order, the rare ones first. Of two
sets with Jaccard similarity s or more and sizes n the overlap is at least t = ceil(s * n) for each of
them, so for every l their first n - t + l shingles share at least l: drop fewer than t of either
set and the first l common shingles remain in both.

1. Counting: every shingle of every row adds to one of ``COUNTERS`` counters by its hash. Their logarithms, half
   a byte each, are the order's first part and the hash is the second; the table has a fixed size,
   so it may be broadcast. A wrong count costs time, never a link: any order is right.
2. Adaptive prefixes: the documents that share at least l shingles with a prefix are at most the
   sum of its shingles' counts over l. A longer prefix reads more postings and leaves fewer
   documents to verify, so each class takes the l of 1 to ``MOST`` with the least estimated cost and
   keeps n - t + l shingles. A pair is verified only if the prefixes share the lesser l of both.
3. Candidates: classes, numbered by 64 bits as their keys of 128 would be most of what is shuffled, are in the
   bucket of each of their first n - t + 1 shingles, of which every linked pair shares one; postings are
   dealt by shingle once, where those of a shingle with one class are dropped. In star rounds each bucket that still holds several components pairs
   its least member (then one drawn by hash) with all others and lets it go, so pairs grow with
   members and not with their square; then the remaining buckets are dealt by pairs of blocks
   of ``BLOCK`` members, which return only links that connect. Nothing is capped.
4. Verification: full sets of those pairs that share enough prefix shingles.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.dedup import _told, components, is_link, text_key
from colloquy.llm.shared import cut

WORDS = 3
#: Link when 100 * intersection >= share * union.
SHARE = 90
#: Counters over all shingles; as half bytes they take 32 MB.
COUNTER_BITS = 26
COUNTERS = 1 << COUNTER_BITS
#: Counters that one row of partial counts covers.
PART = 1 << 16
#: Shingles that a task counts before it sends.
FLUSH = 4_000_000
MOST = 8
#: So many ids are broadcast to pick the prefixes, texts and sets of candidates; where there are more, these are joined by key.
BROADCAST_IDS = 500_000
BLOCK = 256
STARS = 2
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; the whole sequence if it has fewer words, empty without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return np.array([h(b" ".join(words))], np.uint64)
    w = np.array(list(map(h, words)), np.uint64)
    n = len(w) - WORDS + 1
    acc = w[:n]
    for k in range(1, WORDS):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + w[k : n + k]
    acc = (acc ^ (acc >> np.uint64(30))) * _MIX[0]
    acc = (acc ^ (acc >> np.uint64(27))) * _MIX[1]
    return np.unique(acc ^ (acc >> np.uint64(31)))


def least_overlap(n: int, share: int) -> int:
    """Shingles that a set of n has in common with any set it links with, at least."""
    return -(-n * share // 100)


def counters(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Half bytes, two a byte: twice the logarithm of each counter, from half the mean on."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        held, size = [], 0

        def sent():
            at, n = np.unique(np.concatenate(held), return_counts=True)
            part = (at // PART).astype(np.int64)
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=COUNTERS))
            low = (at % PART).astype(np.int64)
            rows = [(int(part[i]), pack(np.diff(low[i:j], prepend=0).astype("<u2").tobytes()), pack(n[i:j].astype("<u4").tobytes())) for i, j in zip(edges, edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "steps", "counts"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                found = shingles(t) >> np.uint64(64 - COUNTER_BITS)
                if len(found):
                    held.append(found.astype(np.uint32))
                    size += len(found)
                if size >= FLUSH:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        for part, group in itertools.groupby(rows, key=lambda r: r[0]):
            total = np.zeros(PART, np.int64)
            for _, steps, counts in group:
                total[np.cumsum(np.frombuffer(unpack(steps), "<u2").astype(np.int64))] += np.frombuffer(unpack(counts), "<u4")
            logs = np.where(total > 0, np.rint(16 * np.log2(np.maximum(total, 1))) + 1, 0).astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([int(total.sum())], pa.int64()), pa.array([pack_logs(logs)], pa.binary())], names=["part", "total", "logs"])

    def pack_logs(logs: np.ndarray) -> bytes:
        import zstandard

        return zstandard.ZstdCompressor(level=1).compress(logs.astype("<u2").tobytes())

    import zstandard

    kept = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    parts = kept.mapInArrow(count, "part int, steps binary, counts binary").repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, total long, logs binary")
    table = np.zeros(COUNTERS // 2, np.uint8)
    found = parts.collect()  # COUNTERS / PART rows of bounded size
    half_mean = sum(r.total for r in found) / COUNTERS / 2
    for r in found:
        logs = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.logs)), "<u2").astype(float)
        level = np.clip(np.rint((logs - 1) / 8 - 2 * np.log2(max(1.0, half_mean))), 0, 15).astype(np.uint8)
        table[r.part * PART // 2 : (r.part + 1) * PART // 2] = level[::2] | (level[1::2] << 4)
    return table


def levels(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
    return (table[at >> 1] >> ((at & 1) << 2).astype(np.uint8)) & 15


def adaptive_prefix(hashes: np.ndarray, level: np.ndarray, share: int = SHARE, most: int = MOST) -> tuple[np.ndarray, int]:
    """(the first n - t + l shingles in order, l) of a set, with l of the least estimated cost.

    A prefix whose shingles have counts c costs the sum of c - 1 steps to match; of the documents
    matched at most that sum over l share l shingles, and to verify one costs as many steps as the set has
    shingles for one of the prefix.
    """
    order = np.sort((level.astype(np.uint64) << np.uint64(60)) | (hashes >> np.uint64(4)))
    n = len(order)
    t = least_overlap(n, share)
    lengths = np.arange(1, min(most, t) + 1)
    sizes = n - t + lengths
    postings = np.cumsum(2.0 ** ((order >> np.uint64(60)).astype(float) / 2) - 1)[sizes - 1]
    cost = postings * (1 + n / sizes / lengths)
    best = int(np.argmin(cost))
    return order[: sizes[best]], best + 1


def prefixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", share: int = SHARE) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, prefix, matches) of each row; set_key and prefix are null for an empty set."""
    sent = docs.sparkSession.sparkContext.broadcast(counters(docs, text))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            found = [adaptive_prefix(s, levels(s, sent.value), share) if len(s) else (None, None) for s in sets]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                    pa.array([None if p is None else p.view(np.int64) for p, _ in found], pa.list_(pa.int64())), pa.array([m for _, m in found], pa.int32()),
                ],
                names=["doc_id", "text_key", "n_shingles", "set_key", "prefix", "matches"],
            )

    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(f"`{text}`").cast("string").alias("whole"))
    return kept.mapInArrow(run, "doc_id long, text_key string, n_shingles long, set_key binary, prefix array<long>, matches int")


def _first(n: str, share: int) -> Column:
    """How long the prefix for one match is: n - t + 1."""
    return (F.col(n) - F.ceil(F.col(n) * share / 100) + 1).cast("int")


def _matched(pairs: DataFrame, near: DataFrame, share: int) -> DataFrame:
    """The pairs whose prefixes for the lesser number of matches share as many shingles."""
    side = lambda s: near.select(F.col("cid").alias({"x": "left", "y": "right"}[s]), F.struct("prefix", "matches", "n").alias(s))
    both = pairs.join(side("x"), "left").join(side("y"), "right")
    least = F.least("x.matches", "y.matches")
    part = lambda s: F.slice(f"{s}.prefix", 1, _first(f"{s}.n", share) + least - 1)
    return both.where(F.size(F.array_intersect(part("x"), part("y"))) >= least).select("left", "right")


def _verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    side = lambda s: sets.select(F.col("cid").alias({"x": "left", "y": "right"}[s]), F.col("hashes").alias(s))
    both = pairs.join(side("x"), "left").join(side("y"), "right")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= share * (F.size("x") + F.size("y") - shared)).select("left", "right")


def _ids(pairs: DataFrame, name: str) -> DataFrame:
    """(cid) of the classes in these pairs."""
    return cut(pairs.select(F.explode(F.array("left", "right")).alias("cid")).distinct(), name)


def _some(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of these classes, few of which are moved where the written ids are few."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "cid", "left_semi")


def _class_sets(classes: DataFrame, wanted: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(cid, hashes): the full sets of the wanted classes, from one text of each."""

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["cid", "hashes"])

    of = cut(_some(classes, wanted).select("cid", "rep", "text_key"), "asked")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("rep"), F.col(f"`{text}`").cast("string").alias("whole"))
    if wanted.count() <= BROADCAST_IDS:  # whole texts are shuffled by the join only where more are asked for
        rows, of = rows.join(F.broadcast(of.select("rep")), "rep", "left_semi"), F.broadcast(of)
    kept = rows.withColumn("text_key", text_key("whole")).join(of, ["rep", "text_key"])
    return kept.dropDuplicates(["rep", "text_key"]).select("cid", "whole").mapInArrow(hashed, "cid long, hashes array<long>")  # a class has one of each


def joined(docs: DataFrame, id_col: str = "doc_id", text: str = "text", share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    component_id is the least doc_id that links reach, the row's own included. Texts without words (null
    too) have no shingles and link with nothing. Rows that repeat keep their number and share
    their class. A row with a null id belongs to its class but never names it; if a class has null
    ids only, component_id is null. Other columns play no part.
    """
    base = cut(prefixed(docs, id_col, text, share), "prefixed")
    one = F.first(F.struct("prefix", "matches", F.col("n_shingles").alias("n"))).alias("p")
    of = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("of")
    classes = cut(base.where("set_key is not null").groupBy("set_key").agg(of, one, F.count("*").alias("rows")).select(F.monotonically_increasing_id().alias("cid"), "set_key", F.col("of.doc_id").alias("rep"), F.col("of.text_key").alias("text_key"), "p.*", "rows"), "classes")
    named = classes.where("rep is not null")
    postings = named.select(F.explode(F.slice("prefix", 1, _first("n", share))).alias("token"), "cid", "n")
    members = cut(postings.withColumn("c", F.count("*").over(Window.partitionBy("token"))).where("c > 1").drop("c"), "members")
    wanted = cut(members.select("cid").distinct(), "wanted")
    near = cut(_some(named, wanted).select("cid", "prefix", "matches", "n"), "near")
    close = lambda a, b: 100 * F.least(a, b) >= share * F.greatest(a, b)
    links, labels, left, sets = None, None, members, None
    for r in range(STARS):
        now = left.join(labels, "cid") if r else left.withColumn("comp", F.col("cid"))
        order = F.struct(F.xxhash64("cid", F.lit(r)) if r else F.lit(0), "cid", "comp", "n")
        hub = now.groupBy("token").agg(F.min(order).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token", F.col("hub.cid").alias("hub"), F.col("hub.comp").alias("hub_comp"), F.col("hub.n").alias("hub_n"))
        rest = cut(now.join(hub, "token").where("cid <> hub"), f"rest{r}")
        pairs = rest.where(F.col("comp") != F.col("hub_comp")).where(close("n", "hub_n")).select(F.least("cid", "hub").alias("left"), F.greatest("cid", "hub").alias("right")).distinct()
        live = cut(_matched(pairs, near, share), f"live{r}")
        asked = _ids(live, f"asked{r}")
        new = asked if sets is None else cut(asked.join(sets.select("cid"), "cid", "left_anti"), f"new{r}")
        made = cut(_class_sets(named, new, docs, id_col, text), f"sets{r}")
        sets = made if sets is None else sets.union(made)
        found = cut(_verified(live, _some(sets, asked), share), f"links{r}")
        links = found if links is None else links.union(found)
        labels = cut(wanted.join(components(links), "cid", "left").select("cid", F.coalesce("comp", "cid").alias("comp")), "labels")
        left = rest.select("token", "cid", "n")
    open_ = cut(_candidates(_dealt(left, labels, near), share), "open")
    asked = cut(open_.select("cid").distinct(), "asked")
    new = cut(asked.join(sets.select("cid"), "cid", "left_anti"), "new")
    sets = sets.union(cut(_class_sets(named, new, docs, id_col, text), "sets"))
    links = links.union(_closure(open_.join(_some(near, asked), "cid").join(_some(sets, asked), "cid"), share))
    final = components(links)
    least = final.join(classes.select("cid", "rep"), "cid").groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = final.join(least, "comp").select("cid", "component_id")
    own = classes.join(of, "cid", "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"), F.lit(None).cast("binary").alias("comp"), F.col("rows").alias("n"))
    return _told(base, cut(own, "named")).select("doc_id", "n_shingles", "component_id")


_KEY = ["token", "i", "j"]


def _dealt(members: DataFrame, labels: DataFrame, near: DataFrame) -> DataFrame:
    """Buckets that still hold several components, by block pairs (token, i, j): (cid, comp, own block, prefix, matches, n) of each member."""
    now = members.select("token", "cid").join(labels, "cid")
    several = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("token", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = now.join(several, "token").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cid", "comp", "own").join(near, "cid")


def _blocks(batches: Iterator) -> Iterator[tuple]:
    """(token, i, j, columns) of each block pair of a sorted stream, one at a time."""
    rows = (r for b in batches for r in zip(*[c.to_numpy(zero_copy_only=False) for c in b.columns]))
    for (token, i, j), group in itertools.groupby(rows, key=lambda r: r[:3]):
        yield int(token), int(i), int(j), list(zip(*group))[3:]


def _candidates(dealt: DataFrame, share: int) -> DataFrame:
    """(token, i, j, cid, comp, own) of the members that share enough of a prefix with one of another component; only these need their full sets."""
    schema = "token long, i int, j int, cid long, comp long, own int"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for token, i, j, (cid, comp, own, prefix, matches, n) in _blocks(batches):
            kept = sorted({x for pair in block_pairs(token, comp, own, prefix, matches, n, i != j, share) for x in pair})
            if kept:
                values = [[token] * len(kept), [i] * len(kept), [j] * len(kept), [int(cid[x]) for x in kept], [int(comp[x]) for x in kept], [int(own[x]) for x in kept]]
                types = pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=[*_KEY, "cid", "comp", "own"])

    kept = dealt.select(*_KEY, "cid", "comp", "own", "prefix", "matches", "n")
    return kept.repartition(*_KEY).sortWithinPartitions(*_KEY, "cid").mapInArrow(run, schema)


def _closure(dealt: DataFrame, share: int) -> DataFrame:
    """Links between components that still share a bucket, by block pairs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for token, i, j, (cid, comp, own, prefix, matches, n, hashes) in _blocks(batches):
            found = block_links(token, cid, comp, own, prefix, matches, n, hashes, i != j, share)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["left", "right"])

    kept = dealt.select(*_KEY, "cid", "comp", "own", "prefix", "matches", "n", "hashes")
    return kept.repartition(*_KEY).sortWithinPartitions(*_KEY, "cid").mapInArrow(run, "left long, right long")


def block_pairs(token: int, comp, own, prefixes, matches, n, across: bool, share: int, group: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Members a < b of different components and fitting sizes whose prefixes share enough shingles, each in the bucket of the first that both look for.

    Members that share shingles are found by the lists of the block's own prefixes. ``group`` numbers the components and may change meanwhile.
    """
    sizes, block, needs = np.asarray(n), np.asarray(own), np.asarray(matches)
    prefixes = [p.view(np.uint64) for p in prefixes]
    one = [int(m) - least_overlap(int(m), share) + 1 for m in sizes]
    if group is None:
        group = numbered(comp)
    flat = np.concatenate(prefixes)
    holder = np.repeat(np.arange(len(sizes)), [len(p) for p in prefixes])
    order = np.argsort(flat, kind="stable")
    flat, holder = flat[order], holder[order]
    first = np.int64(token).view(np.uint64)
    for a in range(len(sizes) - 1):
        lo, hi = np.searchsorted(flat, prefixes[a]), np.searchsorted(flat, prefixes[a], side="right")
        shared = np.bincount(np.concatenate([holder[x:y] for x, y in zip(lo, hi)]), minlength=len(sizes))
        rest = np.flatnonzero((shared >= np.minimum(needs, needs[a])) & (group != group[a]) & (100 * np.minimum(sizes, sizes[a]) >= share * np.maximum(sizes, sizes[a])))
        rest = rest[(rest > a) & ((block[rest] != block[a]) if across else True)]
        for b in rest.tolist():
            if group[a] == group[b]:
                continue
            low = min(int(needs[a]), int(needs[b]))
            if len(np.intersect1d(prefixes[a][: one[a] + low - 1], prefixes[b][: one[b] + low - 1], assume_unique=True)) < low:
                continue
            if np.intersect1d(prefixes[a][: one[a]], prefixes[b][: one[b]], assume_unique=True)[0] == first:
                yield a, b


def numbered(comp) -> np.ndarray:
    number: dict[int, int] = {}
    return np.array([number.setdefault(c, len(number)) for c in comp])


def block_links(token: int, cid, comp, own, prefixes, matches, n, sets, across: bool, share: int = SHARE) -> list[tuple[int, int]]:
    """The links that connect components within one block pair, a spanning forest of them."""
    group = numbered(comp)
    found: list[tuple[int, int]] = []
    for a, b in block_pairs(token, comp, own, prefixes, matches, n, across, share, group):
        if is_link(sets[a].view(np.uint64), sets[b].view(np.uint64), share):
            found.append((cid[a], cid[b]))
            group[group == group[b]] = group[a]
    return found
