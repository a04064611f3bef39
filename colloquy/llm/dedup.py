"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

A document is the set of its distinct five-word shingles (hashed to 64 bits). Documents with
equal sets form a class and count as one from there on, so thousands of exact copies cost one.

1. Signatures: ``BANDS * ROWS`` minimum hashes of each class. Two sets of similarity 0.85 share
   no band with probability (1 - 0.85^5)^25 < 5e-7, two of 0.8 with less than 6e-5.
2. Star rounds: in each bucket (band, band value) that still holds several components, the
   least member (in the next round one drawn by hash) is paired with every other member and
   then leaves the bucket, so pairs grow with the members and not with their square, and no
   pair is judged twice. Pairs are compared batch by batch of the signature: with a uniform
   prior the similarity after m agreements in n hashes is Beta(m + 1, n - m + 1); a pair goes
   when the chance that it reaches the threshold is under ``MISS``. Survivors are verified on
   their full shingle sets.
3. Closure: buckets whose remaining members are still of several components are dealt to
   tasks by block pairs of at most 2 * ``BLOCK`` members, which compare all pairs of different
   components in the same way and return only the links that connect. Nothing is capped:
   a bucket of any size is covered by its block pairs. A task reads its block pairs as one
   sorted stream and holds one of them at a time.

Components come from the links by repeatedly hooking to the least neighbour and shortening.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import cut

WORDS = 5
#: Link when 100 * intersection >= share * union.
SHARE = 85
BANDS, ROWS = 25, 5
BATCH = 25
MISS = 1e-6
BLOCK = 256
STARS = 2
#: Classes with over this part of all rows are broadcast; there are fewer than this many.
HOT = 1000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's five-word shingles; empty without words."""
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
    for k in range(1, WORDS):  # a polynomial of the words' hashes, mixed
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + w[k : n + k]
    acc = _mix(acc)
    return np.unique(acc)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _lanes() -> np.ndarray:
    return _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(h: np.ndarray) -> np.ndarray:
    """The least of each lane's products; the hashes are random, so odd factors reorder them."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        least = np.minimum(least, np.multiply.outer(_lanes(), h[at : at + 1024]).min(axis=1))
    return (_mix(least) >> np.uint64(32)).astype("<u4")


@lru_cache(maxsize=4)
def least_agreements(share: float, miss: float) -> list[int]:
    """For each number of batches compared, the agreements below which a pair is given up.

    P(similarity >= share | m of n agree) under Beta(m + 1, n - m + 1) equals the chance of at
    most m successes in n + 1 trials of chance share, so no numerical integral is needed.
    """
    from math import comb

    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * share**m * (1 - share) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return out


def survivors(x: np.ndarray, y: np.ndarray, share: int = SHARE, miss: float = MISS) -> np.ndarray:
    """Indices of the signature pairs (rows of x and y) that no batch rules out."""
    alive, agreed = np.arange(len(x)), np.zeros(len(x), np.int32)
    for k, least in enumerate(least_agreements(share / 100, miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        agreed = agreed + (x[alive, part] == y[alive, part]).sum(axis=1)
        keep = agreed >= least
        alive, agreed = alive[keep], agreed[keep]
    return alive


def is_link(a: np.ndarray, b: np.ndarray, share: int = SHARE) -> bool:
    low, high = sorted((len(a), len(b)))
    if not low or 100 * low < share * high:
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= share * (low + high - shared)


def _key(h: np.ndarray) -> bytes | None:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None


def signed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, sig) of each row; set_key is null for an empty set."""

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "text_key", "n_shingles", "set_key", "sig"],
            )

    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(f"`{text}`").cast("string").alias("whole"))
    return kept.mapInArrow(sign, "doc_id long, text_key string, n_shingles long, set_key binary, sig binary")


def text_key(text: str):
    return F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256)


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (left, right class numbers) whose full sets are similar enough."""

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.frombuffer(b"".join(pdf.x), "<u4").reshape(len(pdf), -1)
                y = np.frombuffer(b"".join(pdf.y), "<u4").reshape(len(pdf), -1)
                yield pdf.iloc[survivors(x, y, share)][["left", "right"]]

    sig = classes.select("cid", "sig")
    both = (
        pairs.join(sig.select(F.col("cid").alias("left"), F.col("sig").alias("x")), "left")
        .join(sig.select(F.col("cid").alias("right"), F.col("sig").alias("y")), "right")
        .select("left", "right", "x", "y")
    )
    live = both.mapInPandas(prune, "left binary, right binary")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [is_link(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), share) for a, b in zip(pdf.a, pdf.b)]
            yield pdf[["left", "right"]][keep]

    full = (
        live.join(sets.select(F.col("cid").alias("left"), F.col("hashes").alias("a")), "left")
        .join(sets.select(F.col("cid").alias("right"), F.col("hashes").alias("b")), "right")
        .select("left", "right", "a", "b")
    )
    return full.mapInPandas(exact, "left binary, right binary")


def _class_sets(classes: DataFrame, wanted: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(cid, hashes): the full shingle sets of the wanted classes, from one text of each."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"cid": pdf.cid, "hashes": [shingles(t).tobytes() for t in pdf.whole]})

    kept = docs.select(text_key(text).alias("text_key"), F.col(f"`{id_col}`").cast("long").alias("rep"), F.col(f"`{text}`").cast("string").alias("whole"))
    of = classes.join(wanted, "cid", "left_semi").select("cid", "rep", "text_key")
    return kept.join(of, ["rep", "text_key"]).select("cid", "whole").dropDuplicates(["cid"]).mapInPandas(hashed, "cid binary, hashes binary")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(cid, comp): each node of ``links`` with the least node it reaches.

    Every round a node takes the least label among itself and its neighbours and then its
    label's label, so long chains shorten; rounds end when nothing changes.
    """
    both = cut(links.select("left", "right").union(links.select("right", "left")).distinct(), f"{name}-links")
    labels = cut(both.groupBy(F.col("left").alias("cid")).agg(F.min("right").alias("least")).select("cid", F.least("cid", "least").alias("comp")), name)
    while True:
        near = both.join(labels.select(F.col("cid").alias("right"), "comp"), "right").groupBy(F.col("left").alias("cid")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "cid").select("cid", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = step.select(F.col("cid").alias("comp"), F.col("comp").alias("up"))
        new = cut(step.join(jump, "comp", "left").select("cid", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")), name)
        labels = new.select("cid", "comp")
        if new.where("old <> comp").isEmpty():
            return labels


def grouped(docs: DataFrame, id_col: str = "doc_id", text: str = "text", share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key, comp) for every row of ``docs``.

    component_id is the least doc_id that links reach, the row's own included; kept says that
    it is the row's own. comp names the group itself (two groups may be reached by one id that
    has several texts); it is null without shingles. Texts without words (null too) have no
    shingles and link with nothing. Rows that repeat keep their number and share their class. A
    row with a null id belongs to its class but never names it; if a class has null ids only,
    component_id is null and kept is false. Other columns play no part.
    """
    base = cut(signed(docs, id_col, text), "signed")
    classes = cut(base.where("set_key is not null").groupBy(F.col("set_key").alias("cid")).agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("of"), F.first("sig").alias("sig"), F.count("*").alias("n")).select("cid", F.col("of.doc_id").alias("rep"), F.col("of.text_key").alias("text_key"), "sig", "n"), "classes")
    named_classes = classes.where("rep is not null")
    size = ROWS * 4
    bands = named_classes.select("cid", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * size + 1, F.lit(size))))).alias("band", "value"))
    many = bands.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(bands.join(many, ["band", "value"]).select(F.xxhash64("band", "value").alias("bucket"), F.col("band").cast("int").alias("band"), "cid"), "members")
    wanted = members.select("cid").distinct()
    near = cut(_class_sets(named_classes, wanted, docs, id_col, text).join(named_classes.select("cid", "sig"), "cid"), "sets")
    links, labels, left = None, None, members
    for r in range(STARS):
        now = left.join(labels, "cid").select("bucket", "band", "cid", "comp") if r else left.withColumn("comp", F.col("cid"))
        order = F.struct(F.xxhash64("cid", F.lit(r)), F.col("cid"), F.col("comp")) if r else F.struct(F.lit(0), F.col("cid"), F.col("comp"))
        hub = now.groupBy("bucket").agg(F.min(order).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket", F.col("hub.cid").alias("hub"), F.col("hub.comp").alias("hub_comp"))
        rest = cut(now.join(hub, "bucket").where("cid <> hub").select("bucket", "band", "cid", "comp", "hub", "hub_comp"), f"rest{r}")
        pairs = rest.where("comp <> hub_comp").select(F.least("cid", "hub").alias("left"), F.greatest("cid", "hub").alias("right")).distinct()
        found = cut(_verified(pairs, near.select("cid", "sig"), near.select("cid", "hashes"), share), f"links{r}")
        links = found if links is None else links.union(found)
        labels = cut(wanted.join(components(links), "cid", "left").select("cid", F.coalesce("comp", "cid").alias("comp")), "labels")
        left = rest.select("bucket", "band", "cid")
    links = links.union(_closure(left, labels, near, share))
    final = components(links)
    least = final.join(classes.select("cid", "rep"), "cid").groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = final.join(least, "comp").select("cid", "comp", "component_id")
    own = classes.join(of, "cid", "left").select(F.col("cid").alias("set_key"), F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("comp", "cid").alias("comp"), "n")
    return _told(base, cut(own, "named")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _told(base: DataFrame, named: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_key, comp) of each row from its class.

    Classes with over a ``HOT``-th of all rows each are fewer than ``HOT``, so they are
    broadcast; the other rows are joined by key, none of which holds many; rows without
    shingles need no join.
    """
    columns = ["doc_id", "n_shingles", "component_id", "text_key", "comp"]
    rows = base.select("doc_id", "n_shingles", "text_key", "set_key")
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = named.where(F.col("n") > total / HOT).drop("n")
    rest = rows.where("set_key is not null").join(F.broadcast(hot.select("set_key")), "set_key", "left_anti")
    empty = rows.where("set_key is null").withColumn("component_id", F.col("doc_id")).withColumn("comp", F.lit(None).cast("binary"))
    frequent = rows.join(F.broadcast(hot), "set_key")
    return frequent.select(*columns).unionByName(rest.join(named.drop("n"), "set_key").select(*columns)).unionByName(empty.select(*columns))


def _closure(members: DataFrame, labels: DataFrame, near: DataFrame, share: int) -> DataFrame:
    """Links between components that still share a bucket, by block pairs."""
    now = members.join(labels, "cid")
    open_ = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    left = now.join(open_, "bucket").select("bucket", "band", "blocks", "cid", "comp")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = (
        left.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "band", "cid", "comp", "own")
        .join(near, "cid")
        .select("bucket", "i", "j", "cid", "comp", "own", "band", "sig", "hashes")
    )
    n = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        for (_, i, j), group in itertools.groupby(rows, key=lambda r: r[:3]):
            _, _, _, cid, comp, own, band, sig, hashes = zip(*group)
            found = block_links(cid, comp, own, band[0], sig, hashes, i != j, share)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], names=["left", "right"])

    return dealt.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "cid").mapInArrow(run, "left binary, right binary")


def block_links(cid: tuple, comp: tuple, own: tuple, band: int, sig: tuple, hashes: tuple, across: bool, share: int = SHARE) -> list[tuple[bytes, bytes]]:
    """The links that connect components within one block pair, a spanning forest of them."""
    signs = np.frombuffer(b"".join(sig), "<u4").reshape(len(cid), -1)
    sets = [np.frombuffer(h, np.uint64) for h in hashes]
    block = np.asarray(own)
    number: dict[bytes, int] = {}
    group = np.array([number.setdefault(c, len(number)) for c in comp])
    found: list[tuple[bytes, bytes]] = []
    for a in range(len(cid) - 1):
        rest = np.arange(a + 1, len(cid))
        rest = rest[(group[rest] != group[a]) & ((block[rest] != block[a]) if across else True)]
        if not len(rest):
            continue
        alive = rest[survivors(np.broadcast_to(signs[a], (len(rest), signs.shape[1])), signs[rest], share)]
        # a pair that shares an earlier band is compared in that band's bucket
        same = (signs[alive] == signs[a]).reshape(len(alive), BANDS, ROWS).all(axis=2)
        alive = alive[same[:, :band].sum(axis=1) == 0]
        for b in alive.tolist():
            if group[a] != group[b] and is_link(sets[a], sets[b], share):
                found.append((cid[a], cid[b]))
                group[group == group[b]] = group[a]
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; see :func:`grouped`."""
    return grouped(docs, id_col, text, share).select("doc_id", "n_shingles", "component_id", "kept")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", share: int = SHARE) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one whose id names it.

    Of rows that repeat that id within the group one stays, that of the least text hash. Rows
    without words (null texts too) and rows of groups that no id names stay, as do all columns.
    """
    found = grouped(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")), id_col, text, share)
    linked = found.where("comp is not null")
    keep = linked.where("kept").groupBy("comp").agg(F.min(F.struct("component_id", "text_key")).alias("of")).select("of.component_id", "of.text_key").distinct()
    nameless = linked.where("component_id is null").select("text_key").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(f"`{id_col}`").cast("long").alias("component_id"), text_key(text).alias("text_key"), F.col(f"`{text}`").cast("string").alias("whole"))
    wordless = ~F.coalesce(F.rlike("whole", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    worded = keyed.where(~wordless)
    one = worded.where("component_id is not null").join(keep, ["component_id", "text_key"], "left_semi").dropDuplicates(["component_id", "text_key"])
    free = worded.where("component_id is null").join(nameless, "text_key", "left_semi")
    return one.select(*columns).unionByName(free.select(*columns)).unionByName(keyed.where(wordless).select(*columns))
