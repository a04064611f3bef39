"""Lempel-Ziv phrase fingerprints of documents.

A text's UTF-8 bytes are parsed into phrases: the longest phrase known so far and one byte
more. The set of phrases is what a compressor of this kind would learn from the text; the
share of phrases two texts have in common tells how well one would compress the other. The
set is hashed and its ``KEPT`` least hashes are the fingerprint (all, if there are fewer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.shared import cut

KEPT = 64
#: Bytes of text in each range that :func:`with_next` deals out, about; more ranges where Spark shuffles to more partitions.
PART_BYTES = 64 << 20


def parse(data: bytes, known: dict[bytes, None] | None = None, at: int = 0) -> dict[bytes, None]:
    """The phrases of the parse, in order; it goes on at ``at`` with those known so far.

    Each phrase's beginnings are phrases too, so the longest known phrase at a place is found
    from a guessed length by steps up or down.
    """
    known = {} if known is None else known
    n, size = len(data), 5
    while at < n:
        end = at + size
        if data[at:end] in known:
            end += 1
            while data[at:end] in known and end <= n:
                end += 1
        else:
            end -= 1
            while end > at and data[at:end] not in known:
                end -= 1
            end += 1
        known[data[at:end]] = None
        size = end - at
        at = end
    return known


def phrases(data: bytes) -> set[bytes]:
    return set(parse(data))


def hashes(found: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh32_intdigest, found), np.uint32, len(found))


def fingerprint(text: str | None) -> np.ndarray:
    """The least hashes of the phrases, ascending; empty for an empty text."""
    return least(hashes(list(parse((text or "").encode()))))


def least(all_: np.ndarray) -> np.ndarray:
    return np.unique(all_)[:KEPT]


class Parsed:
    """A text's parse, kept for texts that begin alike."""

    def __init__(self, text: str):
        self.data = text.encode()
        self.order = list(parse(self.data))
        self.hashes = hashes(self.order)
        self.fingerprint = least(self.hashes)

    def changed_after(self, keep: int, text: str) -> np.ndarray:
        """The fingerprint of ``text``, whose first ``keep`` bytes are this text's: the phrases that
        end within them are the same, and the parse goes on from there."""
        ends = np.cumsum([len(p) for p in self.order])
        # all but the last are phrases of the parse; the last may be cut off by the text's end
        same = min(int(np.searchsorted(ends, keep, side="right")), max(0, len(self.order) - 1))
        at = int(ends[same - 1]) if same else 0
        known = dict.fromkeys(self.order[:same])
        found = list(parse(text.encode(), known, at))
        return least(np.concatenate((self.hashes[:same], hashes(found[same:]))))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases, 0 to 1: of the least hashes of both, those in both.

    Two empty fingerprints are alike (1), one empty and one not are unlike (0).
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    same = both[1:] == both[:-1]
    lowest = both[np.concatenate(([True], ~same))][:KEPT]
    shared = both[1:][same]
    return int((shared <= lowest[-1]).sum()) / len(lowest)


def written(fp: np.ndarray) -> str:
    return fp.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """``docs`` with the column ``to``: the fingerprint as hexadecimal text, eight digits a hash.

    Null and empty texts have an empty one; equal texts have equal ones; rows stay.
    """
    @F.pandas_udf(T.StringType())
    def made(column: pd.Series) -> pd.Series:
        return column.map(lambda t: written(fingerprint(t)))

    return docs.withColumn(to, made(F.col(f"`{text}`").cast("string")))


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, place, at, doc_id, text), in partitions by part, such that each row's next row in its
    part, by place and at, is the next document in ascending order, after the last the first.

    Order is by ``at``: the id (null as the least number), then a hash of the text, so rows that
    repeat an id, or have none, are dealt out too. Spark ranges the rows by it; the first
    row of each range stands also at the end of the range before it (place 1). What comes to
    the driver is one value a range, as many as tasks.
    """
    least_id = F.lit(-(1 << 63))
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    base = base.withColumn("at", F.concat(digits(F.coalesce("doc_id", least_id).bitwiseXOR(least_id)), digits(F.xxhash64("text"))))
    keys = cut(base.select("at", F.octet_length("text").alias("n")), "keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    ranged = keys.select("at").repartitionByRange(parts, "at").withColumn("part", F.spark_partition_id())
    firsts = sorted(r["at"] for r in ranged.groupBy("part").agg(F.min("at").alias("at")).collect())
    sent = docs.sparkSession.sparkContext.broadcast(np.array(firsts or ["0" * 32], "S32"))

    @F.pandas_udf("array<struct<part:int,place:int>>")
    def ranges(at: pd.Series) -> pd.Series:
        edges = sent.value
        x = at.to_numpy().astype("S32")
        part = np.maximum(np.searchsorted(edges, x, side="right") - 1, 0)
        before = np.where(edges[part] == x, (part - 1) % len(edges), -1)
        return pd.Series([[(p, 0)] if b < 0 else [(p, 0), (b, 1)] for p, b in zip(part.tolist(), before.tolist())])

    both = base.withColumn("x", F.explode(ranges("at"))).select("x.part", "x.place", "at", "doc_id", "text")
    return both.repartitionById(len(sent.value), F.col("part"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    ``edited`` is the text whose last floor(n_chars / 2) code points are replaced by the first as
    many (or all) of the next document, in ascending order of doc_id (of equal ids by a hash of
    the text; null ids first), after the last the first; a single document is its own next.
    Null texts are empty. Other columns play no part.
    """
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ordered = with_next(docs, id_col, text).sortWithinPartitions("part", "place", "at", "text")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last = None
        for batch in batches:
            rows = []
            for part, place, _, doc_id, whole in zip(*[c.to_pylist() for c in batch.columns]):
                fp = Parsed(whole)
                if last is not None and last[0] == part and last[1] == 0:
                    rows.append(_compared(last[2], last[3], last[4], whole, fp))
                last = (part, place, doc_id, whole, fp)
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.mapInArrow(compare, schema)


def _compared(doc_id, whole: str, own: Parsed, after: str, other: Parsed) -> tuple:
    n = len(whole)
    half = n // 2
    kept = whole[: n - half]
    edited = kept + after[:half]
    changed = own.changed_after(len(kept.encode()), edited)
    fp = own.fingerprint
    return doc_id, n, edited, written(fp), written(changed), likeness(fp, changed), likeness(fp, other.fingerprint)
