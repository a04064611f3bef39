"""Fill-in-middle documents by a piecewise-linear learned index of line boundaries.

A document is cut into lines; a cut after r lines needs the code point where line r ends. The
offsets of all boundaries (rank 0 is offset 0) are indexed once:

1. Segments: from a segment's first boundary a cone of slopes is narrowed by each next boundary
   until no slope keeps within ``ERROR`` code points of all; there the next segment starts. A
   segment is its first rank, its first offset and a slope.
2. Residuals: what each boundary lies beside its segment's rounded prediction, within ``ERROR`` + 1, one
   small integer a boundary.

A lookup finds the segment of a rank, predicts the offset and adds the residual, which makes it
exact. The index of a document takes some bytes a segment and two a line instead of eight;
:func:`boundary_index` returns it for documents that are cut again and again (other seeds, other
rates), and :func:`cuts` takes the same steps for one cut.

Texts stay in Spark: Python gets a text and two numbers and returns where to cut; outputs and
the way back are built-in functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points that a segment's line may miss a boundary by.
ERROR = 64
#: Boundaries that a cone is narrowed by at once.
STRIDE = 256
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7


class RankIndex(NamedTuple):
    """Segments (first rank, first offset, slope) and the residual of each rank."""

    starts: np.ndarray
    offsets: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    def predict(self, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.starts, rank, side="right") - 1
        return np.rint(self.offsets[at] + self.slopes[at] * (rank - self.starts[at])).astype(np.int64)

    def exact(self, rank) -> np.ndarray:
        rank = np.asarray(rank, np.int64)
        return self.predict(rank) + self.residuals[rank]


def boundaries(text: str) -> np.ndarray:
    """Offsets in code points of the start and of each line's end; a line holds its line feed."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = np.flatnonzero(points == 10) + 1
    last = [] if not len(points) or points[-1] == 10 else [len(points)]
    return np.concatenate(([0], ends, last)).astype(np.int64)


def fit(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    """The index of rising ``offsets`` by their ranks, with segments as long as a cone allows."""
    starts, slopes = [0], []
    at, n = 0, len(offsets)
    while True:
        low, high, k, end = -np.inf, np.inf, at + 1, n
        while k < n:
            y = offsets[k : k + STRIDE] - offsets[at]
            x = np.arange(k - at, k - at + len(y))
            lows = np.maximum(np.maximum.accumulate((y - error) / x), low)
            highs = np.minimum(np.minimum.accumulate((y + error) / x), high)
            bad = np.flatnonzero(lows > highs)
            good = int(bad[0]) if len(bad) else len(y)
            if good:
                low, high = lows[good - 1], highs[good - 1]
            if len(bad):
                end = k + good
                break
            k += len(y)
        slopes.append((low + high) / 2 if high < np.inf else 0.0)
        if end == n:
            break
        starts.append(end)
        at = end
    first = np.array(starts, np.int64)
    rough = RankIndex(first, offsets[first], np.array(slopes), np.empty(0, np.int16))
    left = offsets - rough.predict(np.arange(n))
    return rough._replace(residuals=left.astype(np.int16))


def boundary_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", error: int = ERROR) -> DataFrame:
    """(doc_id, n, starts, offsets, slopes, residuals): the learned index of each row's line boundaries.

    residuals are 16-bit little-endian integers, one for each rank 0 to n, which limits ``error`` to 32,000.
    """
    if not 0 < error <= 32_000:
        raise ValueError("residuals of 16 bits hold errors of 1 to 32,000")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [fit(boundaries(t or ""), error) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(x.residuals) - 1 for x in found], pa.int64()),
                    pa.array([x.starts for x in found], pa.list_(pa.int64())), pa.array([x.offsets for x in found], pa.list_(pa.int64())),
                    pa.array([x.slopes for x in found], pa.list_(pa.float64())), pa.array([x.residuals.astype("<i2").tobytes() for x in found], pa.binary()),
                ],
                names=["doc_id", "n", "starts", "offsets", "slopes", "residuals"],
            )

    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n long, starts array<long>, offsets array<long>, slopes array<double>, residuals binary")


def cuts(text: str, first: int, second: int) -> tuple[int, int, int]:
    """(lines, code points before the first cut, code points between the cuts) of one text."""
    index = fit(boundaries(text))
    n = len(index.residuals) - 1
    a, b = index.exact(sorted((first % (n + 1), second % (n + 1)))).tolist()
    return n, a, b - a


def _cuts(text: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cuts(t, int(a), int(b)) for t, a, b in zip(text, first, second)], columns=["n", "prefix_chars", "middle_chars"])


def _numbers(id_: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits for each id; a missing id counts as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = 100, spm: int = 50) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) of each row.

    ``rate`` percent of the rows are cut at two line boundaries drawn by a hash of seed and id and
    written with sentinels, ``spm`` percent of those suffix first. The others stay plain, as do
    empty texts (null too) and texts that hold a sentinel; their cuts are null, but n counts their
    lines. Rows stand for themselves: repeated rows repeat their result, and other columns play no
    part. Texts are cut whole, however long; a text without line feeds is one line.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    id_ = F.col(f"`{id_col}`").cast("long")
    h1, h2, h3, h4 = _numbers(id_, seed)
    rows = docs.select(id_.alias("doc_id"), whole.alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    where = F.pandas_udf(_cuts, "n long, prefix_chars long, middle_chars long")
    cut = rows.withColumn("cut", where("text", "h1", "h2")).select("doc_id", "text", "cut.*", "h3", "h4")
    plain = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE) | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    cut = cut.withColumn("form", form)
    size = lambda c: F.when(F.col("form") != "plain", F.col(c))
    at = lambda c: F.col(c).cast("int")
    prefix = F.substring("text", F.lit(1), at("prefix_chars"))
    middle = F.substring("text", at("prefix_chars") + 1, at("middle_chars"))
    suffix = F.substring("text", at("prefix_chars") + at("middle_chars") + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_ = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_)
    return cut.select("doc_id", "text", "n", "form", size("prefix_chars").alias("prefix_chars"), size("middle_chars").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text behind an output of a form: its parts stand between sentinels, which they never hold."""
    width = len(PREFIX)
    second = F.when(form == "psm", F.locate(SUFFIX, output)).otherwise(F.locate(PREFIX, output))
    third = F.locate(MIDDLE, output)
    one = F.substring(output, F.lit(width + 1), second - (width + 1))
    two = F.substring(output, second + width, third - second - width)
    three = F.substring(output, third + width, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))
