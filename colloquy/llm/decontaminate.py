"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and runs of white space become one space. An item of n
characters may differ by k = n // ``CHARS_PER_EDIT`` edits. Cut into k + 1 pieces, at least one
piece of it stands unchanged in any passage within k edits, so exact piece hits (one
Aho-Corasick pass over a text for all items) find every such passage; the surroundings of a
hit are verified with Myers' bit-parallel edit distance, the pattern free to start and end
anywhere in the window.

The benchmark goes to the tasks in blocks of at most ``BLOCK_CHARS`` characters of items, so what
is broadcast stays bounded; a larger benchmark takes more passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS_PER_EDIT = 16
BLOCK_CHARS = 8_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(n: int) -> int:
    return n // CHARS_PER_EDIT


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece): the item cut into budget + 1 pieces of nearly equal length."""
    k = budget(len(item)) + 1
    cuts = [len(item) * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(pattern_bits: dict[str, int], n: int, text: str) -> tuple[int, int]:
    """(least distance of the n-character pattern to any part of text, end of that part).

    The vertical differences of one column of the edit matrix are kept as two big integers.
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    pos, neg, score = full, 0, n
    best, at = n, 0
    get = pattern_bits.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        x = eq | neg
        d0 = (((x & pos) + pos) ^ pos) | x
        up = neg | (full & ~(d0 | pos))
        down = pos & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full  # free start: the top row is zero
        down = (down << 1) & full
        pos = down | (full & ~(d0 | up))
        neg = up & d0
        if score < best:
            best, at = score, i
            if best == 0:
                break
    return best, at


def bits(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """All items of one block, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = items
        self.bits: dict[int, tuple[dict[str, int], dict[str, int]]] = {}
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(items):
            for offset, piece in pieces(text):
                at.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, start, end, distance) of the best passage of each item found."""
        windows: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for n, offset in where:
                m = len(self.items[n][1])
                k = budget(m)
                start = end + 1 - length - offset
                spot = [max(0, start - k), min(len(text), start + m + k)]
                seen = windows.setdefault(n, [])
                if seen and spot[0] <= seen[-1][0] + k:  # the same passage again
                    seen[-1] = [min(spot[0], seen[-1][0]), max(spot[1], seen[-1][1])]
                else:
                    seen.append(spot)
        out = []
        for n, spots in windows.items():
            item = self.items[n][1]
            best = None
            for a, b in spots:
                found = self.verify(n, item, text[a:b])
                if found and (best is None or found[2] < best[2]):
                    best = (a + found[0], a + found[1], found[2])
                    if best[2] == 0:
                        break
            if best:
                out.append((n, *best))
        return out

    def verify(self, n: int, item: str, window: str) -> tuple[int, int, int] | None:
        exact = window.find(item)
        if exact >= 0:
            return exact, exact + len(item), 0
        if n not in self.bits:
            self.bits[n] = (bits(item), bits(item[::-1]))
        distance, end = myers(self.bits[n][0], len(item), window)
        if distance > budget(len(item)):
            return None
        # backwards from the end, the same distance gives the start
        back, length = myers(self.bits[n][1], len(item), window[:end][::-1])
        return end - length, end, distance


def blocks(items: DataFrame, id_col: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items with their normal text, in blocks of bounded size."""
    block, size = [], 0
    kept = items.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("item"))
    for row in kept.where("id is not null and item is not null").toLocalIterator():
        item = normal(row[1])
        if not item:
            continue
        if block and size + len(item) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row[0], item))
        size += len(item)
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, distance, item_chars): the best passage of each item in each row of
    ``docs`` that holds it within its error budget; places are in the normal text.

    Null and empty texts and items match nothing. Repeated rows give repeated matches, repeated
    items too. An item shorter than ``CHARS_PER_EDIT`` has to stand exactly. Other columns play no part.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start long, end long, distance long, item_chars long"
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("whole"))
    out = None
    for block in blocks(items, id_col=item_id, text=item_text):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            matcher = Matcher(sent.value)
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for doc_id, whole in zip(ids, batch.column(1).to_pylist()):
                    for n, start, end, distance in matcher.search(normal(whole)):
                        rows.append((doc_id, matcher.items[n][0], start, end, distance, len(matcher.items[n][1])))
                columns = list(zip(*rows)) or [[]] * 6
                names = ["doc_id", "item_id", "start", "end", "distance", "item_chars"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)

        found = source.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a passage of an item within its budget; columns and
    other rows (null texts too) stay as they are. Each row is judged by its own text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    base = docs.select(row, F.col(f"`{text}`").cast("string").alias("whole"))
    spark = docs.sparkSession
    for block in blocks(items, item_id, item_text):
        sent = spark.sparkContext.broadcast(block)

        def clean(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            matcher = Matcher(sent.value)
            for batch in batches:
                keep = [not matcher.search(normal(t)) for t in batch.column(1).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        base = base.mapInArrow(clean, base.schema)
    return base.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
