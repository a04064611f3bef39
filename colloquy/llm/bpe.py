"""BPE encoding and decoding, unsplit stretches by tree concatenation.

Exactness rests on three facts about the byte-level tokenizer:

* Between a character that is no white space and a white-space character a token always
  ends, whatever stands around, so text may be cut there and the parts encoded alone.
* The tokenizer splits a text before it merges, and no token crosses such a split. What stands
  between two splits is an unsplit stretch. A split after a character that is no white space
  stays where it is when the text is cut there.
* A sequence of tokens is the encoding of one unsplit stretch if each neighbouring pair is
  what the encoder makes of the pair's own text. So halves of a stretch can be encoded
  apart: a window around the join is encoded anew, and grown until its outermost tokens
  are those of both sides; then every pair of the joined sequence stands in an encoding.

Every unsplit stretch of over ``STRETCH_CHARS`` code points is encoded by halves, down to pieces of at
most that length, and joined up a tree. Texts of over ``LONG_CHARS`` are dealt to several tasks in
parts; a stretch that itself is longer than a part is joined level by level, a pair at a time,
over the tasks.

Ids travel as little-endian unsigned 32-bit integers in one binary value.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.shared import cut

#: Longer unsplit stretches (code points) are encoded by halves.
STRETCH_CHARS = 24
#: Longer texts are encoded in parts on several tasks.
LONG_CHARS = 65_536
#: Length of such parts.
PART_CHARS = 16_384
CACHE_UNITS = 100_000
#: Longer words are not kept in the cache, so its size in bytes is bounded too.
CACHE_CHARS = 64
#: New words encoded by one call.
RUN_UNITS = 2_000
#: Texts whose words are held at once.
STEP_ROWS = 64


class Bpe:
    """A tokenizers file, used without truncation and padding, with a cache of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        # two generations: words that recur move on when the first is full, the others go
        self.cache: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        self.special = {t.content: i for i, t in self.lib.get_added_tokens_decoder().items()}
        self.bytes_of = token_bytes(path)
        self.lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.lengths[i] = len(b)

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The library's ids. Words recur, so each is encoded once and then looked up;
        texts with runs of white space, where a word's tokens depend on its neighbours, go whole."""
        if len(self.cache) > CACHE_UNITS:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        split = [t.split(" ") for t in texts]
        found = [list(map(cache.get, words[1:])) for words in split]
        missing: dict[str, None] = {}
        stale = []
        for n, (words, parts) in enumerate(zip(split, found)):
            if None in parts:
                stale.append(n)
                for w, p in zip(words[1:], parts):
                    if p is None:
                        if w in older:
                            cache[w] = older[w]
                        else:
                            missing[w] = None
        self._learn([w for w in missing if not _unsafe(w)])
        cache.update((w, UNSAFE) for w in missing if _unsafe(w))
        for n in stale:
            found[n] = list(map(cache.get, split[n][1:]))
        firsts = self.whole([words[0] for words in split])
        out: list[bytes] = []
        odd = [n for n, (words, parts) in enumerate(zip(split, found)) if UNSAFE in parts or (words[0] and _unsafe(words[0]))]
        whole = dict(zip(odd, self.whole([texts[n] for n in odd])))
        for n, (first, parts) in enumerate(zip(firsts, found)):
            out.append(whole[n] if n in whole else first + b"".join(parts))
        for w in missing:
            if len(w) > CACHE_CHARS:
                del cache[w]
        return out

    def _learn(self, words: list[str]) -> None:
        """Encodes new words, each after a space, many at a time: they can't merge with each
        other, and the tokens' lengths in bytes tell whose they are."""
        long = [w for w in words if len(w) >= STRETCH_CHARS]
        self.cache.update(zip(long, self.whole([" " + w for w in long])))
        short = [w for w in words if len(w) < STRETCH_CHARS]
        chunks = [[" " + w for w in short[i : i + RUN_UNITS]] for i in range(0, len(short), RUN_UNITS)]
        for chunk, ids in zip(chunks, self.library(["".join(c) for c in chunks])):
            ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
            stops = np.searchsorted(ends, np.cumsum([len(u.encode()) for u in chunk])) + 1
            at = 0
            for u, stop in zip(chunk, (stops * 4).tolist()):
                self.cache[u[1:]] = ids[at:stop]
                at = stop

    def whole(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, their long stretches by halves."""
        pieces: list[str] = []
        plans = []
        for t in texts:
            plan = []  # (first piece, number of pieces) of what has to be joined
            for group in self._groups(t):
                plan.append((len(pieces), len(group)))
                pieces += group
            plans.append(plan)
        ids = self.library(pieces)
        return [b"".join(self.joined(ids[at : at + n]) for at, n in plan) for plan in plans]

    def _groups(self, text: str) -> list[list[str]]:
        """The text in pieces: one alone, or the halves of a long stretch."""
        if not LONG_RUN.search(text):
            return [[text]]
        out: list[list[str]] = []
        for part in self._at_special(text):
            at = 0
            blank: list[int] = []  # splits within the white space before the stretch at hand
            for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(part):
                if b - a > STRETCH_CHARS:
                    # white space takes other splits at the end of a text, so what stands right before goes alone
                    cuts = [at, *[x for x in blank if x > at], a]
                    out += [[part[x:y]] for x, y in zip(cuts, cuts[1:]) if y > x]
                    out.append(_halves(part[a:b], STRETCH_CHARS))
                    at = b
                blank = [*blank, a] if part[a:b].isspace() else []
            if at < len(part):
                out.append([part[at:]])
        return out

    def parts(self, text: str, part_chars: int) -> list[tuple[int, str]]:
        """Cuts of a long text: (group, part). Parts of one group are pieces of one unsplit
        stretch and have to be joined; group -1 stands alone."""
        out: list[tuple[int, str]] = []
        group = 0
        for stretch in self._at_special(text):
            at = 0
            while at < len(stretch):
                end = at + part_chars
                if end >= len(stretch):
                    out.append((-1, stretch[at:]))
                    break
                cut = _safe_cut(stretch, at, end)
                if cut:
                    out.append((-1, stretch[at:cut]))
                    at = cut
                    continue
                stop = _safe_cut(stretch, end, len(stretch)) or _next_cut(stretch, end)
                for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(stretch[at:stop]):
                    if b - a <= part_chars:
                        out.append((-1, stretch[at + a : at + b]))
                    else:
                        out += [(group, x) for x in _halves(stretch[at + a : at + b], part_chars)]
                        group += 1
                at = stop
        return out

    def _at_special(self, text: str) -> list[str]:
        pieces = [text]
        for s in self.special:
            pieces = [y for x in pieces for y in ([x] if x in self.special else _keep_split(x, s))]
        return [p for p in pieces if p]

    def joined(self, parts: list[bytes]) -> bytes:
        """The encodings of one stretch's pieces, joined pair by pair up a tree."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""

    def join(self, left: bytes, right: bytes) -> bytes:
        a, b = np.frombuffer(left, "<u4").tolist(), np.frombuffer(right, "<u4").tolist()
        if not a or not b:
            return left + right
        size = 4
        while True:
            i, j = max(0, len(a) - size), min(len(b), size)
            while i > 0 and not self._starts(a[i]):
                i -= 1
            while j < len(b) and not self._starts(b[j]):
                j += 1
            text = b"".join(self.bytes_of[x] for x in a[i:] + b[:j]).decode("utf-8")
            window = np.frombuffer(self.library([text])[0], "<u4").tolist()
            if (i == 0 or window[:2] == a[i : i + 2]) and (j == len(b) or window[-2:] == b[max(0, j - 2) : j]):
                return np.asarray(a[:i] + window + b[j:], dtype="<u4").tobytes()
            size *= 2

    def _starts(self, token: int) -> bool:
        return self.bytes_of[token][0] & 0xC0 != 0x80


#: So many characters that no class change need split.
LONG_RUN = re.compile(r"\S{%d,}|\s{%d,}" % (STRETCH_CHARS, STRETCH_CHARS))
#: Mark of words whose tokens depend on what stands beside them.
UNSAFE = b""


def _unsafe(word: str) -> bool:
    return not word or word[0].isspace() or word[-1].isspace()


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


def _keep_split(text: str, sep: str) -> list[str]:
    out: list[str] = []
    for n, piece in enumerate(text.split(sep)):
        out += [sep, piece] if n else [piece]
    return out


def _safe_cut(text: str, low: int, high: int) -> int:
    """The last place in (low, high) where a space follows other text, or 0."""
    at = text.rfind(" ", low + 1, high)
    while at > low and text[at - 1].isspace():
        at = text.rfind(" ", low + 1, at)
    return at if at > low else 0


def _next_cut(text: str, low: int) -> int:
    at = text.find(" ", low)
    while at > 0 and text[at - 1].isspace():
        at = text.find(" ", at + 1)
    return at if at > 0 else len(text)


def _halves(text: str, part_chars: int) -> list[str]:
    if len(text) <= part_chars:
        return [text]
    mid = len(text) // 2
    return _halves(text[:mid], part_chars) + _halves(text[mid:], part_chars)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each id; added tokens stand for their own text."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    to_byte = {c: b for b, c in _byte_chars().items()}
    added = {t["id"]: t["content"].encode() for t in said["added_tokens"]}
    return {i: bytes(map(to_byte.__getitem__, token)) for token, i in said["model"]["vocab"].items() if i not in added} | added


def text_of(ids: bytes, path: str) -> str:
    get = token_bytes(path).get
    return b"".join([get(i, b"") for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", to: str = "token_ids", long_chars: int = LONG_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """``docs`` with the binary column ``to``: the ids of the whole column ``text``.

    A null or empty text has no ids. Rows may repeat and keep their number; other columns
    pass unchanged (a column named as ``to`` is replaced). Texts over ``long_chars`` are
    encoded once for all their copies, in parts over several tasks, then joined by text.
    """
    path = path or default_path()
    docs = docs.drop(to)
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    base = docs.select(row, whole.alias("whole"))
    is_long = F.length("whole") > long_chars

    schema = T.StructType([T.StructField("row", base.schema["row"].dataType), T.StructField("ids", T.BinaryType())])

    def short_ids(batches: Iterator) -> Iterator:
        import pyarrow as pa

        b = bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                ids = b.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["row", "ids"])

    short = base.where(~is_long).mapInArrow(short_ids, schema)

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = bpe(path)
        for pdf in batches:
            for key, t in zip(pdf.key, pdf.whole):
                parts = b.parts(t, part_chars)
                at, last = [], {}  # a part's place among those of its group
                for g, _ in parts:
                    at.append(last.get(g, -1) + 1)
                    last[g] = at[-1]
                yield pd.DataFrame({"key": key, "seq": range(len(parts)), "grp": [g for g, _ in parts], "at": at, "part": [p for _, p in parts]})

    def part_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = bpe(path)
        for pdf in batches:
            yield pd.DataFrame({"key": pdf.key, "seq": pdf.seq, "grp": pdf.grp, "at": pdf["at"], "ids": b.encode(pdf.part.tolist())})

    def join_two(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pd.DataFrame({"key": pdf.key.iloc[:1], "grp": pdf.grp.iloc[:1], "at": pdf["at"].iloc[:1] // 2, "seq": pdf.seq.iloc[:1], "ids": [bpe(path).joined(pdf.ids.tolist())]})

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": pdf.key.iloc[:1], "ids": [b"".join(pdf.sort_values("seq").ids)]})

    long = base.where(is_long).withColumn("key", F.sha2("whole", 256))
    parts = cut(
        long.select("key", "whole").dropDuplicates(["key"])
        .mapInPandas(cuts, "key string, seq long, grp long, at long, part string")
        .repartition("key", "seq")
        .mapInPandas(part_ids, "key string, seq long, grp long, at long, ids binary"),
        "parts",
    )
    runs = parts.where("grp >= 0").select("key", "grp", "at", "seq", "ids")
    most = runs.agg(F.max("at")).first()[0] or 0
    while most > 0:
        runs = runs.withColumn("pair", F.expr("at div 2")).groupBy("key", "grp", "pair").applyInPandas(lambda pdf: join_two(pdf.drop(columns="pair")), "key string, grp long, at long, seq long, ids binary")
        most //= 2
    ids = parts.where("grp < 0").select("key", "seq", "ids").unionByName(runs.select("key", "seq", "ids")).groupBy("key").applyInPandas(in_order, "key string, ids binary")
    both = short.unionByName(long.select("row", "key").join(ids, "key").select("row", "ids"))
    return both.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("ids").alias(to))


def decode(tokens: DataFrame, path: str | None = None, ids: str = "token_ids", to: str = "text") -> DataFrame:
    """``tokens`` with the string column ``to``: the text of the ids, special tokens kept.

    Null ids give an empty text; bytes that are no UTF-8 become U+FFFD, as in the library.
    """
    path = path or default_path()

    @F.pandas_udf(T.StringType())
    def texts(column: pd.Series) -> pd.Series:
        return column.map(lambda x: text_of(x or b"", path))

    return tokens.withColumn(to, texts(F.col(f"`{ids}`")))
