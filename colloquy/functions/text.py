"""Scalar text functions, as column expressions where Spark has the parts."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
#: Personal data by category, in the order in which a place is told to be one of them. Numbers stand
#: alone, no digit beside them: an identity number of 18 with X or a digit last, a bank card of 16 to 19 not from 0, a mobile
#: number of 11 from 13 to 19 or a landline with its area code, an address of four numbers to 255.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "id_card": r"(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])",
    "bank_card": r"(?<![0-9])[1-9][0-9]{15,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:1[3-9][0-9]{9}|0[0-9]{2,3}-?[0-9]{7,8})(?![0-9])",
    "ipv4": rf"(?<![0-9]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])",
}
ANY_PII = "|".join(f"(?:{p})" for p in PII.values())
#: Every category holds one of these, so other texts need no search.
MAY_HOLD = r"@|[0-9]{7}|[0-9]\.[0-9]"


def _category(hit: Column) -> Column:
    out = F.when(F.contains(hit, F.lit("@")), "email").when(F.contains(hit, F.lit(".")), "ipv4").when(F.rlike(hit, F.lit("^[0-9]{17}[0-9Xx]$")), "id_card")
    return out.when(F.rlike(hit, F.lit("^[1-9][0-9]{15,18}$")), "bank_card").otherwise("phone")


def _masked(hit: Column) -> Column:
    """What stays of a hit: of an address two characters and its domain, of the others some digits at the ends."""
    kind, at, digits = _category(hit), F.instr(hit, "@") - 1, F.replace(hit, F.lit("-"), F.lit(""))
    ends = lambda c, first, stars, last: F.concat(F.left(c, F.lit(first)), F.lit("*" * stars), F.right(c, F.lit(last)))
    card = F.when(F.rlike(hit, F.lit("[Xx]$")), ends(hit, 2, 13, 3)).otherwise(ends(hit, 2, 10, 2))
    return (
        F.when(kind == "email", F.concat(F.left(hit, F.least(at, F.lit(2))), F.lit("***"), F.substr(hit, at + 1)))
        .when(kind == "ipv4", F.concat(F.substring_index(hit, ".", 2), F.lit(".**.**"))).when(kind == "id_card", card)
        .when(kind == "bank_card", ends(hit, 2, 15, 1)).otherwise(ends(digits, 3, 4, 4))
    )


def _hits(text: Column) -> Column:
    p = F.lit(ANY_PII)
    return F.arrays_zip(F.split(text, ANY_PII, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"))


def scrubbed(text: Column) -> Column:
    """Personal data masked, in one pass from the left; texts without any stay as they are."""
    parts = F.transform(_hits(text), lambda x: F.concat(x["gap"], F.coalesce(_masked(x["hit"]), F.lit(""))))
    return F.when(F.rlike(text, F.lit(MAY_HOLD)), F.array_join(parts, "")).otherwise(text)


def redactions(text: Column) -> Column:
    """An array of (category, start, end) of what :func:`scrubbed` masks, in code points of the text, end exclusive."""
    start = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<category:string,start:int,end:int>>))")

    def step(acc: Column, x: Column) -> Column:
        first = (acc["at"] + F.length(x["gap"])).cast("int")
        last = (first + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("int")
        one = F.array(F.struct(_category(x["hit"]).alias("category"), first.alias("start"), last.alias("end")))
        return F.struct(last.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.aggregate(_hits(text), start, step)["out"]


def resolved(scrubbed_text: Column, transcript: Column) -> Column:
    """The scrubbed text if there is one, even an empty one, else the scrubbed transcript."""
    return F.coalesce(scrubbed_text, scrubbed(F.coalesce(transcript, F.lit(""))))


def token_estimate(text: Column) -> Column:
    """A cautious count of model tokens: four ASCII characters a token, others one each, four bytes a token at least."""
    other = F.length(F.regexp_replace(text, F.lit(r"[\x00-\x7F]"), F.lit("")))
    ascii_ = F.length(text) - other
    return F.greatest(other + F.ceil(ascii_ / 4), F.ceil(F.octet_length(text) / 4)).cast("long")


def language(text: Column) -> Column:
    """zh-CN with any Han character, en if there are letters and all of them are Latin, else und."""
    other = F.rlike(text, F.lit(r"[\p{L}&&[^\p{IsLatin}]]|[ªº]"))
    return F.when(F.rlike(text, F.lit(r"\p{IsHan}")), "zh-CN").when(F.rlike(text, F.lit(r"\p{L}")) & ~other, "en").otherwise("und")


#: Identifiers that a reused answer must have in common: addresses, upper-case business tokens, labelled values.
IDENTIFIERS = (
    (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,63}(?![A-Za-z0-9._%+-])", 0),
    (r"(?<![A-Za-z0-9._:/-])[A-Z][A-Z0-9._:/-]{1,63}(?![A-Za-z0-9._:/-])", 0),
    (r"(?i)(?:\b(?:id|sku|code|ticket)\b|\border\s+(?:id|number|no)\b|订单号|单号|编号|编码)\s*[:：#=-]?\s*([A-Za-z][A-Za-z0-9._:/-]{1,63})", 1),
)


def protected_identifiers(text: Column) -> Column:
    """The distinct identifiers in a text, sorted."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in IDENTIFIERS]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def cut_bytes(text: Column, most: int = 256) -> Column:
    """The longest beginning of at most so many UTF-8 bytes that ends with a whole character."""
    head = F.left(text, F.lit(most))
    sizes = F.transform(F.split(head, ""), F.octet_length)
    fits = F.aggregate(sizes, F.struct(F.lit(0).alias("n"), F.lit(0).alias("size")), lambda a, x: F.struct((a["n"] + F.when(a["size"] + x <= most, 1).otherwise(0)).cast("int").alias("n"), (a["size"] + x).cast("int").alias("size")))["n"]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.left(head, fits))


def json_length(said: Column) -> Column:
    """Elements of a JSON array; 0 for null, broken JSON and other values."""
    return F.coalesce(F.json_array_length(said), F.lit(0))


def instant(said: Column) -> Column:
    """A time in ISO 8601, UTC where it names no zone; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(said), F.lit("[zZ]$"), F.lit("+00:00")))


def deletions(name: Column, most: int) -> Column:
    """(text, n) of a name without any n characters, n from 0 to ``most``, each text with its least n."""
    less = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.left(x, i - 1), F.substr(x, i + 1)))
    levels = [F.array(name)]
    for _ in range(most):
        levels.append(F.array_distinct(F.flatten(F.transform(F.filter(levels[-1], lambda x: x != ""), less))))
    tag = lambda n: lambda v: F.struct(v.alias("text"), F.lit(n).alias("n"))
    return F.concat(*[F.transform(x, tag(n)) for n, x in enumerate(levels)])


def half_up_ms(seconds: Column) -> Column:
    """Milliseconds of decimal seconds, halves up."""
    return F.round(seconds.cast("decimal(20,6)") * 1000, 0).cast("long")


def excerpt(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))).otherwise(text)


def members(said: Column) -> Column:
    """A lenient list: trimmed, without empty members, each once in order; broken JSON is an empty list."""
    parsed = F.coalesce(F.from_json(said, "array<string>"), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility form, lower case, without white space around."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower().strip())


def _checksum(text: str | None) -> str | None:
    import hashlib

    if text is None:
        return None
    value = json.loads(text, parse_float=lambda x: int(float(x)) if float(x).is_integer() else float(x))
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def canonical_checksum(text: pd.Series) -> pd.Series:
    """SHA-256 of JSON with sorted keys, whole floats as integers."""
    return text.map(_checksum)


def likeness(a: str | None, b: str | None) -> float:
    """Share of characters two strings have in common in order, 0 to 100: twice the longest
    common subsequence over both lengths, by rows of bits."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def fuzzy(a: pd.Series, b: pd.Series) -> pd.Series:
    """The better of the likeness as written and with words sorted."""
    order = lambda s: " ".join(sorted(s.split())) if s else s
    return pd.Series([max(likeness(x, y), likeness(order(x), order(y))) for x, y in zip(a, b)])
