"""Secret scans by multipart credential linking, with DataFrame functions only.

Base kinds stand alone: ``assign`` (password = value), ``access`` (AKIA key ids) and ``hex``.
Weak kinds are reported only when a complementary part stands within the scope:

* ``weak_id``: a run of upper-case letters and digits, 16 to 40 long, with both.
* ``weak_secret``: a run of 20 to 256 base64 characters with upper case, lower case and digits.
* ``endpoint``: a http(s) address or a dotted IPv4 address.

A weak secret needs an identifier or an endpoint near by, a weak identifier or an endpoint
needs a secret (assign, hex or weak_secret). Near means at most ``scope`` code points between
the spans, in one text. Weak spans that overlap a base span are dropped.

Spans are found without positions from the regex engine: the lengths of what stands between
the matches and of the matches add up to them. All positions are code points, end exclusive.

The texts that hold weak spans are searched once for all kinds and written, with one row for all
copies of a text; what is linked there is joined back to the rows by the text's hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.shared import cut

#: Kinds in the order in which equal starts are listed.
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}"
ENDPOINT = r"""https?://[^\x00-\x20"'<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}"""
SCOPE = 200
SPAN = "array<struct<start:int,kind:int,end:int>>"


#: Values that :func:`_running` adds up in one piece.
PIECE = 128
#: Texts with over this part of the rows that hold weak spans are joined by broadcast; there are fewer than this many.
HOT = 1000


def _let(value: Column, f) -> Column:
    """``f`` of a value that is made once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(values: Column, step) -> Column:
    """``step`` (sum or greatest) of all values of an array up to each one.

    Made in pieces of ``PIECE`` values, and then over the pieces, as an array that grows by
    one value at a time is copied each time.
    """
    none = F.expr("cast(array() as array<int>)")

    def whole(array: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        added = lambda acc, at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))
        return F.aggregate(array, start, lambda acc, x: _let(step(acc["at"], x).cast("int"), lambda at: added(acc, at)))["out"]

    def cut_up(v: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PIECE))
        return F.transform(firsts, lambda j: whole(F.slice(v, (j * PIECE + 1).cast("int"), F.lit(PIECE))))

    def joined(pieces: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), whole(F.transform(pieces, lambda p: F.element_at(p, -1))))
        placed = F.filter(F.arrays_zip(pieces.alias("p"), ends.alias("e")), lambda x: x["p"].isNotNull())
        return F.flatten(F.transform(placed, lambda x: F.transform(x["p"], lambda v: step(x["e"], v).cast("int"))))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(cut_up(v), joined)).otherwise(none))


def _found(text: Column, pattern: str, kind: Column, keep: Column) -> Column:
    """Spans of the leftmost non-overlapping matches m that ``keep`` holds for.

    kind and keep may use m (struct of hit and value).
    """
    p = F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(2)) if pattern == ASSIGN else F.array()
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value")), lambda m: m["hit"].isNotNull())

    def spans(s: Column) -> Column:
        ends = _running(F.transform(s, lambda m: (m["gap"] + F.length(m["hit"])).cast("int")), lambda a, b: a + b)
        kept = F.filter(F.arrays_zip(s.alias("m"), ends.alias("end")), lambda x: keep(x["m"]))
        return F.transform(kept, lambda x: F.struct((x["end"] - F.length(x["m"]["hit"])).cast("int").alias("start"), kind(x["m"]).cast("int").alias("kind"), x["end"].alias("end")))

    return F.when(F.rlike(text, p), _let(steps, spans)).otherwise(F.expr(f"cast(array() as {SPAN})"))


def _run_kind(m: Column) -> Column:
    hit, n = m["hit"], F.length(m["hit"])
    upper, lower = F.rlike(hit, F.lit("[A-Z]")), F.rlike(hit, F.lit("[a-z]"))
    weak_id = F.rlike(hit, F.lit("^[A-Z0-9]+$")) & upper & (n <= 40)
    return F.when(weak_id, 3).when(upper & lower & (n >= 20) & (n <= 256), 4).otherwise(-1)


def base_spans(t: Column) -> Column:
    """Spans of the base kinds in a text, by start, then kind."""
    always = lambda m: F.lit(True)
    return F.array_sort(F.concat(
        _found(t, ASSIGN, lambda m: F.lit(0), lambda m: F.length(m["value"]) >= 12), _found(t, ACCESS, lambda m: F.lit(1), always), _found(t, HEX, lambda m: F.lit(2), always)
    ))


def weak_spans(t: Column) -> Column:
    return F.concat(_found(t, RUN, _run_kind, lambda m: _run_kind(m) > 0), _found(t, ENDPOINT, lambda m: F.lit(5), lambda m: F.lit(True)))


def may_be_weak(t: Column) -> Column:
    return F.rlike(t, F.lit(RUN)) | F.rlike(t, F.lit(ENDPOINT))


def with_weak(texts: DataFrame) -> DataFrame:
    """(text_key, base, weak, n) of the distinct texts (column ``whole``) and how many rows have each; written
    to the shared folder."""
    found = texts.select(F.sha2("whole", 256).alias("text_key"), base_spans(F.col("whole")).alias("base"), weak_spans(F.col("whole")).alias("weak"))
    return cut(found.groupBy("text_key").agg(F.first("base").alias("base"), F.first("weak").alias("weak"), F.count("*").alias("n")), "weak")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(text_key, linked): the weak spans of each text that have their complement near by.

    An interval join within each text: spans are dealt to bins of ``scope`` code points, weak
    ones also to the bins their scope reaches, and only spans of a common bin are compared.
    """
    some = found.where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1))
    spans = some.select("text_key", F.explode(F.concat("base", "weak")).alias("s")).select("text_key", "s.start", "s.kind", "s.end").distinct()
    bins = lambda low, high: F.explode(F.sequence((low / scope).cast("int"), (high / scope).cast("int"))).alias("bin")
    weak = spans.where("kind > 2").select("text_key", "start", "kind", "end", bins(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope))
    part = spans.select("text_key", F.col("start").alias("p_start"), F.col("kind").alias("p_kind"), F.col("end").alias("p_end"), bins(F.col("start"), F.col("end")))
    is_secret = F.col("p_kind").isin(0, 2, 4)
    fits = F.when(F.col("kind") == 4, F.col("p_kind").isin(1, 3, 5)).otherwise(is_secret)
    gap = F.greatest(F.col("p_start") - F.col("end"), F.col("start") - F.col("p_end"))
    return (
        weak.join(part, ["text_key", "bin"])
        .groupBy("text_key", "start", "kind", "end")
        .agg(F.bool_or((gap < 0) & (F.col("p_kind") < 3)).alias("covered"), F.bool_or(fits & gap.between(0, scope)).alias("near"))
        .where("near and not covered")
        .groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))
    )


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(row, whole, base, spans): each input row as a struct, its text (null: empty), its base
    spans and all its spans, both ordered by start, then kind.

    Repeated rows stay repeated; an empty text or table has no spans. Spans of different kinds
    may overlap. Each row's spans depend on its text alone.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole.alias("whole"))
    weak = may_be_weak(F.col("whole"))
    found = with_weak(rows.select("whole").where(weak))
    extra = cut(linked(found, scope), "linked")
    total = found.agg(F.sum("n")).first()[0] or 0
    none = F.expr(f"cast(array() as {SPAN})")
    hot = found.where(F.col("n") > total / HOT).select("text_key").join(extra, "text_key", "left").select("text_key", F.coalesce("linked", none).alias("hot"))
    keyed = rows.select("row", "whole", base_spans(F.col("whole")).alias("base"), F.when(weak, F.sha2("whole", 256)).alias("text_key")).join(F.broadcast(hot), "text_key", "left")
    # rows that need no link get keys of their own, as many of them may hold the same text
    plain = [F.col("row").getField(f.name) for f in docs.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    key = F.when(F.col("text_key").isNotNull() & F.col("hot").isNull(), F.col("text_key")).otherwise(F.concat(F.lit("-"), F.xxhash64(*plain).cast("string")))
    both = F.array_sort(F.concat("base", F.coalesce("hot", "linked", none))).alias("spans")
    return keyed.withColumn("text_key", key).join(extra, "text_key", "left").select("row", "whole", "base", both)


def listed(spans: str | Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with each stretch of text that spans cover replaced by ``mask``; the columns stay.

    Overlapping spans count as one stretch. A null text stays null.
    """
    reach = _running(F.transform("spans", lambda s: s["end"]), F.greatest)
    placed = F.arrays_zip(F.col("spans").alias("s"), F.concat(F.array(F.lit(0)), reach).alias("at"))
    whole = F.col("whole")

    def part(x: Column) -> Column:
        start = x["s"]["start"]
        last = whole.substr(x["at"] + 1, F.length(whole))
        return F.when(x["s"].isNull(), last).when(start >= x["at"], F.concat(whole.substr(x["at"] + 1, start - x["at"]), F.lit(mask))).otherwise("")

    clean = F.array_join(F.transform(placed, part), "")
    done = scan(docs, text, scope).withColumn("clean", F.when(F.size("spans") > 0, clean).otherwise(F.col("row").getField(text)))
    return done.select(*[(F.col("clean") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
