"""Names that are alike: fuzzy joins by keys that hold every pair at a score, and who a speaker is.

Two names can reach a score in few ways, each of which leaves a trace to join on:

* they are within a number of edits that the score and their lengths bound. Up to two edits, both
  have a text in common that one reaches by taking out i characters and the other d - i;
* with more edits, or where the shorter name is like a part of the longer, the shorter one keeps
  a least number c of its q-grams, so among any all - c + 1 of them, the rarest, is one of the longer's;
* they share a word.

:func:`kept_grams` counts c for each length, with q from 3 down to 1, so no pair is lost, whatever the edits.
Only pairs found so are scored, on Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import likeness
from colloquy.functions import text as fn
from colloquy.operators.substrings import grams
from colloquy.session import settled

#: Edits whose deletions are joined on; more are left to q-grams.
EDITS = 2
GRAM = 3
#: Lengths for which kept q-grams are counted; a longer name looks for any of its q-grams.
COUNTED = 1000


def _least(part: float) -> float:
    """A share of 1 from a score, with room for rounding."""
    return part - 1e-9


def kept_grams(n: int, q: int, least: float, parts: bool) -> int:
    """How many q-grams a name of length n shares at least with any longer one that needs them to score ``least``.

    A character taken out costs up to q grams, one put in up to q - 1. Whole names within ``EDITS`` edits are found otherwise.
    """
    worst = []
    share = _least(least / 100)
    m = np.arange(n, int(n * (2 - share) / share) + 1)
    most = np.floor((1 - share) * (n + m) + 1e-6)
    in_more = m - n
    out = np.floor((most - in_more) / 2)
    need = (most > EDITS) & (out >= 0)
    worst += (q * out + (q - 1) * (in_more + out))[need].tolist()
    if parts and least <= 100 * likeness.PART:
        share = _least(least / 100 / likeness.PART)
        w = np.arange(1, n + 1)
        most = np.floor((1 - share) * (n + w) + 1e-6)
        in_ = np.floor((most - (n - w)) / 2)
        worst += (q * (in_ + n - w) + (q - 1) * in_)[in_ >= 0].tolist()
    return n - q + 1 - int(max(worst)) if worst else n - q + 2


def _plan(longest: int, least: float, parts: bool) -> list[tuple[int, int, int]]:
    """(length, q, grams to look for) of each length of the shorter name; (n, q, 0) where no other name needs its grams."""
    out = []
    for n in range(1, min(longest, COUNTED) + 1):
        kept, q = next(((k, q) for q in range(GRAM, 0, -1) if n >= q and (k := kept_grams(n, q, least, parts)) >= 1), (1, 1))
        out.append((n, q, max(0, n - q + 1 - kept + 1)))
    return out


def _variants(name: Column, whole: bool) -> Column:
    """The name as it stands, with its words in order, and with each word once."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    ordered = F.array_join(F.array_sort(words), " "), F.array_join(F.array_sort(F.array_distinct(words)), " ")
    return F.array_distinct(F.array(name, *ordered) if whole else F.array(*ordered))


def _numbered(text: Column, q: int) -> Column:
    """q-grams with how often each has come before, so that repeated ones count."""
    all_ = grams(text, q)
    return F.transform(all_, lambda g, i: F.concat(g, F.lit("\x00"), F.size(F.filter(F.slice(all_, 1, i + 1), lambda x: x == g)).cast("string")))


def _held(variants: DataFrame, sizes: list[int]) -> DataFrame:
    """(name, group, v, n, q, key): every numbered q-gram of the given sizes."""
    tagged = lambda q: F.transform(_numbered(F.col("v"), q), lambda g: F.struct(F.lit(q).alias("q"), g.alias("key")))
    of = variants.select("name", "group", "v", F.explode(F.concat(*[tagged(q) for q in sizes])).alias("g"))
    return of.select("name", "group", "v", F.length("v").alias("n"), "g.q", "g.key")


def _reach(n: Column, least: float) -> Column:
    """How many characters a name of length n may lose on the way to one within ``EDITS`` edits."""
    spare = 1 - _least(least / 100)
    return F.when(spare * (2 * n - 2) + 1e-6 >= 2, 2).when(spare * (2 * n - 1) + 1e-6 >= 1, 1).otherwise(0)


def _spread(names: DataFrame) -> DataFrame:
    """Names written once, in as many parts as a shuffle has: they are few bytes, but taking them apart is much work."""
    return settled(names.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "names")


def _one_word(name: Column) -> Column:
    """Names of letters, digits, punctuation and signs alone: no white space of any kind parts them."""
    return F.coalesce(F.rlike(name, F.lit(r"^[\p{L}\p{N}\p{P}\p{S}]+$")), F.lit(False))


def _alike_whole(name: Column, other: Column) -> Column:
    """Whether neither counts as a part of the other by its length."""
    a, b = F.length(name), F.length(other)
    return F.greatest(a, b) < likeness.LONGER * F.least(a, b)


def _band(n: Column) -> Column:
    """Lengths by powers of ``LONGER``: a name at least so many times as long lies in a later band."""
    return F.floor(F.log(n) / F.log(F.lit(likeness.LONGER))).cast("int")


#: Bands from a name to one ``MUCH_LONGER``.
BANDS = int(np.ceil(np.log(likeness.MUCH_LONGER) / np.log(likeness.LONGER)))


def _dealt(rows: DataFrame) -> DataFrame:
    """To be joined by dealing both sides: names taken apart are many times what Spark expects of the names, too much to send through the driver."""
    return rows.hint("merge")


def _met(x: DataFrame, y: DataFrame, one_way: bool = False) -> DataFrame:
    """Pairs of x and y (name, group, key, ...) of one key and of groups that fit, whichever way round they came."""
    # keys carry the group: T meets T and null, null meets all
    meets = lambda g: F.when(g.isNull(), F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("="), g), F.lit("?")))
    met = lambda g: F.when(g.isNull(), F.array(F.lit("?"), F.lit("*"))).otherwise(F.array(F.concat(F.lit("="), g), F.lit("*")))
    left = x.select("name", F.col("group").alias("name_group"), "key", "n", F.explode(meets(F.col("group"))).alias("meet"))
    right = y.select(F.col("name").alias("other"), F.col("group").alias("other_group"), "key", F.col("n").alias("m"), F.explode(met(F.col("group"))).alias("meet"))
    return left.join(_dealt(right), ["key", "meet"]).where("name < other" if one_way else "name <> other")


def _near(variants: DataFrame, least: float) -> DataFrame:
    """(name, group, key, n): each variant without any n characters, as many as may be lost."""
    reach = _reach(F.length("v"), least)
    texts = F.when(reach == 0, fn.deletions(F.col("v"), 0))
    for n in range(1, EDITS + 1):
        texts = texts.when(reach == n, fn.deletions(F.col("v"), n))
    return variants.where(F.length("v") <= _short(least)).withColumn("x", F.explode(texts)).select("name", "group", F.col("x.text").alias("key"), F.col("x.n").alias("n"))


def _asking(near: DataFrame) -> DataFrame:
    """The same with a key for each number of characters that the other name may have lost too; :func:`_offering` names its own."""
    return near.withColumn("m", F.explode(F.sequence(F.lit(0), EDITS - F.col("n")))).select("name", "group", F.concat("m", F.lit(":"), "key").alias("key"), "n")


def _offering(near: DataFrame) -> DataFrame:
    return near.select("name", "group", F.concat("n", F.lit(":"), "key").alias("key"), "n")


def candidate_pairs(names: DataFrame, others: DataFrame, least: float, kind: str = "weighted", words_near: bool = True, one_way: bool = False) -> DataFrame:
    """(name, name_group, other, other_group, edits): all pairs of different names of compatible groups that may score ``least`` or more.

    Takes (name, group); a null group fits all. ``kind`` is weighted (whole names, words, parts) or words.
    ``edits`` is null for pairs that were not found by ``EDITS`` edits. Without ``words_near`` two names
    of one word each are left to :func:`_nearest_words` where edits alone bring them together;
    ``one_way`` keeps pairs in order of their names.
    """
    parts = kind == "weighted"
    if parts and least <= 100 * likeness.SMALL_PART:
        raise ValueError("parts of names over eight times as long count up to 60; a lesser score would need all pairs")
    variants = lambda d: d.select("name", "group", F.explode(_variants(F.col("name"), parts)).alias("v")).where("v <> ''")
    a, b = variants(names), variants(others)
    pair = ["name", "name_group", "other", "other_group"]
    close = lambda x, y: _met(_asking(_near(x, least)), _offering(_near(y, least)), one_way).select(*pair, (F.col("n") + F.col("m")).alias("edits"))
    told = [d.agg(F.max(F.length("v")).alias("longest"), F.max(_band(F.length("name"))).alias("band"), F.bool_or(~_one_word(F.col("name"))).alias("several")).first() for d in ((a,) if names is others else (a, b))]
    longest, top = max(r.longest or 0 for r in told), max(r.band or 0 for r in told)
    unknown = F.lit(None).cast("int").alias("edits")
    found = close(a, b) if words_near else close(a.limit(0), b.limit(0))
    if any(r.several for r in told):
        if not words_near:
            several, one = ~_one_word(F.col("name")), _one_word(F.col("name"))
            found = close(a, b.where(several)).unionByName(close(a.where(several), b.where(one)))
        words = lambda d: d.select("name", "group", F.explode(F.array_distinct(F.split(F.trim("name"), r"\s+"))).alias("key"), F.lit(0).alias("n")).where("key <> ''")
        found = found.unionByName(_met(words(names), words(others), one_way).select(*pair, unknown))

    plan = _plan(longest, least, parts)
    used = sorted({q for _, q, look in plan if look} | ({1} if longest > COUNTED else set()))
    table = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(look).alias("look")) for _, q, look in plan]) if plan else None
    share = _least(least / 100)
    spare = (2 - share) / share
    in_parts = parts and least <= 100 * likeness.PART
    none = F.array().cast("array<string>")
    # what two names need grams for: P parts, by bands of the whole names; W more than EDITS edits, by bands of the variants
    tag = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    many = lambda n, m: (1 - share) * (n + m) + 1e-6 >= EDITS + 1
    top = F.lit(top)
    band = _band(F.length("name"))
    first = F.when(_one_word(F.col("name")), band + 1).otherwise(F.greatest(band - BANDS, F.lit(0)))  # blanks may make a name long whose words are short
    later = F.when(first <= top, F.transform(F.sequence(first, F.least(band + BANDS, top)), lambda x: tag("P", x))).otherwise(none) if in_parts else none
    same = F.transform(F.sequence(_band(F.col("n")), _band(F.ceil(F.col("n") * spare))), lambda x: tag("W", x))
    wanted = F.concat(later, F.when(many(F.col("n"), F.col("n") * spare), same).otherwise(none))
    given = F.concat(F.array(tag("P", _band(F.length("name")))) if in_parts else none, F.when(many(F.col("n"), F.col("n")), F.array(tag("W", _band(F.col("n"))))).otherwise(none))
    tagged = lambda d, tags: d.withColumn("tag", F.explode(tags)).withColumn("key", F.concat("tag", F.lit(" "), "key")).drop("tag")
    for x, y, ways in ((a, b, True), (b, a, False)):
        if not used:
            break
        shorter, longer = _held(x.withColumn("n", F.length("v")).where(F.size(wanted) > 0), used), _held(y, used)
        often = longer.groupBy("key").agg(F.count("*").alias("often"))
        mine = F.when(F.length("v") <= COUNTED, F.get(table, F.length("v") - 1)).otherwise(F.struct(F.lit(1).alias("q"), F.length("v").alias("look")))
        asked = shorter.withColumn("plan", mine).where("q = plan.q").join(_dealt(often), "key", "left").groupBy("name", "group", "v").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "key"))).alias("all"), F.first("plan.look").alias("look"), F.first("n").alias("n"))
        asked = tagged(asked.select("name", "group", "n", F.explode(F.slice("all", 1, F.col("look"))["key"]).alias("key")), wanted)
        offered = tagged(longer.select("name", "group", "key", "n"), given)
        rows = _met(asked, offered, one_way) if ways else _met(offered, asked, one_way)
        short, long = (F.col("n"), F.col("m")) if ways else (F.col("m"), F.col("n"))
        like = (long <= short * spare) & many(short, long)
        if in_parts:
            whole = F.length("name"), F.length("other")
            like = like | (~_alike_whole(F.col("name"), F.col("other")) & (F.greatest(*whole) <= likeness.MUCH_LONGER * F.least(*whole)))
        found = found.unionByName(rows.where((short <= long) & like).select(*pair, unknown))
    return found.groupBy(*pair).agg(F.min("edits").alias("edits"))


def _short(least: float) -> int:
    """The longest name that ``EDITS`` edits or fewer may bring to another at a score."""
    spare = 1 - _least(least / 100)
    return int((EDITS + 1) / spare * (1 + spare) / 2) + EDITS


def scored_pairs(names: DataFrame, others: DataFrame, least: float, kind: str = "weighted", words_near: bool = True, one_way: bool = False) -> DataFrame:
    """(name, name_group, other, other_group, score) of all pairs that score ``least`` or more.

    The edits between two names of one word each give their score, if neither is a part by its length; others are scored from the texts.
    """
    score = F.pandas_udf(lambda a, b: pd.Series([None if x is None else s for x, s in zip(a, likeness.scores(kind, a.fillna(""), b.fillna("")))], dtype="float64"), "double")
    both = candidate_pairs(names, others, least, kind, words_near, one_way)
    told = F.col("edits").isNotNull() & _one_word(F.col("name")) & _one_word(F.col("other"))
    if kind == "weighted":
        told = told & _alike_whole(F.col("name"), F.col("other"))
    size = (F.length("name") + F.length("other")).cast("double")
    by_edits = F.lit(200.0) * ((size - F.col("edits")) / 2) / size
    if kind == "words":
        by_edits = F.greatest(by_edits, 100.0 - F.lit(100.0) * F.col("edits") / size)
    both = both.withColumn("told", told).withColumn("text", F.when(~F.col("told"), F.col("name")))
    return both.withColumn("score", F.when(F.col("told"), by_edits).otherwise(score("text", "other"))).where(F.col("score") >= least).drop("edits", "told", "text")


def _nearest_words(names: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """(name, name_group, canonical, score): the best of others within ``EDITS`` edits, both of one word and neither a part by its length.

    How many characters two names lost to one text tells their score, so of all that lost the same to
    the same text the largest name is best: two are kept, as one may be the name itself, and no pairs are made.
    """
    one = lambda d: _near(d.where(_one_word(F.col("name"))).withColumn("v", F.col("name")), least)
    group = lambda g: F.coalesce(F.concat(F.lit("="), g), F.lit("?"))
    offered = _offering(one(others))
    # every group on its own, and all groups together for names without one
    offered = offered.select("name", "key", F.explode(F.array_distinct(F.array(group(F.col("group")), F.lit("*")))).alias("meet"), F.col("n").alias("m"))
    largest = offered.groupBy("key", "meet").agg(F.max("name").alias("name"), F.first("m").alias("m"))
    next_ = offered.join(_dealt(largest.select("key", "meet", F.col("name").alias("top"))), ["key", "meet"]).where("name < top").groupBy("key", "meet").agg(F.max("name").alias("next"))
    two = largest.withColumnRenamed("name", "top").join(_dealt(next_), ["key", "meet"], "left")
    meets = F.when(F.col("group").isNull(), F.array(F.lit("*"))).otherwise(F.array(group(F.col("group")), F.lit("?")))
    asked = _asking(one(names)).select("name", F.col("group").alias("name_group"), "key", "n", F.explode(meets).alias("meet"))
    both = asked.join(_dealt(two), ["key", "meet"]).select("name", "name_group", F.when(F.col("top") != F.col("name"), F.col("top")).otherwise(F.col("next")).alias("canonical"), (F.col("n") + F.col("m")).alias("edits"))
    size = (F.length("name") + F.length("canonical")).cast("double")
    return both.where("canonical is not null").where(_alike_whole(F.col("name"), F.col("canonical"))).select("name", "name_group", "canonical", (F.lit(200.0) * ((size - F.col("edits")) / 2) / size).alias("score")).where(F.col("score") >= least)


def names_alike(names: DataFrame, canonicals: DataFrame, least: float = 85.0) -> DataFrame:
    """(name, type, canonical, score): for each (name, type) the most alike other canonical name of its type.

    The score is the weighted ratio of whole names, their words and their parts, 0 to 100. A missing
    type fits all types. Of equal scores the larger name. Null and empty names are like nothing.
    """
    as_pairs = lambda d: _spread(d.select("name", F.col("type").alias("group")).where("name <> ''").distinct())
    asked = as_pairs(names)
    known = asked if names is canonicals else as_pairs(canonicals)
    # two names of which one counts as a part by its length have a ratio of 200 / (1 + LONGER) at most
    by_words = least > 200 / (1 + likeness.LONGER)
    found = scored_pairs(asked, known, least, words_near=not by_words).select("name", "name_group", F.col("other").alias("canonical"), "score")
    if by_words:
        found = found.unionByName(_nearest_words(asked, known, least))
    best = F.max_by(F.struct("canonical", "score"), F.struct("score", "canonical")).alias("b")
    return found.groupBy("name", "name_group").agg(best).select("name", F.col("name_group").alias("type"), "b.canonical", "b.score")


def all_alike(texts: DataFrame, least: float, kind: str = "words") -> DataFrame:
    """(a, b, type, score), a before b: all pairs of different names of a type that score ``least`` or more; a missing type is a type of its own."""
    one = _spread(texts.select("name", F.coalesce(F.concat(F.lit("="), "type"), F.lit("")).alias("group")).distinct())
    both = scored_pairs(one, one, least, kind, one_way=True)
    return both.select(F.col("name").alias("a"), F.col("other").alias("b"), F.when(F.col("name_group") != "", F.substr("name_group", F.lit(2))).alias("type"), "score")


def speaker_scores(queries: DataFrame, speakers: DataFrame, least: float = 70.0) -> DataFrame:
    """(query, candidate, score, cosine): the speakers of a query's tenant whose names score ``least`` of 100 or more.

    Takes (query, tenant, name, vector) and (candidate, tenant, name, vector). Names are scored by
    their words, 0 to 1; the cosine is null where either has no vector. A query without any stands with nulls.
    """
    from colloquy.operators.retrieval import cosine

    group = lambda d: d.select("name", F.coalesce(F.concat(F.lit("="), "tenant"), F.lit("")).alias("group")).where("name <> ''").distinct()
    alike = scored_pairs(group(queries), group(speakers), least, "words").select("name", F.col("other").alias("called"), F.col("name_group").alias("group"), "score")
    key = F.coalesce(F.concat(F.lit("="), "tenant"), F.lit(""))
    equal = group(queries).join(group(speakers), ["name", "group"]).select("name", F.col("name").alias("called"), "group", F.lit(100.0).alias("score"))
    asked = queries.select("query", "name", key.alias("group"), F.col("vector").alias("v"))
    known = speakers.select("candidate", F.col("name").alias("called"), key.alias("group"), F.col("vector").alias("c"))
    found = alike.unionByName(equal).join(known, ["called", "group"])
    return asked.join(found, ["name", "group"], "left").select("query", "candidate", (F.col("score") / 100).alias("score"), cosine(F.col("v"), F.col("c")).alias("cosine"))


def speaker_verdicts(scored: DataFrame, ambiguous: float = 0.85, inferred: float = 0.70, confirm: float = 0.70) -> DataFrame:
    """(query, candidate, verdict, reconfirm) of each query from its candidates' name scores (0 to 1) and voice cosines.

    The best name decides, the first candidate on a tie: from ``ambiguous`` on it is CONFIRMED if the
    voices fit, else AMBIGUOUS and has to be confirmed again, also without a voice; from
    ``inferred`` on it is INFERRED; else there is NO_MATCH, and no candidate.
    """
    best = F.max_by(F.struct("candidate", "score", "cosine"), F.struct("score", -F.col("candidate"))).alias("b")
    one = scored.groupBy("query").agg(best).select("query", "b.*")
    strong = F.coalesce(F.col("score") >= ambiguous, F.lit(False))
    sure = strong & F.coalesce(F.col("cosine") >= confirm, F.lit(False))
    verdict = F.when(sure, "CONFIRMED").when(strong, "AMBIGUOUS").when(F.col("score") >= inferred, "INFERRED").otherwise("NO_MATCH")
    return one.select("query", F.when(verdict != "NO_MATCH", F.col("candidate")).alias("candidate"), verdict.alias("verdict"), (verdict == "AMBIGUOUS").alias("reconfirm"))
