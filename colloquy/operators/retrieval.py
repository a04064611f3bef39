"""Vectors, channels and word-set search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.operators.substrings import contained
from colloquy.session import settled


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of different length; 0 for one without length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(n < 1e-12, 0.0).otherwise(dot(a, b) / n))


def valid(vectors: DataFrame, size: int, column: str = "embedding") -> DataFrame:
    broken = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where((F.size(column) == size) & ~broken)


def top_k(vectors: DataFrame, query: list[float], k: int, column: str = "embedding") -> DataFrame:
    """The k most similar vectors; each task keeps k, so no shuffle grows with the table."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", cosine(F.col(column), q)).orderBy(F.desc("score"), "vec_id").limit(max(0, k))


def centroids(vectors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """The mean of each dimension; sums meet by (key, dimension), not in one list."""
    d = vectors.select(key, F.posexplode(column).alias("d", "v")).groupBy(key, "d").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return d.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("centroid"))


def _directions(vectors: DataFrame, keys: list[str], weight: Column, column: str) -> DataFrame:
    """The weighted mean of each key's vectors, of length 1; keys without weight or direction have none."""
    d = vectors.select(*keys, weight.alias("w"), F.posexplode(column).alias("d", "v")).where("w > 0").groupBy(*keys, "d").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
    mean = d.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("mean"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return mean.where("n >= 1e-12").select(*keys, F.transform("mean", lambda x: F.try_divide(x, F.col("n"))).alias("centroid"))


def robust_centroids(vectors: DataFrame, key: str, seconds: str, least: float, column: str = "embedding") -> DataFrame:
    """(key, centroid, members, dropped, seconds): each key's voice from vectors weighted by how long they are.

    Of three vectors or more those whose cosine with the plain mean is under ``least`` are outliers:
    each has one vote there, so a long one can't clear itself. If none would be left, all stay. Vectors are
    taken by direction; ones without any, null ones too, are left out. Sums meet by (key, dimension).
    """
    norm = F.sqrt(dot(F.col(column), F.col(column)))
    unit = vectors.withColumn("_n", norm).where(F.col("_n") >= 1e-12).select(key, F.col(seconds).cast("double").alias("_s"), F.transform(column, lambda x: F.try_divide(x.cast("double"), F.col("_n"))).alias("_u"))
    votes = _directions(unit, [key], F.lit(1.0), "_u").select(key, F.col("centroid").alias("_c"))
    counts = unit.groupBy(key).agg(F.count("*").alias("_all"))
    judged = unit.join(counts, key).join(votes, key, "left").withColumn("_in", F.coalesce(dot(F.col("_u"), F.col("_c")) >= least, F.lit(True)) | (F.col("_all") < 3))
    inside = judged.groupBy(key).agg(F.count_if("_in").alias("_kept"))
    kept = judged.join(inside, key).where(F.col("_in") | (F.col("_kept") == 0))
    told = kept.groupBy(key).agg(F.count("*").alias("members"), (F.first("_all") - F.count("*")).alias("dropped"), F.sum("_s").alias("seconds"))
    return _directions(kept, [key], F.greatest("_s", F.lit(0.0)), "_u").join(told, key)


#: Centres that go to the tasks at once.
CENTRES = 5_000


def nearest(vectors: DataFrame, centres: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """Each vector's nearest centre, the smaller key on a tie; centres are broadcast in blocks of bounded size."""
    blocks = max(1, -(-centres.count() // CENTRES))
    found = None
    for block in range(blocks):
        some = centres.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == block) if blocks > 1 else centres
        c = F.broadcast(some.agg(F.collect_list(F.struct(F.col(key).alias("key"), "centroid")).alias("all")))
        scored = F.transform("all", lambda x: F.struct((-cosine(F.col(column), x["centroid"])).alias("far"), x["key"].alias("key")))
        one = vectors.crossJoin(c).select("vec_id", F.array_min(scored).alias("best"))
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("vec_id").agg(F.min("best").alias("best")) if blocks > 1 else found
    return found.select("vec_id", F.col("best.key").alias("nearest"))


def graph_channel(asked: DataFrame, sources: DataFrame, edges: DataFrame, top: int = 5, chunks: int | None = None) -> DataFrame:
    """(query, chunk, score): chunks that the graph leads to from each query's keywords (query, keyword).

    A node matches where a keyword stands within its name or its name within a keyword. Of a query's matches the
    ``top`` with the most relations (in and out; a loop counts twice) lead on, the lesser name first on
    a tie: their chunks (``sources``: name, chunk) score their share of the largest number of relations among the
    matches, those of their neighbours half of it, and a chunk keeps its best. Without any relation
    all scores are 0. Only a keyword's own ``top`` can be among a query's, so no more rows
    meet its queries.

    ``chunks`` asks for so many of each query, the best first and the lesser on a tie. All chunks of a node score
    alike there, as do all of its neighbours', so only as many of the least of either can be among them: what
    a node leads to is found once, whatever the queries, and no more rows meet them.
    """
    words = asked.select("keyword").where("keyword <> ''").distinct()
    ends = edges.select(F.explode(F.array("source", "target")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    names = sources.select("name").unionByName(ends.select("name")).distinct()
    both = contained(words, names).select(F.col("needle").alias("keyword"), F.col("haystack").alias("name"))
    both = both.unionByName(contained(names, words).select(F.col("haystack").alias("keyword"), F.col("needle").alias("name"))).distinct()
    ranked = both.join(ends, "name", "left").select("keyword", "name", F.coalesce("n", F.lit(0)).alias("n"))
    order = [F.desc("n"), "name"]
    best = ranked.withColumn("k", F.row_number().over(W.partitionBy("keyword").orderBy(*order))).where(F.col("k") <= top).drop("k")
    mine = asked.select("query", "keyword").distinct().join(best, "keyword").select("query", "name", "n").distinct()
    w = W.partitionBy("query").orderBy(*order)
    most = F.max("n").over(W.partitionBy("query"))
    led = mine.withColumn("most", most).withColumn("k", F.row_number().over(w)).where(F.col("k") <= top)
    led = settled(led.select("query", "name", F.when(F.col("most") > 0, F.col("n") / F.col("most")).otherwise(0.0).alias("score")), "led")
    leads = led.select("name").distinct()
    step = lambda a, b: edges.select(F.col(a).alias("name"), F.col(b).alias("near")).join(leads, "name", "left_semi")
    near = step("source", "target").union(step("target", "source")).where("name <> near").distinct()
    ways = settled(leads.select("name", F.col("name").alias("near"), F.lit(1.0).alias("share")).unionByName(near.withColumn("share", F.lit(0.5))), "ways")
    first = lambda d, *by: d if chunks is None else d.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy("chunk"))).where(F.col("k") <= chunks).drop("k")
    held = sources.select(F.col("name").alias("near"), "chunk").join(ways.select("near"), "near", "left_semi").distinct()
    reach = first(ways.join(first(held, "near"), "near").select("name", "share", "chunk").distinct(), "name", "share")
    found = led.join(reach, "name").groupBy("query", "chunk").agg(F.max(F.col("score") * F.col("share")).alias("score"))
    if chunks is None:
        return found
    return found.withColumn("k", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "chunk"))).where(F.col("k") <= chunks).drop("k")


def channel_union(candidates: DataFrame, key: str) -> DataFrame:
    """The best-scored candidate of each key; the earlier channel on a tie."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "channel", "score"))
    return candidates.groupBy(key).agg(best.alias("b")).select(key, "b.score", "b.channel")


def weighted(candidates: DataFrame, weights: tuple[float, ...] = (0.5, 0.3, 0.2), penalty: float = 0.7) -> DataFrame:
    w = F.get(F.array(*[F.lit(x) for x in weights]), F.col("channel"))
    return candidates.withColumn("score", F.col("score") * w * F.when(F.col("confidence") == "AMBIGUOUS", penalty).otherwise(1.0))


def channel_weights(audio: bool) -> tuple[float, ...]:
    """Weights of the text, graph and audio channels; without audio the others share its part as they stand."""
    return (0.5, 0.3, 0.2) if audio else (0.5 / 0.8, 0.3 / 0.8, 0.0)


def keywords(texts: DataFrame, column: str = "text") -> DataFrame:
    parts = F.filter(F.split(column, r"[\s,.;:!?]+"), lambda w: F.length(w) >= 2)
    return texts.withColumn("keyword", F.explode(parts))


def word_sets(texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    return texts.select(key, F.explode(F.split(F.lower(column), r"\s+")).alias("word")).where("word <> ''").distinct()


def jaccard_search(words: DataFrame, key: str, wanted: int, k: int) -> DataFrame:
    """The k keys whose word sets are most like that of one key."""
    q = words.where(F.col(key) == wanted).select("word", F.lit(True).alias("hit"))
    size = q.agg(F.count("*").alias("q"))
    s = words.join(q, "word", "left").groupBy(key).agg(F.count("*").alias("n"), F.count("hit").alias("both"))
    score = F.col("both") / (F.col("n") + F.col("q") - F.col("both"))
    return s.crossJoin(F.broadcast(size)).select(key, score.alias("s")).orderBy(F.desc("s"), key).limit(k).select(key, F.round("s", 6).alias("score"))


def mixed_tokens(text: Column) -> Column:
    """Distinct words by white space, neighbouring pairs of Han characters, and single letters and digits, in lower case."""
    low = F.lower(text)
    words = F.filter(F.split(low, r"\s+"), lambda x: x != "")
    runs = F.regexp_extract_all(low, F.lit(r"\p{IsHan}{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    letters = F.filter(F.split(low, ""), lambda x: F.rlike(x, F.lit("^[a-z0-9]$")))
    return F.array_distinct(F.concat(words, pairs, letters))


def local_search(links: DataFrame, texts: DataFrame, seeds: DataFrame, query: str, hops: int) -> DataFrame:
    """(node, score) of the nodes near the seeds: half by distance, half by the share of the query's words in the node's text."""
    from colloquy.operators.graphs import neighbours

    asked = sorted({w for w in query.lower().split() if w})
    near = neighbours(links, seeds, hops).join(texts, "node", "left")
    said = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"))
    share = F.size(F.array_intersect(said, F.array(*[F.lit(w) for w in asked]))) / len(asked) if asked else F.lit(0.0)
    return near.select("node", F.round(0.5 / (1 + F.col("hop")) + 0.5 * share, 6).alias("score"))


def semantic_cache(entries: DataFrame, queries: DataFrame, scope: list[str], least: float = 0.985, recent: int = 256) -> DataFrame:
    """(query_id, entry_id): for each query the most alike of its scope's latest entries, if alike enough; the smaller id on a tie.

    A scope keeps ``recent`` entries at most, so a query meets that many and no more.
    """
    latest = entries.withColumn("age", F.row_number().over(W.partitionBy(*scope).orderBy(F.desc("entry_id")))).where(F.col("age") <= recent)
    c = queries.join(latest, scope).withColumn("score", cosine(F.col("embedding"), F.col("asked"))).where(F.col("score") >= least)
    return c.groupBy("query_id").agg(F.min_by("entry_id", F.struct(-F.col("score"), F.col("entry_id"))).alias("entry_id"))
