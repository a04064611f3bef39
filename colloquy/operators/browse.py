"""Lists, searches, bounded windows and pages over receptions, topics, nodes and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.retrieval import top_k
from colloquy.session import settled


def reception_list(receptions: DataFrame, tenant: str, start, end, limit: int, offset: int = 0) -> DataFrame:
    """A page of a tenant's receptions, the latest start first; both bounds are included."""
    found = receptions.where((F.col("tenant_id") == tenant) & F.col("started_sec").between(start, end))
    return found.orderBy(F.desc("started_sec"), F.desc("reception_id")).offset(offset).limit(limit)


def text_search(rows: DataFrame, query: str, columns: list[str], members: str | None = None) -> DataFrame:
    """Rows whose columns, or any of an array of members, hold the query, whatever the case; an empty query keeps all."""
    q = F.lower(F.lit(query.strip()))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), q), F.lit(False))
    if members:
        hit = hit | F.coalesce(F.exists(members, lambda m: F.contains(F.lower(m), q)), F.lit(False))
    return rows.where(hit) if query.strip() else rows


def browse_nodes(nodes: DataFrame, type_: str | None, min_degree: int, n: int) -> DataFrame:
    """The first n nodes by name of a type with enough links."""
    found = nodes.where(F.col("degree") >= min_degree)
    return (found.where(F.col("type") == type_) if type_ else found).orderBy("name").limit(n)


def induced_window(edges: DataFrame, names: DataFrame, requested: int, configured: int, most: int = 5000) -> DataFrame:
    """Edges with both ends among the names, in order of id, at most the least of three limits, each with total and truncated."""
    limit = min(requested, configured, most)
    inner = edges
    for end in ("source", "target"):
        inner = inner.join(names.select(F.col("name").alias(end)).distinct(), end, "left_semi")
    total = inner.agg(F.count("*").alias("total"))
    return inner.orderBy("edge_id").limit(limit).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)


def latest_succeeded(jobs: DataFrame) -> DataFrame:
    """The succeeded job that finished last, the larger id on a tie."""
    return jobs.where("status = 'succeeded'").orderBy(F.desc("finished"), F.desc("job_id")).limit(1)


def best_scored(rows: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k best rows by score, then key; k is held between 1 and 50."""
    return rows.orderBy(F.desc("score"), key).limit(max(1, min(k, 50)))


def search_tables(tables: dict[str, DataFrame], query: list[float], k: int) -> DataFrame:
    """The k most similar vectors of each of several tables, named by ``kind``."""
    out = None
    for kind, vectors in tables.items():
        found = top_k(vectors, query, k).select(F.lit(kind).alias("kind"), "vec_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def audio_candidates(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of found audio vectors (vec_id, recording_id, score); a chunk of another recording is dropped."""
    mine = found.withColumnRenamed("recording_id", "heard_in")
    return mine.join(chunks, "vec_id").where("heard_in = recording_id").drop("heard_in")


def citations(chunks: DataFrame, entities: DataFrame, snippet: int = 200) -> DataFrame:
    """(chunk_id, entity, confidence, snippet): each chunk with its entity of best confidence, the first by name on a tie."""
    best = entities.groupBy("chunk_id").agg(F.min(F.struct((-F.col("rank")).alias("r"), "entity", "confidence")).alias("b"))
    return chunks.join(best, "chunk_id", "left").select(
        "chunk_id", F.coalesce("b.entity", F.lit("未知实体")).alias("entity"), F.coalesce("b.confidence", F.lit("EXTRACTED")).alias("confidence"), F.left(F.coalesce("text", F.lit("")), F.lit(snippet)).alias("snippet")
    )


def named_in(answers: DataFrame, names: DataFrame, key: list[str], column: str = "text", most_words: int = 2) -> DataFrame:
    """(keys, name): the names, of at most so many words, that stand in an answer's words, whatever the case."""
    words = F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    w = answers.select(*key, words.alias("w"))
    runs = [F.col("w")]
    for n in range(2, most_words + 1):
        runs.append(_word_runs(n))
    said = w.select(*key, F.explode(F.array_distinct(F.array_compact(F.concat(*runs)))).alias("name"))
    return said.join(names.select("name").distinct(), "name", "left_semi").select(*key, "name")


def _word_runs(n: int) -> Column:
    def run(x: Column, i: Column) -> Column:
        return F.when(i + n <= F.size("w"), F.array_join(F.slice("w", i + 1, F.lit(n)), " "))

    return F.transform("w", run)


#: How many rows of each part a workspace shows.
CAPS = {"units": 100, "tags": 200, "transitions": 100, "transcript": 300, "provenance": 100}


def workspace(parts: dict[str, DataFrame], start, end, caps: dict[str, int] = CAPS) -> dict[str, DataFrame]:
    """Each part's rows (id, start_sec, end_sec ...) that overlap the window, in order, up to its cap, each with the part's total."""
    out = {}
    for name, rows in parts.items():
        inside = rows.where(F.col("start_sec").isNull() | ((F.col("end_sec") > start) & (F.col("start_sec") < end)))
        total = inside.agg(F.count("*").alias("total"))
        out[name] = inside.orderBy("start_sec", "id").limit(caps[name]).crossJoin(F.broadcast(total))
    return out


def tags_in_window(tags: DataFrame, evidence: DataFrame, start, end) -> DataFrame:
    """Tags with any evidence in the window, and those without any evidence at all."""
    hit = F.coalesce((F.col("end_sec") > start) & (F.col("start_sec") < end), F.lit(True))  # untimed evidence is kept
    by = evidence.groupBy("tag_id").agg(F.bool_or(hit).alias("hit"))
    return tags.join(by, "tag_id", "left").where(F.coalesce("hit", F.lit(True))).drop("hit")


def provenance_page(rows: DataFrame, object_type: str, object_ref, limit: int, offset: int = 0) -> DataFrame:
    """What led to an object, oldest first, each row with the total; no rows means that it is not known."""
    mine = rows.where((F.col("object_type") == object_type) & (F.col("object_ref") == object_ref))
    total = mine.agg(F.count("*").alias("total"))
    return mine.orderBy("at", "id").offset(offset).limit(limit).crossJoin(F.broadcast(total))


def proposals(recordings: DataFrame, judged: DataFrame, visits: DataFrame) -> DataFrame:
    """(visit, recordings, duration, pairs, doubtful): each proposed visit with its pairs by verdict."""
    visits = settled(visits, "visits")  # read three times, folded once
    size = recordings.join(visits, "recording_id").groupBy("visit").agg(F.count("*").alias("recordings"), F.sum(F.col("ended_sec") - F.col("started_sec")).alias("duration"))
    right = visits.select(F.col("recording_id").alias("right_recording_id"), F.col("visit").alias("right_visit"))
    inner = judged.join(visits, "recording_id").join(right, "right_recording_id").where("visit = right_visit")
    pairs = inner.groupBy("visit").agg(F.count("*").alias("pairs"), F.count_if(F.col("verdict") == "needs_review").alias("doubtful"))
    return size.join(pairs, "visit", "left").fillna(0, ["pairs", "doubtful"])


def recording_list(recordings: DataFrame, values: dict[str, list], between: tuple[str, int, int] | None, order: str, page: int, size: int, owner: int | None = None, name: str | None = None) -> DataFrame:
    """A page of recordings with ``total``, the number of all that fit.

    ``values`` names columns with the values they may have; both ends of ``between`` are included.
    The order is a column, with a minus the other way, and ids decide ties. An owner (agent_id) is
    asked for instead of a display name (agent_name), which may change.
    """
    found = recordings
    for column, some in values.items():
        found = found.where(F.col(column).isin(*some))
    if between:
        found = found.where(F.col(between[0]).between(*between[1:]))
    if owner is not None:
        found = found.where(F.col("agent_id") == owner)
    elif name is not None:
        found = found.where(F.col("agent_name") == name)
    way = F.desc if order.startswith("-") else F.asc
    rows = found.orderBy(way(order.lstrip("-")), way("recording_id")).offset((page - 1) * size).limit(size)
    return rows.crossJoin(found.agg(F.count("*").alias("total")))  # one row


def projection(nodes: DataFrame, edges: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) to draw: nodes once each, preferred ones first, up to the cap, and the edges between them."""
    one = nodes.groupBy("id").agg(F.max("preferred").alias("preferred"))
    shown = one.orderBy(F.desc("preferred"), "id").limit(cap)
    inner = edges.dropDuplicates(["edge_id"])
    for end in ("source", "target"):
        inner = inner.join(shown.select(F.col("id").alias(end)), end, "left_semi")
    return shown, inner


def evidence_budget(evidence: DataFrame, order: list[str], refs: int = 512, text_bytes: int = 32 << 10) -> DataFrame:
    """The first pieces of evidence, in order, until there are so many or their texts reach so many bytes.

    Only the first ``refs`` rows can stay, so only these meet in one place.
    """
    from pyspark.sql import Window as W

    first = evidence.orderBy(*order).limit(refs)
    used = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return first.withColumn("used", used).where(F.col("used") <= text_bytes)
