"""A quality classifier from weak labels.

Heuristic labellers vote on every document: bad, good or nothing. Expectation-maximisation over
the counts of vote patterns (all documents; at most 3^labellers patterns, so these small counts
alone come to the driver) estimates how often each labeller says what about bad and good
documents, without anyone telling which is right. The posterior of a document's pattern is its
soft label, and a linear scorer over hashed features learns from the soft labels of a bounded
sample of documents, half of it labelled by people and half not where there are enough of both. The scorer, not the heuristics, decides about each document.

Two such models stand side by side: one for poor text, one for toxic text. People who labelled
documents are one more labeller, whose silence says nothing and whose accuracy is estimated with
the others' from a strong prior (``TRUST``) that does not grow with their labels; this keeps the
estimates from taking two heuristics that agree with each other for the truth. Documents without a human
label are taught the posterior of their votes and nothing else.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import cut

#: The scorer learns from about this many documents, as feature numbers in the shared folder: up to half of them
#: with a human label and up to half without, at every size.
TRAIN_ROWS = 20_000
FEATURES = 1 << 17
#: Steps of the fit, and features of the sample that it passes over at once, about.
STEPS, FIT_PART = 60, 1 << 20
#: The scorer's pull to zero.
REGULAR = 6e-5
#: Rows of which no heuristic says anything teach as much as so many in all the human labels on such rows and these.
WORTH = 10
#: How often people are right before anything is known, which counts as much as so many labels.
TRUST, TRUST_ROWS = 0.999, 1_000
#: A document is rejected when either scorer finds this chance.
THRESHOLD = 0.5
#: Words of abuse by kind, and phrases of it.
INSULTS = frozenset(
    """idiot idiots moron morons scum trash loser losers clown clowns filth imbecile imbeciles jerk jerks dimwit dimwits halfwit halfwits
    scumbag scumbags lowlife lowlifes vermin parasite parasites cretin cretins degenerate degenerates dunce dunces garbage creep creeps
    idiota imbécil estúpido idiote imbécile crétin abruti trottel vollidiot depp dummkopf abschaum""".split()
)
SLURS = frozenset(
    """stupid pathetic worthless disgusting dumb brainless idiotic moronic despicable loathsome repulsive revolting braindead spineless
    clueless hopeless ridiculous repugnant contemptible subhuman rotten wretched asqueroso patético stupide pathétique dégoûtant
    dumm erbärmlich widerlich wertlos""".split()
)
HOSTILE = re.compile(r"\b(?:shut up|get lost|drop dead|go to hell|hate you|kill yourself|piss off|screw you|nobody likes you|you people|you make me sick)\b")
YOU = frozenset("you your youre yours u ur du ihr tu vous usted".split())
#: The commonest words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    """the of and to in a is it that was for on with he as his be at by this had not are but from or have an they which one you were her all
    der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei um noch
    le la les de des et un une du que est dans pour sur pas au ne se par avec qui ce il plus en el los las y del que por con una su para es lo como más""".split()
)
SYMBOLS = "*#$%&|!~^<>{}\\@+=_"
WORD = re.compile(r"[^\W_]+")
#: Models and how many labellers vote for each.
MODELS = {"poor": 8, "toxic": 4}


def measures(text: str, words: list[str]) -> dict[str, float]:
    """Shares that both the labellers and the scorer's features use."""
    parts = text.split()
    n, k = max(1, len(text)), max(1, len(parts))
    return {
        "symbols": sum(map(text.count, SYMBOLS)) / n,
        "upper": sum(map(str.isupper, parts)) / k,
        "letters": sum(map(len, words)) / n,
        "repeats": sum(map(operator.eq, parts, parts[1:])) / k,
        "bars": text.count("|") / k,
    }


def votes(text: str) -> str:
    """One letter a labeller, b for bad, g for good, - for none; the poor ones first, then the toxic ones.

    Poor: many symbols, many words in capitals, few or many letters, words that repeat the one
    before, many bars, repeated lines, a small vocabulary for the length, few or many function
    words. Toxic: words that name people with contempt, words that judge with it, hostile
    phrases, and either kind of word within three words of an address.
    """
    lower = text.lower()
    words = WORD.findall(lower)
    m, known, n = measures(text, words), set(words), len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    common = sum(map(FUNCTION_WORDS.__contains__, words)) / max(1, n)
    abuse = known & INSULTS, known & SLURS
    near = any(abuse) and bool(known & YOU) and any(w in YOU and any(x in INSULTS or x in SLURS for x in words[max(0, i - 3) : i + 4]) for i, w in enumerate(words))
    bad = [
        m["symbols"] > 0.03, m["upper"] > 0.3, m["letters"] < 0.6 and text.strip() != "", m["repeats"] > 0.1, m["bars"] > 0.1, len(lines) >= 4 and len(set(lines)) <= len(lines) / 2,
        n >= 50 and len(known) < 2 * n**0.5, n >= 40 and common < 0.02, bool(abuse[0]), bool(abuse[1]), HOSTILE.search(lower) is not None, near,
    ]
    out = ["b" if x else "-" for x in bad]
    if m["letters"] > 0.85:
        out[2] = "g"
    if n >= 40 and common > 0.15:
        out[7] = "g"
    return "".join(out)


def features(text: str) -> list[int]:
    """Numbers of the hashed features: distinct words, their first four letters, and marks for the shares in steps."""
    words = WORD.findall(text.lower())
    m = measures(text, words)
    known = set(words)
    names = [*known, *{"\x02" + w[:4] for w in known}]
    for k in ("symbols", "upper", "repeats", "bars"):
        names += [f"\x01{k}{i}" for i in range(min(4, -int(-m[k] * 20 // 1)))]
    if m["letters"] < 0.6 and text.strip():
        names.append("\x01letters")
    crc, mask = zlib.crc32, FEATURES - 1
    return list({crc(x.encode()) & mask for x in names})


def posterior(counts: dict[str, float], human: bool = False, rounds: int = 100) -> dict[str, float]:
    """The chance of "bad" for each pattern of votes, by expectation-maximisation.

    A pattern is a string of b, g and -; its last letter is the human label if ``human`` is set.
    A weak prior holds that labellers are right rather than wrong, and keeps chances off 0 and 1.
    Beside human labels heuristics are not taken to be independent where none says bad, as they miss the
    same kinds of text: that all are silent, that some say good and none bad, or that some say bad is the vote
    of one labeller more. Only in the last case each vote counts too, and the silence of all others as that of one.
    """
    if not counts:
        return {}
    patterns = np.array([list(p) for p in counts])
    weight = np.array(list(counts.values()), float)
    heard = patterns[:, :-1] if human else patterns
    accused = (heard == "b").any(1)
    bad = np.where(accused, 0.9, 0.05)
    seen = np.stack([patterns == v for v in "-gb"], 2).astype(float)  # pattern, labeller, vote
    tells = seen.copy()
    prior = np.repeat([[[5.0, 5.0, 0.1]], [[5.0, 0.5, 5.0]]], patterns.shape[1], 1)  # class good, class bad
    if human:
        told = patterns[:, -1]
        bad = np.where(told == "b", TRUST, np.where(told == "g", 1 - TRUST, bad))
        tells[:, :-1, 0] /= heard.shape[1]
        tells[~accused, :-1] = 0
        seen[:, -1, 0] = tells[:, -1, 0] = 0  # no label says nothing
        prior[:, -1] = [[0, TRUST * TRUST_ROWS, (1 - TRUST) * TRUST_ROWS], [0, (1 - TRUST) * TRUST_ROWS, TRUST * TRUST_ROWS]]
        kind = np.where(accused, 2, np.where((heard == "g").any(1), 1, 0))
        joint = (kind[:, None] == np.arange(3)).astype(float)[:, None]
        seen, tells = np.concatenate((seen, joint), 1), np.concatenate((tells, joint), 1)
        prior = np.concatenate((prior, [[[5.0, 5.0, 0.1]], [[5.0, 0.5, 5.0]]]), 1)
    for _ in range(rounds):
        share = (weight @ bad + 1) / (weight.sum() + 10)
        logs = []
        for c, p in ((0, 1 - bad), (1, bad)):
            said = np.einsum("i,ijk->jk", weight * p, seen) + prior[c]
            with np.errstate(divide="ignore", invalid="ignore"):
                chance = np.log(said / said.sum(1, keepdims=True))
            logs.append(np.einsum("ijk,jk->i", tells, np.where(said > 0, chance, 0.0)))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log(1 - share) - np.log(share), -700, 700)))
        if np.abs(new - bad).max() < 1e-9:
            break
        bad = new
    return {p: float(b) for p, b in zip(counts, bad)}


def least_loss(loss, n: int, pull: float, steps: int = STEPS, memory: int = 10) -> np.ndarray:
    """The x that makes loss(x) + pull * |x| least, its last entry (the intercept) free of the pull.

    Limited-memory quasi-Newton steps that stay within an orthant, as the pull has no slope at zero.
    ``loss`` gives the value and the slope.
    """
    x = np.zeros(n)
    pulls = np.full(n, pull)
    pulls[-1] = 0.0
    value, slope = loss(x)
    best = value + pulls @ np.abs(x)
    moved: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        up, down = slope + pulls, slope - pulls
        steep = np.where(x > 0, up, np.where(x < 0, down, np.where(up < 0, up, np.where(down > 0, down, 0.0))))
        d, shares = -steep, []
        for s, y in reversed(moved):
            shares.append((s @ d) / (s @ y))
            d = d - shares[-1] * y
        if moved:
            s, y = moved[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), share in zip(moved, reversed(shares)):
            d = d + (share - (y @ d) / (s @ y)) * s
        d[d * steep >= 0] = 0.0
        if not d.any():
            break
        side = np.where(x != 0, np.sign(x), -np.sign(steep))
        length = 1.0 if moved else 1.0 / max(1.0, np.abs(steep).sum())
        for _ in range(40):
            new = x + length * d
            new[new * side < 0] = 0.0
            value, new_slope = loss(new)
            total = value + pulls @ np.abs(new)
            if total <= best + 1e-4 * (steep @ (new - x)):
                break
            length /= 2
        else:
            break
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            moved = [*moved, (s, y)][-memory:]
        gain, x, slope, best = best - total, new, new_slope, total
        if gain < 1e-6 * best:
            break
    return x


def fit_scorer(ids: np.ndarray, lengths: np.ndarray, soft: np.ndarray, weight: np.ndarray) -> tuple[float, dict[int, float]]:
    """(intercept, weights that aren't zero) of a logistic scorer: ``ids`` holds each row's features one after another,
    ``soft`` its chance of being bad. Rows are passed over in parts, so that little memory is held."""
    if not len(soft) or soft.max() < THRESHOLD:
        return -10.0, {}
    if (1 - soft).max() <= 0.001:
        return 10.0, {}
    known, place = np.unique(ids, return_inverse=True)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + FIT_PART, FIT_PART)).clip(0, len(lengths)))
    weight = weight / weight.sum()
    n = len(known) + 1

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope = 0.0, np.zeros(n)
        for i, j in zip(cuts, cuts[1:]):
            at, of = place[ends[i] : ends[j]], np.repeat(np.arange(j - i), lengths[i:j])
            z = np.bincount(of, x[at], j - i) + x[-1]
            value += weight[i:j] @ (np.logaddexp(0, z) - soft[i:j] * z)
            wrong = weight[i:j] * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - soft[i:j])
            slope[:-1] += np.bincount(at, wrong[of], n - 1)
            slope[-1] += wrong.sum()
        return float(value), slope

    x = least_loss(loss, n, REGULAR)
    return float(x[-1]), {int(known[i]): float(x[i]) for i in np.flatnonzero(x[:-1])}


def learn(rows: DataFrame) -> dict[str, tuple[float, dict[int, float]]]:
    """The scorer of each model from the sample's (ids, soft_.., weight_..); one task a model, as the sample is bounded."""
    both = [F.struct(F.lit(m).alias("model"), F.col(f"soft_{m}").alias("soft"), F.col(f"weight_{m}").alias("weight")) for m in MODELS]

    def fitted(table):
        import pyarrow as pa

        lists = table.column("ids").combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        columns = [table.column(c).to_numpy().astype(float) for c in ("soft", "weight")]
        intercept, weights = fit_scorer(lists.flatten().to_numpy(zero_copy_only=False), lengths, *columns)
        ids = [-1, *weights]
        return pa.table({"model": pa.array([table.column("model")[0].as_py()] * len(ids), pa.string()), "id": pa.array(ids, pa.int32()), "w": pa.array([intercept, *weights.values()], pa.float64())})

    found: dict[str, dict[int, float]] = {m: {-1: -10.0} for m in MODELS}
    for r in rows.select("ids", F.explode(F.array(*both)).alias("m")).select("ids", "m.*").groupBy("model").applyInArrow(fitted, "model string, id int, w double").collect():
        found[r.model][r.id] = r.w
    return {m: (w.pop(-1), w) for m, w in found.items()}


def _mapped(df: DataFrame, column: int, make, schema: str):
    """``df`` with values made from one text column at the end, batch by batch."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            new = make([t or "" for t in batch.column(column).to_pylist()])
            keep = [i for i in range(batch.num_columns) if i != column]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *[pa.array(v, k) for v, k in new]], names=[*[batch.schema.names[i] for i in keep], *[f"v{i}" for i in range(len(new))]])

    return df.mapInArrow(run, schema)


def draw(base: DataFrame, told: DataFrame, labelled: int, others: int) -> DataFrame:
    """Rows of about ``TRAIN_ROWS`` / 2 labelled ids and about as many rows without a label, or all there are.

    The former are taught with their labels, the latter with what the estimates say of their votes.
    """
    share = lambda n: int(min(1.0, TRAIN_ROWS / 2 / max(1, n)) * 1_000_003)
    pool = told.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) <= share(labelled))
    some = base.where(F.pmod(F.xxhash64("doc_id", "whole"), F.lit(1_000_003)) <= share(others)).join(told.select("doc_id"), "doc_id", "left_anti")
    return base.join(F.broadcast(pool), "doc_id").unionByName(some, allowMissingColumns=True)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", vote=votes) -> dict[str, tuple[float, dict[int, float]]]:
    """Vote counts over all rows, posteriors, and a scorer for each model from a bounded sample.

    ``vote`` makes the letters of a text's labellers, as many as ``MODELS`` says.
    """
    import pyarrow as pa

    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole.alias("whole"))
    letter = lambda c, bad: F.when(c.isNull(), "-").when(bad, "b").otherwise("g")
    told = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("abusive"))
    told = told.select("doc_id", letter(F.col("quality"), F.col("quality") == 0).alias("human_poor"), letter(F.col("abusive"), F.col("abusive") == 1).alias("human_toxic"))
    said = _mapped(base, 1, lambda ts: [([vote(t) for t in ts], pa.string())], "doc_id long, said string")
    human = [F.coalesce(f"human_{m}", F.lit("-")).alias(f"human_{m}") for m in MODELS]
    counted = said.join(told, "doc_id", "left").groupBy("said", *human).count().collect()
    counts: dict[str, Counter] = {m: Counter() for m in MODELS}
    at = dict(zip(MODELS, np.cumsum([0, *MODELS.values()])))
    part = lambda s, m: s[at[m] : at[m] + MODELS[m]]
    for r in counted:
        for m in MODELS:
            counts[m][part(r.said, m) + r[f"human_{m}"]] += r["count"]
    believed = {m: posterior(counts[m], human=True) for m in MODELS}
    sample = draw(base, told, told.count(), sum(r["count"] for r in counted if r.human_poor == r.human_toxic == "-")).select("doc_id", "whole", *human)
    rows = _mapped(sample, 1, lambda ts: [([vote(t) for t in ts], pa.string()), ([sorted(features(t)) for t in ts], pa.list_(pa.int32()))], "doc_id long, human_poor string, human_toxic string, said string, ids array<int>")
    for m in MODELS:
        # rows without any vote teach as far as people have not labelled such rows
        silent = "-" * MODELS[m]
        quiet = WORTH / (WORTH + counts[m][silent + "b"] + counts[m][silent + "g"])
        known = [(p, b, quiet if p == silent + "-" else 1.0) for p, b in believed[m].items()]
        table = docs.sparkSession.createDataFrame(known, f"pattern_{m} string, soft_{m} double, weight_{m} double")  # at most 3^(labellers + 1) rows
        pattern = F.concat(F.substring("said", int(at[m]) + 1, MODELS[m]), F.col(f"human_{m}"))
        rows = rows.withColumn(f"pattern_{m}", pattern).join(F.broadcast(table), f"pattern_{m}")
    return learn(cut(rows.select("ids", *[f"{k}_{m}" for k in ("soft", "weight") for m in MODELS]), "taught"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", vote=votes) -> DataFrame:
    """(row, doc_id, poor, toxic, rejected) for every row of ``docs``, the row as a struct.

    Null texts count as empty; a text without anything but white space is never rejected. Rows
    that repeat stay; several labels of one id count as its worst; without labels the heuristics
    vote alone.
    """
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text, vote))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    base = docs.select(row, F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("whole"))

    def chances(texts: list[str]):
        import pyarrow as pa

        out: dict[str, list[float]] = {m: [] for m in MODELS}
        for t in texts:
            found = features(t)
            for m, (intercept, weights) in models.value.items():
                margin = intercept + sum(weights[i] for i in found if i in weights)
                out[m].append(1 / (1 + np.exp(-margin)) if t.strip() else 0.0)
        rejected = [max(p) >= THRESHOLD for p in zip(*out.values())]
        return [*[(v, pa.float64()) for v in out.values()], (rejected, pa.bool_())]

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("row", base.schema["row"].dataType), T.StructField("doc_id", T.LongType()), *[T.StructField(m, T.DoubleType()) for m in MODELS], T.StructField("rejected", T.BooleanType())])
    return _mapped(base, 2, chances, schema)


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`classify` rejects; columns and other rows stay."""
    return classify(docs, labels, id_col, text).where(~F.col("rejected")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
