"""The registered opN queries: each operator with production parameters on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe, decontaminate, dedup, fillmiddle, jaccardjoin, licences, lzprint, mainpage, quality, repair, secrets, suffixtree, warc
from colloquy.llm.oracles import ORACLES  # noqa: F401
from colloquy.llm.shared import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return secrets.scan(docs).select(
        F.col("row.doc_id").alias("doc_id"),
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.listed("base"), 256).alias("base_sha256"),
        secrets.listed("spans").alias("spans"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.decode(bpe.encode(docs).select("doc_id", "token_ids"))
    return done.select(
        "doc_id",
        F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lzprint.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return mainpage.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "poor", "toxic", "rejected")


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.report(repair.damaged(conversations), every=conversations.select("conv_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardjoin.joined(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fillmiddle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hashed = F.sha2("output", 256).alias("output_sha256"), F.sha2(fillmiddle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_bpe": op2_bpe,
    "op3_warc": op3_warc,
    "op4_decontaminate": op4_decontaminate,
    "op5_lz_fingerprint": op5_lz_fingerprint,
    "op6_main_text": op6_main_text,
    "op7_quality": op7_quality,
    "op8_suffix_tree": op8_suffix_tree,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_licences": op10_licences,
    "op11_repair": op11_repair,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_fill_in_middle": op13_fill_in_middle,
}
