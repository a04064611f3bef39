"""The pipeline's stages against plain versions of their decisions."""

import numpy as np

import corpus_pipeline
from colloquy.llm import bpe, decontaminate, dedup, quality, secrets
from tests.llm.test_dedup import brute as groups
from tests.llm.test_secrets import brute as spans

D = "/root/testdata/sf0.001"


def masked(text):
    out, at = "", 0
    for s, _, e in spans(text)[1]:
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def test_stages_and_run(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher(list(enumerate(items)))
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in now.collect()}
        out = stage(spark, now, D)
        rows = {r.doc_id: r for r in out.collect()}
        if name != names[-1]:
            assert out.columns == columns
        if name == "quality classifier":
            bad = {r.doc_id for r in quality.classify(now.select("doc_id", "text"), spark.read.parquet(f"{D}/labels.parquet")).where("rejected").collect()}
            want = set(before) - bad
            assert bad
        elif name == "minhash near-dedup":
            want = {d for d, n, _, kept in groups([(r.doc_id, r.text) for r in before.values()], share=80) if kept or not n}
        elif name == "benchmark decontamination":
            want = {d for d, r in before.items() if not matcher.search(decontaminate.normal(r.text))}
        else:
            want = set(before)
        assert set(rows) == want, name
        for d, r in rows.items():
            if name == "secret scans":
                assert r.text == masked(before[d].text) and r.n_chars == len(r.text)
            elif name == "bpe encoding":
                ids = lib.encode(before[d].text, add_special_tokens=False).ids
                assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
            else:
                assert r == before[d]
        now = spark.createDataFrame(list(rows.values()), out.schema) if name != names[-1] else now
    final = {r.doc_id: bytes(r.token_ids) for r in corpus_pipeline.run(spark, D).collect()}
    assert final == {d: bytes(r.token_ids) for d, r in rows.items()}
    assert dedup and secrets
