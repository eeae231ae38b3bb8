"""The pipeline's stages, each on its own input, against brute force."""

import corpus_pipeline as cp

from tests.llm.test_jaccard import brute
from tests.llm.test_secrets import base

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES:
        before = docs.collect()
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = out.collect()
        if name != "best_fit_packing":
            assert out.columns == columns and rows
        ids = {r.doc_id for r in rows}
        if name == "language_id":
            assert len(rows) >= 0.99 * len(before)
        if name == "ngram_jaccard":
            assert ids == {d for d, n, c in brute([(r.doc_id, r.text) for r in before], 5, 80) if not n or d == c}
        if name == "secret_scan":
            assert ids == {r.doc_id for r in before} and not any(base(r.text)[1] for r in rows) and all(len(r.text) == r.n_chars for r in rows)
            texts = {r.doc_id: r.text for r in before}
            assert all(texts[r.doc_id] == r.text or "[secret]" in r.text for r in rows) and any("[secret]" in r.text for r in rows)
        if name == "soft_mixing":
            clean = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").filter("quality = 1 and toxic = 0").collect()} & {r.doc_id for r in before}
            assert len(clean & ids) >= 0.97 * len(clean) and {(r.doc_id, r.text) for r in rows} <= {(r.doc_id, r.text) for r in before}
        if name == "best_fit_packing":
            assert ids == {r.doc_id for r in before}
        docs = out


def test_run_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is cp.run and [k for k in entry.queries() if k.startswith("op")] and cp.run(spark, DIR).count() > 0
