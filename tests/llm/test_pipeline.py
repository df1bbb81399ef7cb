"""The corpus pipeline stage by stage on a small table."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        after = spark.read.parquet(f"{tmp_path}/{n}")
        if name == "packing":
            assert {r["doc_id"] for r in after.collect()} == set(before)
            continue
        assert after.columns == COLUMNS
        now = {r["doc_id"]: r["text"] for r in after.collect()}
        assert set(now) <= set(before) and all(len(now[i]) <= len(before[i]) for i in now)
        assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        assert len(now) >= 0.9 * len(before)
        docs, before = after, now


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "substring_dedup", "packing"]
