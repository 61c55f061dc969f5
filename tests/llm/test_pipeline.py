"""The stages, each on what its predecessor kept."""

from __future__ import annotations

import corpus_pipeline
from factorloom.llm import exact_dedup, minhash, mixing
from factorloom.llm.common import documents


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = documents(spark, sf).unionByName(spark.createDataFrame([(10**6, "12 ?", "en", "src0", 4), (10**6 + 1, None, "en", "src0", 0)], documents(spark, sf).schema))
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = sorted(r["doc_id"] for r in docs.collect())
        assert name == "encode" or docs.columns == columns
        if name == "language":
            assert ids[name] == [r["doc_id"] for r in before.filter("doc_id < 1000000").orderBy("doc_id").collect()]
        if name == "exact_dedup":
            assert ids[name] == sorted(r["doc_id"] for r in exact_dedup.exact_dedup(before).filter("kept").collect())
        if name == "near_dedup":
            assert ids[name] == sorted(r["doc_id"] for r in minhash.near_components(before).filter("kept").collect())
        if name == "mix":
            assert set(ids[name]) == {r["doc_id"] for r in mixing.mix(before).filter("taken > 0").collect()}
    assert ids["encode"] == ids["mix"] and ids["exact_dedup"] < ids["language"] or len(ids["exact_dedup"]) < len(ids["language"])
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == sorted(ids_of_run(spark, sf))


def ids_of_run(spark, sf):
    docs = documents(spark, sf)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    return [r["doc_id"] for r in docs.collect()]
