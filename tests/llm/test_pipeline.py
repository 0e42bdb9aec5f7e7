"""The corpus pipeline, stage by stage."""

import shutil

import corpus_pipeline
from leadquarry.llm import decontaminate, near_dedup


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        rows = docs.collect()
        assert {r.doc_id for r in rows} <= set(before) and rows
        if name != "sharding":
            assert docs.columns == columns and all(before[r.doc_id] == r.text for r in rows)
        if name == "near_duplicates":
            again = near_dedup.near_duplicates(kept, near_dedup.NEAR_TEXTS).collect()
            assert {r.doc_id for r in rows} == {r.component_id for r in again} and len(rows) == len({r.component_id for r in again})
        if name == "decontamination":
            assert decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect() == []
            texts = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not [1 for r in rows for t in texts if t in (r.text or "")]
        if name == "sharding":
            assert docs.count() == kept.count() and all(r.grown_shard in (r.shard, 40) for r in rows)
        kept = docs


def test_odd_and_empty_tables(spark, sf, odd, empty, tmp_path):
    for table in ("labels", "benchmark"):
        shutil.copy(f"{sf}/{table}.parquet", tmp_path)
    for name, docs in (("odd", odd), ("empty", empty)):
        for i, (step, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if step != "sharding":
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")
        assert (docs.count() > 0) == (name == "odd")
