from __future__ import annotations

import corpus_pipeline
from sweepframe.llm import decontaminate, resemblance


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "token_ids":
            assert out.columns == docs.columns, name
            before, after = docs.collect(), out.collect()
            assert set(after) <= set(before), name
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
            if name == "near_copies":
                classes = {r["doc_id"]: r["component_id"] for r in resemblance.classes(docs).collect()}
                assert gone == {d for d, c in classes.items() if d != c}
            if name == "decontamination":
                bench = spark.read.parquet(f"{tables}/benchmark.parquet")
                assert gone == {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()}
        sizes.append(out.count())
        docs = out
    assert sizes[0] >= 190 and sizes == sorted(sizes, reverse=True) and sizes[-1] > 50
    assert corpus_pipeline.run(spark, tables).count() == sizes[-1]


def test_odd_rows(spark, odd, none, tables):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
    docs.collect()
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
    assert docs.count() == 0
