"""The pipeline over the smallest tables: columns, whole rows, and decisions that take effect."""

import corpus_pipeline
from orderloom.llm.store import stored

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER))
        assert docs.columns == columns, name
        assert docs.count() <= before, name
        before = docs.count()
    texts = [r.text for r in docs.collect()]
    assert before > 150 and not any(item in text for item in items for text in texts)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert out.count() == before == corpus_pipeline.run(spark, FOLDER).count()
