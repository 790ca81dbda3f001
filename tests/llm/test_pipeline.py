from llm_cases import ROWS, none, odd

import corpus_pipeline
from pagewright.llm.queries import QUERIES


def test_stages_chain_and_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "test")
        counts.append(docs.count())
        if number < 4:
            assert docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    assert counts[4] == counts[5] and docs.where("NOT round_trip").count() == 0


def test_stages_on_odd_and_no_rows(spark, sf):
    for make, most in ((odd, len(ROWS)), (none, 0)):
        docs = make(spark)
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = corpus_pipeline.stored(stage(spark, docs, sf), "test")
            assert docs.columns == make(spark).columns and docs.count() <= 2 * most
        assert corpus_pipeline.STAGES[4][1](spark, docs, sf).count() == docs.count()


def test_run_and_registry(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
