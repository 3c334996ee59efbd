"""Stages of the pipeline, each against what it says it does."""

import corpus_pipeline as pipeline
from faresight.llm import decontaminate, minhash
from faresight.session import materialize

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "mixing"]
    columns, steps = docs.columns, [docs]
    for name, stage in pipeline.STAGES:
        steps.append(materialize(stage(spark, steps[-1], SF), f"test_{name}"))
    assert all(s.columns == columns for s in steps[:-1])
    for before, after in zip(steps, steps[1:-1]):
        assert set(ids(after)) <= set(ids(before)) and after.exceptAll(before).count() == 0
    assert ids(steps[3]) == ids(minhash.near_duplicates(steps[2]).where("kept"))
    leaks = decontaminate.find_leaks(steps[3].select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(steps[4]) == ids(leaks.where("NOT contaminated"))
    assert ids(steps[5]) == ids(steps[4])
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[5].collect()))


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"odd_{name}")
    assert 0 < docs.count() < odd_docs.count()
    docs = no_docs
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"none_{name}")
        assert docs.count() == 0
