from collections import Counter

import corpus_pipeline
from compare import DATA
from docs_fixture import empty_docs, odd_docs
from test_duplicates import brute_suffix, groups
from tideline.llm import packing, quality


def test_stages_on_odd_and_empty_rows(spark):
    for docs in (odd_docs(spark), empty_docs(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, f"{DATA}/sf0.001")
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, f"{DATA}/sf0.001").count() >= docs.count()


def test_run_against_brute_force(spark, tmp_path):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    left = [tuple(r) for r in docs.select("doc_id", "text").collect() if scores[r["doc_id"]]]
    comp = groups(left)
    left = [(i, t) for i, t in left if comp[i] == i]
    lost = {r[0]: r for r in brute_suffix(left)}
    out = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = spark.createDataFrame(stage(spark, out, sf).collect(), docs.schema)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(got) == {i for i, _ in left}
    for i, t in got.items():
        n = lost[i][1] - lost[i][2]
        assert n - 6 * lost[i][3] <= len(t.encode()) <= n  # characters cut in two go
    mixed = corpus_pipeline.STAGES[3][1](spark, out, sf)
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= set(got) and max(times.values()) <= 2
    rows = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == times
    assert packing.pack(mixed).count() == len(rows)
