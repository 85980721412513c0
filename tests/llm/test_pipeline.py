"""The stages of the pipeline in order, each on what the one before kept."""

import corpus_pipeline
from loomgraph.llm import queries as llm
from loomgraph.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near-duplicates", "mixing", "packing"]
    ids, kept = {r.doc_id for r in docs.select("doc_id").collect()}, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        now = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        assert now <= ids
        ids = now
        kept.append((docs.count(), docs.columns))
    assert [k[1] for k in kept[:4]] == [corpus_pipeline.COLUMNS] * 4
    counts = [k[0] for k in kept[:4]]
    assert counts[0] == counts[1] >= counts[2] >= counts[3] > 0.5 * counts[0]


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())


def test_one_query_for_each_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in llm.queries()) == list(range(1, 14))
