import os

import corpus_pipeline
from llm_brute import base_spans, near_groups

from tiltscale.llm.common import ranked

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


def test_stages_one_by_one(spark, documents):
    docs = documents
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name != "packing":
            assert out.columns == documents.columns
        ids[name] = {r.doc_id: r for r in out.collect()}
        if name == "near_dedup":
            before = docs.orderBy("doc_id").collect()
            groups, _ = near_groups([r.text for r in before], 5, 80)
            assert set(ids[name]) == {before[i].doc_id for i, g in enumerate(groups) if i == g}
        if name == "pii":
            assert set(ids[name]) == set(ids["near_dedup"])
            for doc, row in ids[name].items():
                was = ids["near_dedup"][doc]
                assert not base_spans(row.text) and row.n_chars == len(row.text)
                assert base_spans(was.text) or row == was
        docs = out
    # The documents hold words of the four languages only, so language ID keeps them all.
    assert len(ids["language_id"]) == documents.count()
    assert set(ids["packing"]) == set(ids["pii"])


def test_run_is_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    full = {}
    for r in rows:
        full[r.sequence_id] = full.get(r.sequence_id, 0) + r.length
    assert max(full.values()) <= 4096
    assert len(full) <= -(-sum(full.values()) // 4096) + 2


def test_odd_rows_go_through(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents.withColumn("row", no_documents.doc_id)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()


def test_ranks_within_groups(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 = 0 as g").repartition(7)
    rows = ranked(df, ["g"], ["id"], 5).collect()
    for g in (True, False):
        own = sorted(r["rank"] for r in rows if r.g == g)
        assert own == list(range(len(own)))
