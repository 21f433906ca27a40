"""Queries of the operators, each over its whole table, and their SQL where there is any."""

from pyspark.sql import functions as F

from tiltscale.llm import (
    ann,
    hilbert,
    language_id,
    licenses,
    metric_topk,
    near_dup,
    packing,
    periodic_runs,
    pii,
    secret_scan,
    segmentation,
    token_alignment,
    token_store,
)
from tiltscale.llm.common import scratch, table


def op1_language_id(spark, sf_dir):
    return language_id.learn_and_identify(table(spark, sf_dir, "documents"))


def op2_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_multi_index_hashing(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=5, is_query="vec_id % 50 = 0")


def op5_nbest_segmentation(spark, sf_dir):
    return segmentation.segment(table(spark, sf_dir, "documents"))


def op6_hilbert_sharding(spark, sf_dir):
    return hilbert.shard_by_curve(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op7_minhash_near_dedup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op8_token_store(spark, sf_dir):
    path = token_store.write_store(table(spark, sf_dir, "documents"), scratch(spark, "store"))
    return token_store.read_back(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_license_alignment(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_metric_tree_topk(spark, sf_dir):
    return metric_topk.top_products(table(spark, sf_dir, "embeddings"), k=5, is_query="vec_id % 50 = 0", scale=256)


def op11_token_alignment(spark, sf_dir):
    return token_alignment.report(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.report(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark, sf_dir):
    return secret_scan.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_pii": op2_pii,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_multi_index_hashing": op4_multi_index_hashing,
    "op5_nbest_segmentation": op5_nbest_segmentation,
    "op6_hilbert_sharding": op6_hilbert_sharding,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_token_store": op8_token_store,
    "op9_license_alignment": op9_license_alignment,
    "op10_metric_tree_topk": op10_metric_tree_topk,
    "op11_token_alignment": op11_token_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_secret_scan": op13_secret_scan,
}

ORACLES = {}
