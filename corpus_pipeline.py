"""A training corpus from raw documents: language, near duplicates, personal data, packing."""

from pyspark.sql import functions as F

from tiltscale.llm import language_id, near_dup, packing, pii
from tiltscale.llm.common import table, written


def identified(spark, docs, sf_dir):
    """Documents in a language that the labelled ones teach; the others go."""
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.accepted(docs, model)


def deduplicated(spark, docs, sf_dir):
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return near_dup.without_duplicates(docs, k=5, percent=80)


def redacted(spark, docs, sf_dir):
    """Personal data replaced by its kind; ``n_chars`` is that of the new text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packed(spark, docs, sf_dir):
    """Pieces of documents with their training sequence and place in it."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identified),
    ("near_dedup", deduplicated),
    ("pii", redacted),
    ("packing", packed),
]

# Models, signatures and packing plans are no SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage; each stage reads what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
