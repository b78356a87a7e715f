"""The corpus pipeline's stages. Each takes (spark, docs, sf_dir); all but the last return docs' own columns.

Rows with a null doc_id pass the stages that compare documents; every stage takes nulls, empty texts, repeated rows and
empty tables as its operator does, and leaves extra columns as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard_join, pii, quality_cnn
from .langid_ppm import remainder

BROADCAST_ROWS = 1_000_000  # ids up to which they are broadcast; beyond, a shuffled join


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is not in ids(gone)."""
    ids = ids.distinct()
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"] == ids["gone"], "left_anti")


def keep_quality(spark, docs, sf_dir):
    """Documents that the classifier accepts; it is trained on the labelled ones with remainder 0 or 2 modulo 3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(F.col("doc_id"), 3) != 1)
    network = quality_cnn.train(docs, labels)
    name = "score"
    while name in [c.lower() for c in docs.columns]:  # column names clash whatever their case
        name += "_"
    return quality_cnn.score(docs, network, name).where(F.col(name) >= 0.5).select(docs.columns)


def keep_one_of_each_group(spark, docs, sf_dir):
    """Of each group of linked documents the one with the least doc_id; of rows with equal doc_id and text one. Different
    texts under one doc_id stay or go together, as links name documents by their id."""
    found = jaccard_join.jaccard_components(docs)
    kept = _without(docs, found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")))
    repeated = found.groupBy("doc_id").count().where("doc_id is not null and count > 1").limit(1).count()
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).union(kept.where("doc_id is null")) if repeated else kept


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.find_contained(docs, items).select(F.col("doc_id").alias("gone")))


def redact_pii(spark, docs, sf_dir):
    """Documents with every span of personal data replaced by its kind."""
    return pii.redact(docs)


def encode(spark, docs, sf_dir):
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded: the ids' text, equal to what went in."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
