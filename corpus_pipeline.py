"""A training corpus in five stages: judge quality, drop near copies, remove benchmark text, redact, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echogrid.llm.cotraining import judged
from echogrid.llm.decontaminate import decontaminated
from echogrid.llm.jaccard import jaccard_components
from echogrid.llm.packing import pack
from echogrid.llm.pii import redacted
from echogrid.llm.tables import stored, table
from echogrid.registry import query

NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return judged(docs, table(spark, sf_dir, "labels")).where("kept").select("row.*")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that `docs` does not use."""
    while name in docs.columns:
        name += "_"
    return name


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Rows that share a doc_id are documents of their own unless their texts link; rows that share doc_id and text are copies, of
    which one stays. Texts without words and rows without a doc_id belong to no group and stay.
    """
    node, doc, sha = (_free(docs, name) for name in ("node", "of_doc", "sha"))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    grouped = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    texts = docs.where(grouped).select(F.col("doc_id").cast("long").alias(doc), digest.alias(sha))
    repeated = texts.groupBy(doc).agg(F.count("*").alias("n")).where("n > 1").select(doc)
    several = stored(texts.join(repeated, doc, "left_semi").groupBy(doc).agg(F.min(sha).alias("low"), F.max(sha).alias("high")).where("low <> high").select(doc, "low"), "several")
    nodes, shared = docs.withColumn(node, F.col("doc_id").cast("long")), several.limit(1).count() > 0
    if shared:
        # the first text of a doc_id keeps it as node, its others get numbers below all doc_ids
        floor = F.least(docs.agg(F.min(F.col("doc_id").cast("long")).alias("least")).scalar(), F.lit(0))
        others = texts.join(several, doc).where(F.col(sha) != F.col("low")).select(doc, sha).distinct()
        others = stored(others.withColumn("number", F.monotonically_increasing_id()), "others").select(doc, sha, (floor - 1 - F.col("number")).alias(f"{node}_"))
        met = docs.withColumn(doc, F.when(grouped, F.col("doc_id").cast("long"))).withColumn(sha, digest).join(others, [doc, sha], "left")
        nodes = met.select(*docs.columns, F.coalesce(f"{node}_", F.col("doc_id").cast("long")).alias(node))
    parts = jaccard_components(nodes.where(grouped).select(F.col(node).alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT).select(F.col("doc_id").alias(node), "component_id").distinct()
    if shared:
        parts = parts.join(nodes.where(grouped).select(node, F.col("doc_id").alias(doc)).distinct(), node)
    heads = parts.groupBy("component_id").agg(F.min_by(node, F.struct(doc, node) if shared else F.col(node)).alias(node)).select(node)
    kept = nodes.where(grouped).join(heads, node, "left_semi").dropDuplicates([node])
    return kept.select(*docs.columns).unionByName(docs.where(~grouped))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark passage."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 token ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality_classifier", quality), ("ngram_jaccard_join", near_copies), ("benchmark_decontamination", benchmark_free), ("pii", private), ("packing", packed)]
#: No SQL form: classifier, redaction model and packing are fitted; tests hold every stage and run() against brute force.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
