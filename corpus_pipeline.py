"""The corpus pipeline: stages over documents, each one operator of tachado.llm.

Each stage takes what its predecessor kept and its decisions take effect: rejected documents go, one document
of each near-duplicate group stays, repeated stretches leave the texts, the mixture takes each source's share,
and what remains is packed into windows. SQL can't express the stages (trees, fingerprints, subword ids), so
there is no ORACLE_SQL; tests/llm checks each stage and the whole against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tachado.llm import mixing, packing, quality, simhash, subdedup
from tachado.llm.bpe import public_path
from tachado.llm.common import fresh, materialise, text_of, without
from tachado.llm.queries import LEVELS, VOCABULARY, WEIGHTS, with_domain

#: Share of the tokens at hand that the mixture budgets; a document is taken once at most.
SHARE = 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = F.col(fresh("_predicted", docs.columns)) == 1
    return quality.scores(docs, model, docs.columns).where(kept).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of SimHash links the document of the smallest doc_id; documents without an id stay.

    Rows that repeat the smallest doc_id all stay. Rows are judged one by one: of different texts under one doc_id
    each stays or goes by its own component.
    """
    row = fresh("_row", docs.columns)
    marked = docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), text_of("text"))))
    groups = simhash.near_duplicates(marked, carry=[row])
    gone = groups.where("component_id <> doc_id").select(row).distinct()
    return without(marked, row, gone).select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without stretches that an earlier document keeps; n_chars follows the text."""
    out, changed = subdedup.dedup(docs), F.col(fresh("_stretches", docs.columns)) > 0
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each domain-language-source's share of the budget, every document once at most."""
    tree = with_domain(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "lang", "source"))
    return mixing.mix(tree, LEVELS, WEIGHTS, epochs=1, share=SHARE).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents by sequence of at most 4096 tokens."""
    return packing.pack(docs, public_path(VOCABULARY))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("source mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs
