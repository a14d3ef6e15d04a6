"""The corpus pipeline: toxicity, quality rules, near-duplicates, packing. Each stage's rows are written as Parquet and
reread before the next stage; each works on all that its predecessor kept.

Stages decide by row: null and empty texts, null and repeated ids, and repeated rows are cases that each stage names. Columns
of documents keep their names and order through the filtering stages, whatever these are called. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juriloom.llm import hyperminhash, packing, quality_rules, toxicity
from juriloom.storage import made, release, written

TOKENIZER = "byte_bpe_50k.json"
NEAR = 80  # percent of their shingles that near-duplicates share


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression calls toxic go; null and empty texts are not toxic. Without labels of both kinds
    nothing is."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base counts (null, empty and short texts do) or a rule of the cascade go."""
    return quality_rules.drop_rejected(docs)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, the one with the least id. Rows are decided on by their own texts:
    rows that share an id and are unlike all stay, of equal rows one. Rows without an id or without words are in no group and
    stay; of ids that tie, the first row of the table stays."""
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    named = rows.filter(F.col("doc_id").isNotNull())
    groups = hyperminhash.near_duplicates(named, percent=NEAR, id_col="__row").select("__row", "component_id")
    least = F.min(F.struct("doc_id", "__row"))["__row"].alias("__row")
    kept = groups.join(named.select("__row", "doc_id"), "__row").groupBy("component_id").agg(least).select("__row")
    return named.join(kept, "__row", "left_semi").unionByName(rows.filter(F.col("doc_id").isNull())).select(docs.columns)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences, a null or empty text as one token."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", stage_toxicity), ("quality_rules", stage_quality), ("near_duplicates", stage_near_duplicates), ("packing", stage_packing)]

# Toxicity and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that pass all stages (columns of packing.pack()). Tables that a stage leaves in the shared
    folder go as soon as its result is written; those of the last stage stay, as the answer reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = {id(t) for t in made()}
        kept = written(stage(spark, docs, sf_dir), f"stage-{name}")
        release(docs, *(t for t in made() if id(t) not in before and t is not kept))
        docs = kept
    packed = STAGES[-1][1](spark, docs, sf_dir)
    release(docs)  # packing has written the pieces
    return packed
