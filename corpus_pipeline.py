"""From raw documents to training tokens: five stages over the whole ``documents`` table.

Each stage takes what the one before kept, as Parquet in the shared folder. All
but the last return the columns of ``documents``.

A null or empty text fails the quality rules; rows without an id are linked
with nothing by the near-duplicate stage and go on; extra columns go along.
"""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from orderflow.llm import mixing, quality_gbt, setsketch, suffix_dedup, unigram  # noqa: E402
from orderflow.llm.workers import let_workers_import  # noqa: E402
from orderflow.operators.ranking import global_position  # noqa: E402
from orderflow.session import cut_lineage, ensure_checkpoint_dir  # noqa: E402
from orderflow.sources.tables import table  # noqa: E402

# SQL cannot express fitted trees, sketches, segmentation; the stages are tested
# against brute force instead.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fitted trees."""
    let_workers_import(spark)
    return quality_gbt.keep_good(docs, quality_gbt.fit(docs, table(spark, sf_dir, "labels")))


FEW_TEXTS = 50_000      # further texts of repeated ids up to this are broadcast


def row_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__near``: the id of a row's text. It is doc_id, but if an id has several
    texts, that of smallest hash keeps it and the others get ids above all others."""
    of_text = F.xxhash64(F.col("text").cast("string"))
    hashed = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("__doc"), of_text.alias("__text"))
    repeated = hashed.groupBy("__doc").agg(F.min("__text").alias("__low"), F.max("__text").alias("__high")).filter("__low <> __high")
    texts = hashed.join(repeated, "__doc").filter("__text > __low").select("__doc", "__text").distinct()
    further = cut_lineage(global_position(texts, ["__doc", "__text"], "__at"))
    n = further.count()
    if n == 0:
        return docs.withColumn("__near", F.col("doc_id"))
    top = docs.agg(F.max("doc_id")).first()[0]
    met = docs.join(F.broadcast(further) if n <= FEW_TEXTS else further, (F.col("doc_id") == F.col("__doc")) & (of_text == F.col("__text")), "left")
    return met.withColumn("__near", F.coalesce(F.lit(top) + 1 + F.col("__at"), F.col("doc_id"))).select(*docs.columns, "__near")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, similarity 0.8), that of the smallest id.

    Rows of one id with equal texts are one; with different texts each is decided by itself. The
    text of smallest hash stands for the id, the others come after all ids of the table."""
    let_workers_import(spark)
    rows = row_ids(docs)
    found = setsketch.near_duplicates(rows, setsketch.Near(words=5, percent=80), id_col="__near")
    kept = found.filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept")).distinct()
    first = F.row_number().over(Window.partitionBy("__kept").orderBy(F.xxhash64("text"), "text"))
    one = rows.join(kept, rows["__near"] == kept["__kept"]).withColumn("__row", first).filter(F.col("__row") == 1)
    return one.select(*docs.columns).unionByName(docs.filter(docs.doc_id.isNull()))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document of smaller id holds."""
    let_workers_import(spark)
    return suffix_dedup.remove_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources more often, up to the repetition limit."""
    return mixing.mix(docs).select(*docs.columns)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of every row's text."""
    let_workers_import(spark)
    return unigram.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup_stage),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written as Parquet to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
