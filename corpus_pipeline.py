"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame that is written as Parquet and reread as the next
one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm import bpe, decontaminate, jaccard, line_dedup, quality
from lexigrain.storage import materialize, only

#: Documents of a lower quality score go.
QUALITY_FROM = 0.3
VOCABULARY = "word_bpe_49k.json"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects; labels of the held-out fold are not learnt from."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, score_col="__score")
    return scored.filter(F.col("__score") >= QUALITY_FROM).drop("__score")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs; documents that lose every line go, and n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, counts=("__lines", "__deleted"))
    changed = F.col("__deleted") > 0
    return out.filter(F.col("__deleted") < F.col("__lines")).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return jaccard.keep_first(docs, size=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark window."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of ids and decoded text."""
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), digests=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("BPE encoding and decoding", encode),
]

#: The quality classifier, and tokens, are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with only(spark) as kept:
        for name, stage in STAGES:
            with only(spark) as left:
                docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
                left.append(docs)
        kept.append(docs)
    return docs
