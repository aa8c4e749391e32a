"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, token output.

Every stage works on all rows its predecessor kept. ``run`` writes each stage's documents to the shared folder and
reads them again, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import bit_planes
from emberlog.llm.decontaminate import drop_contaminated
from emberlog.llm.language_id import keep_identified
from emberlog.llm.occurrence_join import keep_one_of_each
from emberlog.llm.soft_mixing import apply_mix, mix
from emberlog.session import scratch_path

#: Weights of the domains in the mix, and its size as a share of the incoming tokens.
MIX, MIX_SCALE = {"good": 0.93, "low": 0.06, "toxic": 0.01}, 0.85
#: A language is told if the least sure votes of both levels multiply to this; an even vote on each gives 0.25.
MIN_SCORE = 0.2
#: Languages to keep; None keeps every language that was learned.
WANTED: set[str] | None = None
WIDTH, PERCENT = 5, 80
#: Words that a worker of the last stage remembers: fewer than alone, as executors still hold what stages before left.
KEPT_WORDS = 200_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a wanted language that can be told; null texts and texts without a letter go."""
    return keep_identified(docs, MIN_SCORE, WANTED)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 80 % similarity of five-word shingles, the document of the smallest id."""
    return keep_one_of_each(docs, WIDTH, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the fitted mix wants it."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return apply_mix(docs, mix(docs, labels, MIX, MIX_SCALE))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids lie in the written stream, and their checksum, as read back."""
    path = scratch_path(spark, "tokens")
    bit_planes.write_tokens(docs, path, kept_words=KEPT_WORDS)
    return bit_planes.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [("language_id", language), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("token_output", tokens)]

#: No stage can be stated in SQL: the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
