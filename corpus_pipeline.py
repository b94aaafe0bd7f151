"""From documents to packed training sequences, in five stages.

Toxic documents go, one of each group of near-duplicates stays, repeated passages are cut, sources
are mixed to their weights, and what is left is packed. Each stage works on all that the one before
kept; ``run`` writes every stage's documents to the shared folder and reads them back.

The first stage is a fitted classifier, which SQL cannot express; ``ORACLE_SQL`` is None, and the
tests compare each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import mixing, ngram_join, packing, suffix_dedup, toxicity
from attestra.llm.common import read, settle
from attestra.llm.queries import PASSAGE_BYTES, toxicity_chain, word_vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain, names = toxicity_chain(docs, read(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, chain, names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs, PASSAGE_BYTES).withColumn("n_chars", F.char_length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs, mixing.word_count(F.col("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, word_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None

#: Rows of an Arrow batch. Documents are long, and a batch stands in the JVM and in the Python worker at once.
BATCH_ROWS = 1_000


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences; sets the session's Arrow batch, also for the last stage, which runs later."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    set_rows = int(spark.conf.get(batch))
    spark.conf.set(batch, str(min(set_rows, BATCH_ROWS) if set_rows > 0 else BATCH_ROWS))
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
