"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; docs is what its predecessor kept. An
empty table gives an empty table of the same columns, and extra columns come through as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm import decontaminate, jaccard, language, mixing, substring_dedup
from fieldlens.llm.common import small_batches, table
from fieldlens.shipping import ship
from fieldlens.storage import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a calibrated probability of one half or more.

    Doubtful, null and letterless texts go. Rows are judged one by one: repeated rows, and null ids, stay or
    go by their text. Without a labelled document to learn from, all go.
    """
    ship(spark)
    small_batches(spark)
    found = language.identify(docs, language.train(docs))
    return found.where("not rejected").select(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id; null ids come after all others.

    Of rows that repeat an id and a text one stays. Wordless texts are like nothing else.
    """
    ship(spark)
    small_batches(spark)
    return jaccard.near_duplicates_removed(docs).select(*docs.columns)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that also stand in a document of smaller id are cut out; a text that loses all its
    words goes.

    A null id is larger than any other; rows that share an id don't count against each other. Null and
    short texts stay as they are.
    """
    ship(spark)
    small_batches(spark)
    return substring_dedup.deduplicated(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and wordless texts stay; repeated rows go or stay together."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it: taken of size, towards its source's target.

    A null source is a source, a null text has size 0, repeated rows are documents of their own, and ties
    are settled by hashes, so reruns agree.
    """
    return mixing.pivotal_mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language id", identify_language),
    ("n-gram jaccard join", join_near_duplicates),
    ("substring dedup", remove_repeats),
    ("benchmark decontamination", decontaminate_benchmark),
    ("source mixing", mix_sources),
]

#: SQL can't express a fitted classifier; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, over all of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
