"""What the training-data operators share: tables, word splitting, mixing of hashes."""

from __future__ import annotations

import numpy as np
import xxhash
from fieldlens.shipping import ship
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words of letters and digits, and what separates words of anything but white space.
BETWEEN_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_PRINT = r"[\x20\x09-\x0D]+"
#: Bytes translation: A-Z to lower case, other ASCII but letters and digits to a space.
ALNUM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 250) -> None:
    """Texts may be long: bound what Arrow hands to Python at once, unless the user has set a bound."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def alnum_words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BETWEEN_ALNUM), "")


def crc_rest(key: str, n: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


class WordHashes(dict):
    """64-bit hashes of words, by lookup; remembers a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each run of n of the given hashes, by start."""
    count = len(hashes) - n + 1
    if count < 1:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : k + count]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def most_counted(df: DataFrame, key: str, count: str, most: int, *more: str) -> list[tuple]:
    """(key, count, more columns) of the largest counts, all of a step of counts or none, and never more than most rows."""
    steps = df.groupBy(F.floor(F.log2(count) * 16).alias("step")).agg(F.count("*").alias("n"), F.min(count).alias("c")).orderBy(F.desc("step")).collect()
    least, have = None, 0
    for r in steps:  # some hundred steps, whatever the table
        have += r["n"]
        if have > most:
            break
        least = r["c"]
    if least is None:
        return []
    t = df.where(F.col(count) >= least).select(key, count, *more).toArrow()
    return list(zip(*(t[c].to_pylist() for c in (key, count, *more)), strict=True))
