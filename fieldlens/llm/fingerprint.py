"""Document fingerprints: a canonical exact digest.

Texts are folded (NFKC, case folding, white space to one space, trimmed) and digested with the
128-bit xxHash. Equal digests are only candidates: the folded bytes inside an equal bucket are
compared, and a bucket that held different bytes gets ordinals, so equal fingerprints mean equal
folded texts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from fieldlens.storage import stored
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: ASCII separators that are white space for texts of other letters too.
SEPARATORS = bytes(32 if 28 <= c <= 31 else c for c in range(256))


def canonical(text: str | None) -> bytes:
    """Folded text; null and white space alone are empty. ASCII needs no normalisation."""
    if not text:
        return b""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        return " ".join(text.split()).encode("utf-8", "surrogatepass")
    return b" ".join(text.lower().encode().translate(SEPARATORS).split())


def digest(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def _digests(within: dict[int, bytes] | None = None):
    """Rows to (id, digest, folded); with a bitmap over the digests' first 24 bits, only the rows it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                folded = canonical(t)
                d = xxhash.xxh3_128_hexdigest(folded)
                if within is None or (m := within.get((x := int(d[:6], 16)) // 32768 + 1)) and m[x % 32768 // 8] >> x % 8 & 1:
                    rows.append((i, d, folded))
            yield pa.record_batch({"id": pa.array([r[0] for r in rows], pa.int64()), "digest": pa.array([r[1] for r in rows], pa.string()), "folded": pa.array([r[2] for r in rows], pa.binary())})

    return run


def buckets(docs: DataFrame, within: dict[int, bytes] | None = None) -> DataFrame:
    """(digest, folded, copies, first_id, fingerprint): a row for each distinct folded text.

    Copies meet by digest and folded bytes; equal rows are combined before the shuffle, so a text that
    a third of the rows share costs a row for each task. Different bytes under one digest get the
    digest with -1, -2, ... in the order of the bytes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests(within), "id long, digest string, folded binary")
    kinds = rows.groupBy("digest", "folded").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    crowded = kinds.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("digest", "crowded")
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("folded"))
    named = F.when(F.col("crowded").isNull(), F.col("digest")).otherwise(F.concat_ws("-", "digest", rank))
    return kinds.join(crowded, F.col("digest") == F.col("crowded"), "left").withColumn("fingerprint", named)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, copies, first_id) for each row. Null and empty texts are copies of one another."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests(), "id long, digest string, folded binary")
    return rows.join(buckets(docs), ["digest", "folded"]).select(F.col("id").alias("doc_id"), "fingerprint", "copies", "first_id")


def collided(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """(doc_id, digest, named) of documents whose digest belongs to different bytes: as good as always none.

    digests has the documents' digests. Only texts whose digest may occur again are read for the
    comparison: a bitmap of 2 MB at most holds the first 24 bits of the digests that do.
    """
    again = digests.groupBy("digest").count().where("count > 1").select((F.conv(F.substring("digest", 1, 6), 16, 10).cast("long") + 1).alias("x"))
    bits = again.groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    # numbers from 1 on: bucket 1 holds the first 32768 of them
    within = {r["bucket"]: bytes(r["bits"]) for r in bits.collect()}
    both = buckets(docs, within).where(F.col("crowded").isNotNull()).select("digest", "folded", F.col("fingerprint").alias("named"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests(within), "id long, digest string, folded binary")
    return rows.join(both, ["digest", "folded"]).select(F.col("id").alias("doc_id"), "digest", "named").distinct()  # repeated rows have one name


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part of the order, each with the row that follows it. The part's ends wait for its neighbours."""
    part = TaskContext.get().partitionId()
    own: tuple[int | None, str, bytes] | None = None
    for b in batches:
        out = []
        for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
            t = t or ""
            folded = canonical(t)
            if own is None:
                out.append((part, "head", i, t, None, None, None, None, None, None))
            else:
                out.append((part, "done", own[0], None, *_row(own[1], own[2], t, folded)))
            own = (i, t, folded)
        yield _batch(out)
    if own is not None:
        yield _batch([(part, "tail", own[0], own[1], None, None, None, None, None, None)])


SCHEMA = "part int, kind string, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
FIELDS = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in FIELDS]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, FIELDS, strict=True)], schema=FIELDS)


def _row(own: str, folded: bytes, after: str, after_folded: bytes) -> tuple:
    """An exact digest knows equal and different only, and bytes decide."""
    half = len(own) // 2
    edited = own[: len(own) - half] + after[:half]
    changed = canonical(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return len(own), sha, xxhash.xxh3_128_hexdigest(folded), xxhash.xxh3_128_hexdigest(changed), float(changed == folded), float(after_folded == folded)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _batch([(p, "done", i, None, *_row(t, canonical(t), n, canonical(n))) for p, i, t, n in zip(b["part"].to_pylist(), b["doc_id"].to_pylist(), b["text"].to_pylist(), b["after"].to_pylist(), strict=True)])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document beside its text edited with the next document's, by descending doc_id.

    One range shuffle puts neighbours side by side; only the last row of each part waits for the first
    row of the next part that has rows. Ties in doc_id go by the text's hash; null ids come last. A
    lone document is its own next. Empty tables give no rows.
    """
    key = F.xxhash64("text")
    order = [F.col("doc_id").desc_nulls_last(), key.desc()]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ranged.mapInArrow(_edited, SCHEMA), "edited")
    heads = rows.where("kind = 'head'").select("part", F.col("text").alias("after"))
    parts = sorted(r["part"] for r in heads.select("part").collect())  # a number for each part
    follow = docs.sparkSession.createDataFrame([(p, parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)], "part int, follower int")
    tails = rows.where("kind = 'tail'").select("part", "doc_id", "text").join(follow, "part")
    ends = tails.join(heads.withColumnRenamed("part", "follower"), "follower").select("part", "doc_id", "text", "after").mapInArrow(_joined, SCHEMA)
    all_rows = rows.where("kind = 'done'").unionByName(ends).drop("part", "kind", "text")
    named = collided(docs, all_rows.select(F.col("fingerprint").alias("digest"))).withColumnRenamed("doc_id", "_id")
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("digest") == F.col("fingerprint"))
    return all_rows.join(named, same, "left").withColumn("fingerprint", F.coalesce("named", "fingerprint")).drop("_id", "digest", "named")
