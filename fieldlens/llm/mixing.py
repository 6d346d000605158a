"""Mixing sources to target weights by pivotal dependent rounding.

Every document has the copy count its source's target asks for: a whole part and a fraction, which is
held as words still to be placed. Two documents at a time pass words from one to the other, at random
and without bias, until one of them is whole (none or all of it is taken); the other goes on. A
source's documents are dealt into blocks by hash, each block leaves one residual, and the residuals
are dealt again: a reduction tree of blocks. The sum of words never changes, so a source ends with one
residual document, of which the mix takes the words that are left (rounded).

DataFrame and SQL functions only.
"""

from __future__ import annotations

import math

from fieldlens.storage import stored
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BETWEEN_PRINT


def running(rows: DataFrame, order: list[Column], *sums: str) -> DataFrame:
    """rows with place (from 0, in the order) and, for each of sums, before_<name>: its sum over the rows before.

    Rows are dealt by ranges of the order; what lies before a range is the sum of the ranges' totals, so
    that only a row for each range comes together.
    """
    ranged = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in ("n", *sums)])
    own = Window.partitionBy("_range").orderBy(*order)
    full = ranged.join(F.broadcast(starts), "_range").withColumn("place", F.col("_before_n") + F.row_number().over(own) - 1)
    for c in sums:
        full = full.withColumn(f"before_{c}", F.col(f"_before_{c}") + F.coalesce(F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return full.select(*rows.columns, "place", *[f"before_{c}" for c in sums])


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n_docs, source_size, target): shares by weight, none above most times its source's size.

    Sources are ordered by code point, null last, and weigh by turns. What a source can't take is
    shared again by weight: the level at which the capped shares add up is that of the first source, in
    the order of the cap for a unit of weight, whose share at the level of all from it on is below its cap.
    """
    by_name = F.col("source").asc_nulls_last()
    per = running(sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")), [by_name])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("unit", F.col("cap") / F.col("weight")).drop("place")
    full = stored(running(per, [F.col("unit"), by_name], "cap", "weight"), "caps")
    sums = full.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (share * F.lit(float(sums["size"] or 0)) - F.col("before_cap")) / (F.lit(float(sums["weight"] or 0)) - F.col("before_weight"))
    fits = full.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct("unit", "place", "level")).alias("f")).first()["f"]
    target = F.least(F.col("cap"), F.lit(fits["level"] if fits else math.inf) * F.col("weight"))
    return full.select("source", "n_docs", F.col("source_size").cast("long").alias("source_size"), F.greatest(target, F.lit(0.0)).alias("target"))


#: One step of a block's fold: acc holds the residual r (words w of size s) and what is settled; e comes next.
#: up: most words that e can give to r; down: most that r can give to e. The odds leave both expectations as they were.
STEP = """
(acc, e) -> if(acc.r is null, struct(e as r, acc.done as done),
  transform(array(struct(least(acc.r.s - acc.r.w, e.w) as up, least(acc.r.w, e.s - e.w) as down, (xxhash64({seed}, acc.r.id, e.id, {level}) & 4503599627370495) / 4503599627370496D as u)), t ->
    if(t.u * (t.up + t.down) < t.down,
       if(acc.r.s - acc.r.w <= e.w,
          struct(struct(e.s as s, e.id as id, e.w - t.up as w) as r, concat(acc.done, array(struct(acc.r.s as s, acc.r.id as id, cast(acc.r.s as double) as w))) as done),
          struct(struct(acc.r.s as s, acc.r.id as id, acc.r.w + t.up as w) as r, concat(acc.done, array(struct(e.s as s, e.id as id, 0D as w))) as done)),
       if(acc.r.w <= e.s - e.w,
          struct(struct(e.s as s, e.id as id, e.w + t.down as w) as r, concat(acc.done, array(struct(acc.r.s as s, acc.r.id as id, 0D as w))) as done),
          struct(struct(acc.r.s as s, acc.r.id as id, acc.r.w - t.down as w) as r, concat(acc.done, array(struct(e.s as s, e.id as id, cast(e.s as double) as w))) as done))))[0])
"""
ELEMENT = "struct<s:bigint,id:bigint,w:double>"


def pivotal_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 20240, block: int = 64) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken.

    Null and wordless texts have size 0 and taken 0. A null source is a source. Repeated rows are
    documents of their own. The hash of seed and ids is all the chance there is, so reruns agree.
    """
    words = F.size(F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), BETWEEN_PRINT), ""))
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words.cast("long").alias("size")), "sized")
    targets = source_targets(sized, weights, share, most)
    targets = stored(targets, "targets")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = targets.withColumnRenamed("source", "_source")
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("copies", copies)
    rows = rows.withColumn("whole", F.floor("copies").cast("long"))
    state = rows.select("doc_id", "source", "n_docs", "size", F.col("size").alias("s"), ((F.col("copies") - F.col("whole")) * F.col("size")).alias("w"))
    settled, level = [], 0
    open_ = (F.col("w") > 0) & (F.col("w") < F.col("s"))
    settled.append(state.where(~open_).select("doc_id", "source", "s", "w"))
    live = state.where(open_).select("doc_id", "source", "s", "w", F.ceil(F.col("n_docs") / block).cast("long").alias("blocks"))
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0
    blocks = math.ceil(most_docs / block)
    while blocks:
        dealt = live.withColumn("blk", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "s"), F.col("blocks")))
        lists = dealt.groupBy("source", "blocks", "blk").agg(F.sort_array(F.collect_list(F.struct(F.col("s"), F.col("doc_id").alias("id"), F.col("w"))), asc=False).alias("all"))
        fold = f"aggregate(all, struct(cast(null as {ELEMENT}) as r, cast(array() as array<{ELEMENT}>) as done), {STEP.format(seed=seed, level=level)})"
        done = stored(lists.select("source", "blocks", F.expr(fold).alias("f")), f"mix{level}")
        settled.append(done.select("source", F.explode("f.done").alias("e")).select(F.col("e.id").alias("doc_id"), "source", F.col("e.s").alias("s"), F.col("e.w").alias("w")))
        left = done.select(F.col("f.r.id").alias("doc_id"), "source", F.col("f.r.s").alias("s"), F.col("f.r.w").alias("w"), "blocks")
        settled.append(left.where("blocks = 1").drop("blocks"))
        live = left.where("blocks > 1").withColumn("blocks", F.ceil(F.col("blocks") / block).cast("long"))
        blocks, level = (math.ceil(blocks / block) if blocks > 1 else 0), level + 1
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    full = out.join(t, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", copies)
    taken = F.floor("copies").cast("long") * F.col("s") + F.round("w").cast("long")
    return full.select("doc_id", "source", F.col("s").alias("size"), "source_size", "target", taken.alias("taken"))
