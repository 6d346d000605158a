"""Cross analysis on angle samples: points (image, sector, angle) about a site, with one direction per sector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import geo

#: The thresholds of the cross verdict.
MISASSIGNED, MIXED, INTRUSION, MARGIN = 0.18, 0.20, 0.18, 12.0


def sector_directions(points: DataFrame) -> DataFrame:
    """(image, sector, n, direction): the circular mean of each sector's angles."""
    return points.groupBy("image", "sector").agg(F.count("*").alias("n"), geo.circular_mean(F.col("angle")).alias("direction"))


def _wedge_table(directions: DataFrame) -> DataFrame:
    """Each sector's own wedge [start, stop): boundaries half-way to its neighbours by angle, around the circle.

    A wedge that stops where it starts is the whole circle, as that of a sector alone.
    """
    by = Window.partitionBy("image").orderBy("direction", "sector")
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("direction").over(by), F.first("direction").over(every))
    after = F.when(after < F.col("direction"), after + 360).otherwise(after)
    ends = directions.withColumn("stop", geo.wrap((F.col("direction") + after) / 2))
    return ends.withColumn("start", F.coalesce(F.lag("stop").over(by), F.last("stop").over(every)))


def sector_wedges(directions: DataFrame) -> DataFrame:
    return _wedge_table(directions).select("image", "sector", "direction", "start", "stop")


def zoned(points: DataFrame, directions: DataFrame | None = None) -> DataFrame:
    """points with the sector whose wedge holds the angle as zone (sector 0 where none does).

    Sectors look where directions (image, sector, direction) say, else to the mean of their points; so
    in all that follows.
    """
    wedges = sector_wedges(sector_directions(points) if directions is None else directions).select("image", F.col("sector").alias("zone"), "start", "stop")
    listed = wedges.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("zone", "start", "stop"))).alias("wedges"))
    a = F.col("angle")
    inside = F.filter("wedges", lambda w: F.when(w["start"] < w["stop"], (a >= w["start"]) & (a < w["stop"])).otherwise((a >= w["start"]) | (a < w["stop"])))
    return points.join(listed, "image").withColumn("zone", F.coalesce(F.try_element_at(inside, F.lit(1))["zone"], F.lit(0))).drop("wedges")


def zone_matrix(points: DataFrame, directions: DataFrame | None = None) -> DataFrame:
    """(image, source, zone, n): a sector's points by the wedge that they lie in."""
    return zoned(points, directions).groupBy("image", F.col("sector").alias("source"), "zone").agg(F.count("*").alias("n"))


def intrusion_ratio(points: DataFrame, directions: DataFrame | None = None) -> DataFrame:
    """(image, sector, ratio): the share of a sector's points outside its own wedge."""
    return zoned(points, directions).groupBy("image", "sector").agg(F.avg((F.col("zone") != F.col("sector")).cast("double")).alias("ratio"))


def misassigned_ratio(points: DataFrame, directions: DataFrame | None = None, margin: float = MARGIN) -> DataFrame:
    """(image, ratio): the share of points nearer to another sector's direction, by more than margin degrees."""
    looks = sector_directions(points) if directions is None else directions
    listed = looks.groupBy("image").agg(F.collect_list(F.struct("sector", "direction")).alias("all"))
    rows = points.join(listed, "image")
    far = lambda keep: F.array_min(F.transform(F.filter("all", keep), lambda d: geo.separation(d["direction"], F.col("angle"))))
    rows = rows.withColumn("own", far(lambda d: d["sector"] == F.col("sector"))).withColumn("other", far(lambda d: d["sector"] != F.col("sector")))
    return rows.groupBy("image").agg(F.avg(F.coalesce(F.col("other") + margin < F.col("own"), F.lit(False)).cast("double")).alias("ratio"))


def mixed_bin_ratio(points: DataFrame, bins: int = 36, dominant: float = 0.85) -> DataFrame:
    """(image, ratio): the share of points in bins of 10 degrees where no sector dominates."""
    counted = points.groupBy("image", (F.floor(F.col("angle") / (360 / bins)) % bins).alias("bin"), "sector").agg(F.count("*").alias("n"))
    per_bin = counted.groupBy("image", "bin").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.count("*").alias("sectors"))
    mixed = (F.col("sectors") >= 2) & (F.col("most") / F.col("total") < dominant)
    return per_bin.groupBy("image").agg((F.sum(F.when(mixed, F.col("total")).otherwise(0)) / F.sum("total")).alias("ratio"))


def least_separation(directions: DataFrame) -> DataFrame:
    """(image, least): the smallest angle between two sectors; images with one sector have 0."""
    listed = directions.groupBy("image").agg(F.collect_list("direction").alias("d"))
    pairs = F.flatten(F.transform("d", lambda a, i: F.transform(F.slice("d", i + 2, F.greatest(F.size("d") - i - 1, F.lit(0))), lambda b: geo.separation(a, b))))
    return listed.select("image", F.coalesce(F.array_min(pairs), F.lit(0.0)).alias("least"))


def cross_ratios(points: DataFrame, directions: DataFrame | None = None) -> DataFrame:
    """(image, points, misassigned, mixed, intrusion, least) of each image."""
    looks = sector_directions(points) if directions is None else directions
    totals = points.groupBy("image").agg(F.count("*").alias("points"))
    parts = totals.join(misassigned_ratio(points, directions).withColumnRenamed("ratio", "misassigned"), "image").join(mixed_bin_ratio(points).withColumnRenamed("ratio", "mixed"), "image")
    return parts.join(intrusion_ratio(points, directions).groupBy("image").agg(F.max("ratio").alias("intrusion")), "image").join(least_separation(looks), "image")


def confidence(points: Column, least: Column, misassigned: Column, mixed: Column, intrusion: Column) -> Column:
    """How far a verdict is to be trusted, from 0.05 to 0.99."""
    worst = F.greatest(misassigned / MISASSIGNED, mixed / MIXED, intrusion / INTRUSION)
    trust = 0.35 + 0.35 * F.least(points / 1800, F.lit(1.0)) + 0.20 * F.least(least / 110, F.lit(1.0)) + 0.10 * F.greatest(F.lit(0.0), 1 - 0.25 * worst)
    return F.greatest(F.lit(0.05), F.least(F.lit(0.99), trust))


def cross_verdict(points: DataFrame, directions: DataFrame | None = None) -> DataFrame:
    """(image, points, misassigned, mixed, intrusion, confidence, cross, verdict) of each image."""
    parts = cross_ratios(points, directions)
    trust = confidence(F.col("points"), F.col("least"), F.col("misassigned"), F.col("mixed"), F.col("intrusion"))
    cross = (F.col("misassigned") >= MISASSIGNED) | (F.col("mixed") >= MIXED) | (F.col("intrusion") >= INTRUSION)
    return parts.select("image", "points", "misassigned", "mixed", "intrusion", trust.alias("confidence"), cross.alias("cross"), F.when(cross, "Cross detected").otherwise("No cross detected").alias("verdict"))


def _pairs(matrix: DataFrame, directions: DataFrame) -> DataFrame:
    """Each (source, target) of a case with its shares, from a long zone matrix and the sectors' directions.

    Rows meet by image in one shuffle and without a join: a broadcast would bring all images to the driver where
    Spark takes an exploded table for small.
    """
    kind = matrix.schema["source"].dataType.simpleString()
    n = matrix.schema["n"].dataType.simpleString()
    sector, zone = F.col("source"), F.col("zone").cast(kind)
    side = lambda k, row, own, cell, zn: F.struct(k.alias("k"), F.lit(row).alias("row"), own.cast(n).alias("own"), cell.alias("cell"), zn.cast(n).alias("zn"))
    cell = F.struct(zone.alias("z"), F.col("n").alias("n"))
    both = F.array(side(sector, True, F.when(F.col("zone") == sector, F.col("n")).otherwise(0), cell, F.lit(None)), side(zone, False, F.lit(None), F.when(F.lit(False), cell), F.col("n")))
    rows = matrix.where("image is not null").select("image", F.explode(both).alias("b")).select("image", "b.*", F.lit(None).cast("struct<d:double>").alias("look"))
    look = F.struct(F.col("direction").cast("double").alias("d"))
    looks = directions.where("image is not null").select("image", F.col("sector").cast(kind).alias("k"), F.lit(False).alias("row"), F.lit(None).cast(n).alias("own"), F.lit(None).cast(f"struct<z:{kind},n:{n}>").alias("cell"), F.lit(None).cast(n).alias("zn"), look.alias("look"))
    sides = rows.unionByName(looks).groupBy("image", "k").agg(
        F.bool_or("row").alias("row"), F.sum("cell.n").alias("total"), F.sum("own").alias("own"), F.sum("zn").alias("zone_total"), F.collect_set("cell").alias("cells"), F.collect_set("look").alias("looks")
    )
    image = Window.partitionBy("image")
    sides = sides.where("row").withColumn("most", F.max("total").over(image)).where("k is not null").withColumn("d", F.explode("looks")).select("image", "k", "total", "own", "zone_total", "cells", "most", F.col("d.d").alias("d"))
    p = sides.withColumn("t", F.collect_list(F.struct("k", "total", "own", "zone_total", "d")).over(image)).where("total > 0").withColumn("t", F.explode("t")).where("k <> t.k")
    p = p.withColumn("cell", F.explode_outer(F.filter("cells", lambda c: c["z"] == F.col("t.k"))))
    st = F.coalesce("cell.n", F.lit(0))
    foreign = F.coalesce("t.zone_total", F.lit(0)) - st - F.col("t.own")
    p = p.select(
        "image", F.col("k").alias("s"), F.col("t.k").alias("t"), "total", "most", st.alias("moved"), (F.col("own") / F.col("total")).alias("own_share"), (st / F.col("total")).alias("share"),
        F.try_divide(F.col("t.own"), F.col("t.total")).alias("t_own_share"), F.try_divide(foreign, F.col("t.zone_total")).alias("t_other"),
        ((F.col("total") - F.col("own") - st) / F.col("total")).alias("s_other"), geo.separation(F.col("d"), F.col("t.d")).alias("apart"),
    )
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("image", "s").orderBy(F.desc("moved"), "t")))


def _calm(pairs: DataFrame, metrics: DataFrame, intrusion: DataFrame) -> DataFrame:
    """pairs of the images and source sectors that are in both; sorted and merged, as neither is small for certain."""
    own = intrusion.select("image", F.col("sector").alias("s"))
    return pairs.join(metrics.select("image").hint("merge"), "image", "left_semi").join(own.hint("merge"), ["image", "s"], "left_semi")


def _best(rows: DataFrame, kind: str, both: bool) -> DataFrame:
    first = Window.partitionBy("image").orderBy(F.desc("score"), "s", "t")
    best = rows.withColumn("k", F.row_number().over(first)).where("k = 1")
    ways = [F.struct(F.col("s").alias("source"), F.col("t").alias("target")), F.struct(F.col("t").alias("source"), F.col("s").alias("target"))]
    return best.select("image", F.lit(kind).alias("kind"), F.explode(F.array(*ways[: 1 + both])).alias("w")).select("image", "kind", "w.source", "w.target")


def late_handover(matrix: DataFrame, directions: DataFrame) -> DataFrame:
    """(image, kind, source, target): the sector that mostly serves in one other sector's zone."""
    p = _pairs(matrix, directions).where("own_share <= 0.12 and total <= most * 0.85 and share >= 0.25 and t_own_share >= 0.80 and apart >= 60 and t_other <= 0.35")
    score = F.col("share") * 0.45 + F.col("t_own_share") * 0.30 + F.least(F.col("apart") / 180, F.lit(1.0)) * 0.15 + (1 - F.col("t_other")) * 0.10
    return _best(p.withColumn("score", score), "late_ho", both=False)


def pair_late_handover(matrix: DataFrame, directions: DataFrame, metrics: DataFrame, intrusion: DataFrame) -> DataFrame:
    """Both directions between two sectors that reach into one another. metrics: (image, misassigned, mixed)."""
    p = _pairs(matrix, directions).where("rank = 1 and own_share >= 0.75 and share >= 0.15 and s_other <= 0.05 and t_own_share >= 0.90 and t_other <= 0.08 and apart >= 90")
    p = _calm(p, metrics.where("misassigned <= 0.08 and mixed <= 0.20"), intrusion.where("ratio between 0.18 and 0.24"))
    score = F.col("share") * 0.45 + F.col("own_share") * 0.20 + F.col("t_own_share") * 0.20 + (1 - F.col("t_other")) * 0.10 + F.least(F.col("apart") / 180, F.lit(1.0)) * 0.05
    return _best(p.withColumn("score", score), "late_ho_pair", both=True)


def minor_pair_late_handover(matrix: DataFrame, directions: DataFrame, metrics: DataFrame, intrusion: DataFrame) -> DataFrame:
    p = _pairs(matrix, directions).where("rank = 1 and share between 0.015 and 0.05 and t_own_share >= 0.95 and apart >= 90")
    p = _calm(p, metrics.where("misassigned <= 0.02 and mixed <= 0.05"), intrusion.where("ratio <= 0.05"))
    score = F.col("share") * 0.45 + F.col("t_own_share") * 0.35 + F.least(F.col("apart") / 180, F.lit(1.0)) * 0.20
    return _best(p.withColumn("score", score), "late_ho_minor_pair", both=True)


def handover_warnings(matrix: DataFrame, directions: DataFrame, metrics: DataFrame, intrusion: DataFrame) -> DataFrame:
    """The first of the three rules that says something, for each image."""
    late = late_handover(matrix, directions)
    pair = pair_late_handover(matrix, directions, metrics, intrusion).join(late.select("image"), "image", "left_anti")
    minor = minor_pair_late_handover(matrix, directions, metrics, intrusion)
    minor = minor.join(late.select("image"), "image", "left_anti").join(pair.select("image"), "image", "left_anti")
    return late.unionByName(pair).unionByName(minor)


def angular_islands(points: DataFrame, key: list[str], gap: float = 40.0) -> DataFrame:
    """Runs of angles with no gap over gap degrees, around the circle: key, island, n, span; islands count from the smallest angle."""
    by = Window.partitionBy(*key).orderBy("angle")
    step = F.coalesce((F.col("angle") - F.lag("angle").over(by) > gap).cast("int"), F.lit(0))
    runs = points.withColumn("new", step).withColumn("island", F.sum("new").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    each = runs.groupBy(*key, "island").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    every = Window.partitionBy(*key)
    last, least, most = F.max("island").over(every), F.min("lo").over(every), F.max("hi").over(every)
    wraps = (last > 0) & (least + 360 - most <= gap)
    each = each.withColumn("merge", wraps & (F.col("island") == last)).withColumn("lo", F.when(F.col("merge"), F.col("lo") - 360).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("merge"), F.col("hi") - 360).otherwise(F.col("hi")))
    each = each.withColumn("island", F.when(F.col("merge"), F.lit(0).cast("long")).otherwise(F.col("island")))
    return each.groupBy(*key, "island").agg(F.sum("n").alias("n"), (F.max("hi") - F.min("lo")).alias("span"))


def largest_island(points: DataFrame, key: list[str], gap: float = 40.0) -> DataFrame:
    """The island with most angles of each key; of equal ones the widest, then the first."""
    w = Window.partitionBy(*key).orderBy(F.desc("n"), F.desc("span"), "island")
    return angular_islands(points, key, gap).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def degraded_runs(rows: DataFrame, key: list[str], order: list[str], flag: str, least: int = 6) -> DataFrame:
    """Runs of flagged rows along an order: key, run (from 1), start, stop (positions from 0), n; least rows or more."""
    by = Window.partitionBy(*key).orderBy(*order)
    at = rows.withColumn("pos", F.row_number().over(by) - 1)
    hit = at.where(flag).withColumn("grp", F.col("pos") - F.row_number().over(Window.partitionBy(*key).orderBy("pos")))
    runs = hit.groupBy(*key, "grp").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"), F.count("*").alias("n")).where(F.col("n") >= least)
    return runs.withColumn("run", F.row_number().over(Window.partitionBy(*key).orderBy("start"))).drop("grp")
