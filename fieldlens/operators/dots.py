"""Measurement dots of KPI maps: which components are dots, which are degraded, and the runs and clusters that they make.

Works on scenes.component_table and scenes.read_legends: rows by image, rules as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import color
from fieldlens.storage import stored

from . import chains, scenes, shapes

#: Fewest measurement dots of a map, and red dots of a cluster and of a continuous run.
LEAST_DOTS, LEAST_CLUSTER, LEAST_RUN = 6, 5, 6


def _floored() -> tuple[Column, Column, Column]:
    return tuple(F.floor(c) for c in "rgb")


def _hsv() -> tuple[Column, Column, Column]:
    h, s, v = color.hsv(*_floored())
    return h * 360, s, v


def is_low_res_point() -> Column:
    """A round dot of a small map, without a bright middle."""
    return shapes.is_point_like() & (F.col("fill_ratio") >= 0.35) & (F.abs(F.col("width") - F.col("height")) <= 4) & (F.col("inner_bright") <= 0.22)


def is_red_run_dot(least_fill: float = 0.35) -> Column:
    aspect = F.col("width") / F.col("height")
    return F.col("area").between(20, 2200) & F.col("width").between(5, 48) & F.col("height").between(5, 48) & (F.col("fill_ratio") >= least_fill) & aspect.between(0.55, 1.8)


def is_red() -> Column:
    """Red by its mean colour: saturated, within 35 degrees of red, and well above green and blue."""
    hue, s, v = _hsv()
    return (s >= 0.50) & (v >= 0.35) & (F.col("r") >= 1.12 * F.col("g")) & (F.col("r") >= 1.35 * F.col("b")) & ((hue <= 35) | (hue >= 325))


def is_header_noise() -> Column:
    """Lies in the strip of the legend and the header at the upper left."""
    x, y = F.floor(F.col("width_px") * 0.22), F.floor(F.col("height_px") * 0.25)
    return (F.col("max_y") < y) & (F.col("min_x") < F.floor(x * 1.15)) & (F.col("max_x") < F.floor(x * 1.35))


def is_solid_circle() -> Column:
    aspect = F.col("width") / F.col("height")
    return (F.col("width") >= 6) & (F.col("height") >= 6) & aspect.between(0.72, 1.38) & F.col("fill_ratio").between(0.42, 0.95) & (F.col("solid_ratio") >= 0.62) & (F.col("white_gap") <= 0.18)


def has_symbol() -> Column:
    """Has a bright symbol inside."""
    return (F.col("width") >= 12) & (F.col("height") >= 12) & (F.col("inner_white") >= 20)


def near_usual_area(dots: DataFrame, key: list[str], low: float, high: float, least: int = 20) -> DataFrame:
    """dots whose area is within low and high times the usual one, the median of the ten largest; all of a key where none is."""
    usual = shapes.median_of_largest(dots, key, "area", [F.desc("area"), F.col("comp")])
    floor = F.greatest(F.lit(least), F.col("dominant") * low)
    rows = dots.join(usual, key).withColumn("_ok", F.col("area").between(floor, F.greatest(floor, F.col("dominant") * high)))
    return rows.withColumn("_any", F.max(F.col("_ok").cast("int")).over(Window.partitionBy(*key))).where("_ok or _any = 0").drop("_ok", "_any", "dominant")


def measurement_dots(parts: DataFrame) -> DataFrame:
    """The components of colour that look like measurement dots."""
    return near_usual_area(parts.where(F.col("layer") == "colorful").where(shapes.is_measurement_dot()), ["image"], 0.35, 2.1)


def with_degraded(parts: DataFrame, swatches: DataFrame) -> DataFrame:
    """parts with degraded: the legend's lowest swatch is nearest by Lab, by a margin to the next other one; without a
    legend, a hue near red.
    """
    at = ("lab_l", "lab_a", "lab_b")
    legend = swatches.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("center_y", *at))).alias("_legend"))
    rows = parts.join(legend, "image", "left").withColumn("_lowest", F.element_at("_legend", -1))
    apart = lambda s, t: color.distance(tuple(s[c] for c in at), tuple(t[c] for c in at))
    own = F.struct(*at)
    rows = rows.withColumn("_near", F.sort_array(F.transform("_legend", lambda s: F.struct(apart(s, own).alias("d"), (apart(s, F.col("_lowest")) > 1).alias("other")))))
    rows = rows.withColumn("_first", F.col("_near")[0]).withColumn("_next", F.array_min(F.filter("_near", lambda x: x["other"]))["d"])
    by_legend = ~F.col("_first.other") & F.coalesce(F.col("_first.d") <= 0.82 * F.col("_next"), F.lit(True))
    hue, _, _ = _hsv()
    return rows.withColumn("degraded", F.when(F.col("_legend").isNull(), (hue <= 40) | (hue >= 345)).otherwise(by_legend)).drop("_legend", "_lowest", "_near", "_first", "_next")


def red_run_dots(dots: DataFrame, swatches: DataFrame, least_fill: float = 0.35) -> DataFrame:
    """Measurement dots of degraded colour that may be part of a run."""
    _, s, v = _hsv()
    red = (F.col("r") >= 1.08 * F.col("g")) & (F.col("r") >= 1.25 * F.col("b")) & (s >= 0.35) & (v >= 0.30)
    some = with_degraded(dots.where(red & is_red_run_dot(least_fill) & ~is_header_noise()), swatches).where("degraded")
    return near_usual_area(some, ["image"], 0.45, 1.85)


def visual_red_dots(dots: DataFrame, swatches: DataFrame) -> DataFrame:
    """Those of the red run dots that are of one size."""
    return near_usual_area(red_run_dots(dots, swatches), ["image"], 0.72, 1.28)


def placed(dots: DataFrame) -> DataFrame:
    """(image, id, x, y) of dots, as shapes and chains take them."""
    return dots.select("image", F.col("comp").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))


def degraded_runs(dots: DataFrame, red: DataFrame) -> DataFrame:
    """(image, run, id, pos): runs of red dots along the chains of all dots, joined end to end, of six and more; none that
    look like a label.
    """
    flagged = placed(dots).join(placed(red).select("image", "id", F.lit(True).alias("flag")), ["image", "id"], "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
    runs = chains.flagged_runs(flagged, ["image"], LEAST_RUN)
    shapes_ = dots.select("image", F.col("comp").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), "min_y", "max_y")
    labels = chains.text_like(runs.join(shapes_, ["image", "id"]), ["image", "run"]).where("text_like").select("image", "run")
    return runs.join(labels, ["image", "run"], "left_anti")


def overlay_dots(parts: DataFrame, swatches: DataFrame) -> DataFrame:
    """Reddish components that are solid dots of degraded colour, read from the map itself."""
    own = parts.where(F.col("layer") == "reddish").where(F.col("area").between(20, 2500) & F.col("width").between(4, 80) & F.col("height").between(4, 80))
    return with_degraded(own.where(is_solid_circle()), swatches).where("degraded")


def overlay_clusters(parts: DataFrame, swatches: DataFrame) -> DataFrame:
    """(image, cluster, n, route_score, cx, cy, radius): clusters of overlay dots that look like a route; images with fewer
    than six such dots have none.
    """
    found = overlay_dots(parts, swatches)
    many = found.groupBy("image").agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST_RUN).select("image")
    found = found.join(many, "image", "left_semi")
    near = shapes.link_distance(placed(found), ["image"], 1.8, 24.0, 320.0)
    reach = near.select("image", F.greatest(F.lit(180.0), F.least(F.lit(320.0), 6.8 * F.col("link"))).alias("reach"))
    rows = found.join(shapes.linked_points(placed(found).join(reach, "image"), ["image"]).withColumnRenamed("id", "comp"), ["image", "comp"])
    key = ["image", "cluster"]
    points = rows.select(*key, F.col("comp").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), "area", "min_y", "max_y")
    hue, _, _ = _hsv()
    turn = F.least(hue, 360 - hue)
    more = rows.groupBy(*key).agg(F.avg(turn).alias("hue"), F.avg(has_symbol().cast("double")).alias("symbols"), F.first("width_px").alias("width_px"), F.first("height_px").alias("height_px"))
    quality = shapes.cluster_quality(points, key).join(more, key).where(F.col("n") >= LEAST_RUN)
    scored = chains.route_score(quality, F.col("width_px"), F.col("height_px"), F.col("hue"), F.col("symbols")).where("route_score > 0")
    plain = scored.join(chains.text_like(points, key).where("text_like").select(*key), key, "left_anti")
    return plain.join(chains.hotspots(points, key), key).select(*key, "n", "route_score", "cx", "cy", "radius")


def best_strategy(clusters: DataFrame, key: list[str]) -> DataFrame:
    """(key, strategy): of several ways to cluster (key, strategy, n, extent), the one with the largest cluster, then the most
    clusters, then the widest together; clusters under six don't count, and the first name wins a tie.
    """
    own = F.col("n") >= LEAST_RUN
    per = clusters.groupBy(*key, "strategy").agg(F.coalesce(F.max(F.when(own, F.col("n"))), F.lit(0)).alias("most"), F.count_if(own).alias("count"), F.coalesce(F.sum(F.when(own, F.col("extent"))), F.lit(0.0)).alias("extent"))
    order = Window.partitionBy(*key).orderBy(F.desc("most"), F.desc("count"), F.desc("extent"), "strategy")
    return per.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(*key, "strategy", "most", "count", "extent")


def kpi_analysis(images: DataFrame) -> DataFrame:
    """A row for each image: dots, red_points and their ratio, runs, longest, circles, warnings and verdict.

    Red clusters make an image SSV NOK. Images with too few dots, or that can't be read, have a status, a
    reason and no verdict.
    """
    parts = scenes.component_table(images)
    swatches = scenes.read_legends(images)
    dots = measurement_dots(parts)
    image = parts.where(F.col("layer") == "image").select("image", "status", "reason", "width_px", "height_px")
    red = parts.where(F.col("layer") == "red").select("image", F.col("comp").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), "width_px", "height_px")
    clusters = shapes.red_clusters(red, ["image"], least=LEAST_CLUSTER)
    order = Window.partitionBy("image").orderBy(F.desc("n"), F.desc("total_area"), F.desc("extent"), "min_x", "mid_y")
    circle = F.struct("rank", "cx", "cy", "radius")
    found = clusters.withColumn("rank", F.row_number().over(order)).groupBy("image").agg(F.count("*").alias("runs"), F.sum("n").alias("clustered"), F.max("n").alias("longest"), F.sort_array(F.collect_list(circle)).alias("circles"))
    dots = stored(dots, "dots")
    seen = visual_red_dots(dots, swatches).groupBy("image").agg(F.count("*").alias("visual"))
    link = shapes.link_distance(placed(dots), ["image"], 1.85, 18.0, 120.0).select("image", F.round("link", 2).alias("red_link_distance"))
    full = image.join(dots.groupBy("image").agg(F.count("*").alias("dots")), "image", "left").join(found, "image", "left").join(seen, "image", "left").join(link, "image", "left")
    for c in ("dots", "runs", "clustered", "longest", "visual"):
        full = full.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    few = (F.col("status") == "ok") & (F.col("dots") < LEAST_DOTS)
    full = full.withColumn("red_points", F.when(F.col("runs") > 0, F.col("clustered")).otherwise(F.col("visual"))).withColumn("red_ratio", F.round(F.try_divide("red_points", "dots"), 4))
    full = full.withColumn("reason", F.when(few, "The extracted KPI image does not contain enough colored measurement points for degradation analysis.").otherwise(F.col("reason"))).withColumn("status", F.when(few, "insufficient_points").otherwise(F.col("status")))
    many = F.when(F.col("longest") >= LEAST_RUN, F.array(F.format_string("Continuous red points detected (%d).", "longest"))).otherwise(F.array().cast("array<string>"))
    full = full.withColumn("warnings", many).withColumn("strategy", F.when(F.col("runs") > 0, "red_cluster").otherwise("ordered_chain"))
    return full.withColumn("verdict", F.when(F.col("status") == "ok", F.when(F.col("runs") > 0, "SSV NOK").otherwise("SSV OK"))).drop("clustered", "visual")
