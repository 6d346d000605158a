"""Registered queries on text, cells, colours, sites and verdicts, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.functions import color, display, geo, text
from fieldlens.operators import captions, dots, previews, reports, shapes, sites

from .inputs import table


def _rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours made from keys of lineitem."""
    part, supp, order = (F.pmod(F.col(c) * k, F.lit(256)).cast("int") for c, k in (("l_partkey", 37), ("l_suppkey", 91), ("l_orderkey", 53)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", part.alias("r"), supp.alias("g"), order.alias("b"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


#: Profiles over the words of part names, to match captions on the driver's tables.
PART_PROFILES = [
    ("pale", "Pale", "cross", None, None, ["almond", "ivory"], ["al", "iv", "an"]),
    ("metal", "Metal", "degradation", None, None, ["steel", "tin", "copper"], ["st", "ti", "ar"]),
    ("rest", "Rest", "degradation", None, None, ["a", "e"], ["o"]),
]


def profile_match_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("value"))
    return captions.match_profile(rows, table=PART_PROFILES).select("p_partkey", "profile", F.col("strength").cast("int").alias("strength"))


def caption_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dozen caption profiles over every document's text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value"))
    return captions.match_profile(rows).select("doc_id", "profile", F.col("strength").cast("int").alias("strength"))


def target_strength_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = captions.match_profile(table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", "p_type").alias("value")), table=PART_PROFILES)
    best = captions.best_per(rows, ["p_brand"], [F.desc("strength"), F.col("p_partkey")])
    return best.select("p_brand", "p_partkey", F.col("strength").cast("int").alias("strength"))


def sheet_rank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword part of the sheet score; similarity to hints is in reports.sheet_scores."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(" L"), (F.col("p_partkey") % 30 * 100).cast("string"), F.lit(" DT en Mobilité")).alias("name"))
    return rows.select("p_partkey", reports.keyword_score(F.col("name")).alias("score"))


def band_infer_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("L"), (F.col("s_suppkey") % 30 * 100).cast("string"), F.lit(" sheet")).alias("sheet"), F.when(F.col("s_suppkey") % 2 == 0, "site L2600.xlsx").otherwise("site.xlsx").alias("file"), F.col("s_acctbal"))
    rates = rows.select("s_suppkey", text.lte_band(F.col("sheet"), F.col("file")).alias("band"), F.pmod(F.col("s_suppkey") * 7, F.lit(80)).cast("double").alias("dl_mbps"), F.pmod(F.col("s_suppkey") * 3, F.lit(30)).cast("double").alias("ul_mbps"))
    v = captions.throughput_verdict(rates)
    return v.select("s_suppkey", "band", "min_dl", "min_ul", F.size("warnings").cast("int").alias("n_warnings"), F.concat_ws("; ", "warnings").alias("warnings"), "verdict")


def first_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.first_number(F.col("url")).alias("number"))


def levenshtein_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    other = F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") * 7 % 1000).cast("string"), 9, "0"))
    return c.select("c_custkey", F.levenshtein("c_name", other).cast("int").alias("cost"))


def ocr_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", text.identifier_cost(F.concat_ws(" ", "c_name", F.col("c_nationkey").cast("string")), (F.col("c_custkey") % 97 + 10).cast("string")).cast("int").alias("cost"))


def cell_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_custkey", F.lit(18000)).cast("int").alias("col"), (F.col("o_orderkey") % 5000).cast("int").alias("row"))
    ref = text.cell_ref(F.col("row"), F.col("col"))
    return o.select("o_orderkey", ref.alias("ref"), text.column_index(F.regexp_extract(ref, "([A-Z]+)", 1)).cast("int").alias("col"))


def rgb_to_hsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, s, v = color.hsv(*_rgb())
    return pixels(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(h, 6).alias("h"), F.round(s, 6).alias("s"), F.round(v, 6).alias("v"))


def rgb_to_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, a, b = color.lab(*_rgb())  # noqa: E741
    return pixels(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(l, 3).alias("lab_l"), F.round(a, 3).alias("lab_a"), F.round(b, 3).alias("lab_b"))


def rgb_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("l_orderkey", "l_linenumber", color.hex_code(*_rgb()).alias("hex"))


def color_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy(color.sector_color_name(*_rgb()).alias("name")).agg(F.count("*").alias("n"))


def colorful_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("l_orderkey", "l_linenumber", color.is_colorful(*_rgb()).alias("colorful"), color.is_reddish(*_rgb()).alias("reddish"), color.is_red_cluster_pixel(*_rgb()).alias("cluster"))


def mean_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    return p.groupBy((F.col("l_orderkey") % 50).alias("sector")).agg(*[F.floor(F.sum(c) / F.count("*")).alias(c) for c in ("r", "g", "b")], F.count("*").alias("n"))


def hue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.hue_histogram(pixels(spark, sf_dir).withColumn("image", F.col("l_orderkey") % 5), ["image"])


def hue_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = shapes.hue_histogram(pixels(spark, sf_dir).withColumn("image", F.col("l_orderkey") % 5), ["image"])
    return shapes.hue_peaks(h, ["image"], least=1).select("image", F.array_join(F.transform("peaks", lambda p: p.cast("string")), ",").alias("peaks"))


def sector_prototype_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shapes.nearest_prototype(pixels(spark, sf_dir), [(0, (37, 72, 235)), (1, (240, 224, 40)), (2, (234, 52, 45))])
    return got.select("l_orderkey", "l_linenumber", F.coalesce("sector", F.lit(-1)).alias("sector"), F.round("rgb_distance", 6).alias("rgb_distance"))


def legend_two_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest swatch by Lab distance, its distance, and that to the next one."""
    return reports.two_nearest_swatches(pixels(spark, sf_dir), [(234, 52, 45), (240, 224, 40), (60, 180, 75), (37, 72, 235)]).select("l_orderkey", "l_linenumber", "swatch", F.round("distance", 3).alias("distance"), F.round("margin", 3).alias("margin"))


def swatch_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of lineitem that lie over 60 from every strong colour."""
    strong = [(37, 72, 235), (240, 224, 40), (234, 52, 45), (120, 120, 120)]
    return reports.unlike_all(pixels(spark, sf_dir).select("r", "g", "b").distinct(), strong, 60.0)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.lit(0).alias("image"), (k % 100).cast("int").alias("x"), F.floor(k / 100).cast("int").alias("y"), (F.col("c_acctbal") > 4000).cast("int").alias("m"))


def box_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.box_sum(grid(spark, sf_dir), ["image"], 2).select("x", "y", "m", F.col("density").cast("long").alias("density"))


def weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = shapes.box_sum(grid(spark, sf_dir), ["image"], 2).withColumn("part", F.col("x") % 4)
    c = shapes.weighted_centroid(d, ["part"], "density", 0.82, 90, [F.desc("density"), F.col("y"), F.col("x")])
    return c.select("part", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), "n")


def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("sheet"), (F.col("c_custkey") % 60).cast("int").alias("row"), (F.col("c_custkey") % 23).cast("int").alias("col"))
    a = anchors(spark, sf_dir)
    return captions.nearest_anchor(cells, a, ["sheet"]).select("c_custkey", "anchor_no", F.col("distance").cast("int").alias("distance"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select((F.col("s_nationkey") % 5).alias("sheet"), F.col("s_suppkey").alias("anchor_no"), (F.col("s_suppkey") * 7 % 60).cast("int").alias("row"), (F.col("s_suppkey") * 3 % 23).cast("int").alias("col"))


def nearby_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("sheet"), (F.col("c_custkey") % 60).cast("int").alias("row"), (F.col("c_custkey") % 23).cast("int").alias("col"), F.col("c_name").alias("value"), (F.col("c_custkey") % 4).cast("int").alias("strength"))
    got = captions.nearby_score(anchors(spark, sf_dir), cells, ["sheet"])
    return got.select("sheet", "anchor_no", F.round("score", 4).alias("score"), F.concat_ws("|", "texts").alias("texts"))


def offset_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    cells = c.select(F.lit(0).alias("sheet"), F.floor(k / 40).cast("int").alias("row"), (k % 40).cast("int").alias("col"), F.when(k % 3 == 0, F.concat(F.lit("v "), (k % 70).cast("string"), F.lit(",5 Mbps"))).otherwise("label").alias("value"))
    labels = cells.where("value = 'label' and col % 5 = 1").select("sheet", "row", "col")
    return captions.offset_probe(labels, cells, ["sheet"]).select("row", "col", "number")


def dedup_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.best_per(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


def best_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("o_totalprice") + F.when(F.col("o_orderstatus") == "F", 50000.0).otherwise(0.0)
    rows = table(spark, sf_dir, "orders").withColumn("score", score)
    return captions.best_per(rows, ["o_custkey"], [F.desc("score"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", F.round("score", 2).alias("score"))


def stable_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.accepted_candidates(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("score")), ["o_custkey"], "score", ["o_orderkey"], 300000.0).select("o_custkey", "o_orderkey", F.col("rank").cast("int").alias("rank"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("label", F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") * 100).alias("x"), (F.col("embedding")[1].cast("double") * 100).alias("y"), (F.lit(20) + F.col("vec_id") % 7).cast("double").alias("area"))


def nn_median_link_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.link_distance(embedded(spark, sf_dir), ["label"]).select("label", F.round("median_nearest", 6).alias("median_nearest"), F.round("link", 6).alias("link"))


def pairwise_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.extent(embedded(spark, sf_dir), ["label"]).select("label", "n", F.round("extent", 6).alias("extent"))


def top10_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.median_of_largest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", F.round("dominant", 4).alias("dominant"))


def top40_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean place of each label's 40 points nearest the origin."""
    rows = embedded(spark, sf_dir).withColumn("d", F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    top = reports.first_per(rows, ["label"], [F.col("d"), F.col("id")], 40)
    return top.groupBy("label").agg(F.round(F.avg("x"), 4).alias("cx"), F.round(F.avg("y"), 4).alias("cy"), F.count("*").alias("n"))


def knn_reciprocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.mutual_neighbours(embedded(spark, sf_dir), ["label"])


def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = shapes.cluster_quality(embedded(spark, sf_dir), ["label"])
    return q.select("label", "n", *[F.round(c, 4).alias(c) for c in ("width", "height", "mean_y", "cv_area", "cv_nearest")])


def distance_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.distance_pairs(embedded(spark, sf_dir), ["label"], 4.0).select("label", "a", "b", F.round("distance", 6).alias("distance"))


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = embedded(spark, sf_dir)
    return shapes.connected(p, shapes.distance_pairs(p.withColumn("one", F.lit(1)), ["one"], 1.0))


def supplier_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("SITE"), (k % 9).cast("string")).alias("base"), k.alias("ord"), (30 + k * 0.0003).alias("lat"), (-7 - (k % 7) * 0.0002).alias("lng"))


def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.near_sites(supplier_sites(spark, sf_dir), "base", 500.0).select("base", "a", "b", F.round("meters", 3).alias("meters"))


def destination_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lng = geo.destination(F.col("lat"), F.col("lng"), (F.col("ord") * 37 % 360).cast("double"), 150.0)
    return supplier_sites(spark, sf_dir).select("ord", F.round(lat, 7).alias("lat"), F.round(lng, 7).alias("lng"))


def wedge_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = geo.wedge(F.col("lat"), F.col("lng"), (F.col("ord") * 37 % 360).cast("double"), 80.0)
    rows = supplier_sites(spark, sf_dir).select("ord", F.posexplode(shape).alias("i", "p"))
    return rows.select("ord", "i", F.round("p.lat", 7).alias("lat"), F.round("p.lng", 7).alias("lng"))


def leader_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.merge_co_located(supplier_sites(spark, sf_dir)).select("base", "ord", "leader")


def cells_2g3g(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell database made from suppliers: site, cell, technology, azimuth, frequency."""
    k = F.col("s_suppkey")
    tech = F.when(k % 3 == 0, "2G").otherwise("3G")
    return table(spark, sf_dir, "supplier").select(k.alias("ord"), F.concat(tech, F.lit("_site"), (k % 40).cast("string")).alias("name"), F.concat(F.lit("CELL"), k.cast("string")).alias("cell"), tech.alias("tech"), (k % 3 * 120).cast("int").alias("azimuth"), F.when(k % 3 == 0, k % 900).otherwise(10000 + k % 100).cast("long").alias("freq"))


def sites_by_tech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.sites_by_technology(cells_2g3g(spark, sf_dir))


def layer_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sites.layer_sets(cells_2g3g(spark, sf_dir))
    return s.select("site", "azimuth", F.array_join("layers_2g", ",").alias("layers_2g"), F.array_join("layers_3g", ",").alias("layers_3g"))


def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and target cells of both layers, one row each."""
    k = F.col("s_suppkey")
    cell = lambda c: F.concat(F.lit("CELL"), c.cast("string"))
    wide = table(spark, sf_dir, "supplier").select(cell(k).alias("source_gsm"), cell(k * 7 % 100 + 1).alias("target_gsm"), cell(k).alias("source_dcs"), F.when(k % 4 > 0, cell(k * 11 % 100 + 1)).alias("target_dcs"))
    return sites.unpivot_neighbours(wide)


def neighbour_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.neighbour_targets(cells_2g3g(spark, sf_dir), neighbour_pairs(spark, sf_dir))


def highlight_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.highlighted(cells_2g3g(spark, sf_dir), neighbour_pairs(spark, sf_dir), "CELL5").select("cell", "site", "azimuth")


def fuzzy_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by names made of the beginnings of others, with a technology in front and a number behind."""
    n = table(spark, sf_dir, "nation")
    known = n.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("site"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    part = F.substr("n_name", F.lit(1), (F.lit(3) + F.col("c_custkey") % 7).cast("int"))
    wanted = c.select("c_custkey", F.concat(F.lit("3g_"), part, F.lit("__"), (F.col("c_custkey") % 4).cast("string")).alias("name"))
    return sites.match_sites(wanted, known, "name").select("c_custkey", "site")


def lookup_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose names stand on two sites each."""
    k = F.col("s_suppkey")
    letter = F.element_at(F.array(*[F.lit(c) for c in "ABC"]), (k % 3).cast("int") + 1)
    return table(spark, sf_dir, "supplier").select(k.alias("ord"), F.concat(F.lit("3G_N"), (k % 20).cast("string")).alias("name"), F.concat(F.lit("N"), (k % 10).cast("string"), letter).alias("cell"), (k * 7 % 360).cast("int").alias("azimuth"))


def cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    letter = F.element_at(F.array(*[F.lit(c) for c in "abcd"]), (k % 4).cast("int") + 1)
    wanted = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" n"), (k % 12).cast("string"), F.lit(" "), letter).alias("cell"))
    return sites.cell_sites(wanted, lookup_cells(spark, sf_dir)).select("c_custkey", "site", "azimuth")


def slice_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.slice_cells(cells_2g3g(spark, sf_dir))


def gap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    boxes = table(spark, sf_dir, "supplier").select((k % 4).alias("image"), k.alias("id"), (k * 37 % 500).alias("min_x"), (k * 37 % 500 + 3 + k % 30).alias("max_x"), (k * 53 % 400).alias("min_y"), (k * 53 % 400 + 2 + k % 20).alias("max_y"))
    return shapes.gap_pairs(boxes, ["image"], 25.0).select("image", "a", "b", F.round("gap", 6).alias("gap"))


def track_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 700 + 100).cast("double").alias("length"))
    views = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") * 37 % 360).cast("double").alias("angle"))
    return reports.track_offsets(pictures, views, ["o_custkey"], ["o_orderkey"]).select("o_custkey", F.round("offset", 4).alias("offset"), F.round("around", 2).alias("around"))


def panorama_drag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    angle = F.pmod(F.col("value") * 7, F.lit(360.0))
    x, y = geo.held_in_place(F.col("value"), F.lit(40.0), angle)
    return e.select("event_id", F.round(geo.dragged(angle, F.col("value") * 9, F.lit(2400.0)), 4).alias("angle"), F.round(x, 4).alias("dx"), F.round(y, 4).alias("dy"), display.image_index(F.col("event_id") % 5, F.lit(-3), F.lit(5)).cast("int").alias("image"))


def best_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), F.col("o_orderstatus").alias("strategy"), (F.col("o_orderkey") % 11).alias("n"), (F.col("o_orderkey") % 97).cast("double").alias("extent"))
    return dots.best_strategy(o, ["image"])


def label_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    labels = c.where("role = 'user'").select("conv_id", F.col("turn").alias("label_col"), F.concat(F.lit("L"), F.col("turn").cast("string")).alias("label"))
    return captions.label_intervals(c.select("conv_id", F.col("turn").alias("col")), labels.distinct(), ["conv_id"])


def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    return captions.fill_sections(c, ["conv_id"], ["turn", "role"], F.when(F.col("role") == "user", F.col("turn"))).withColumn("section", F.coalesce("section", F.lit(-1)))


def blank_row_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    return captions.until_blank_rows(c, ["conv_id"], ["turn", "role"], F.col("turn") % 4 >= 2)


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    a = c.where("role = 'user'").select("conv_id", F.col("turn").alias("asked"))
    b = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("answered"))
    return captions.positional_zip(a, b, ["conv_id"], [F.col("asked")], [F.col("answered")]).select("conv_id", F.col("position").cast("int").alias("position"), "asked", "answered")


def track_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.track(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("length")), ["o_custkey"], ["o_orderkey"])
    return rows.select("o_custkey", "o_orderkey", F.round("start", 2).alias("start"), F.round("stop", 2).alias("stop"))


def phase_rows_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_pairs(spark, sf_dir)


def identifier_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("ID"), (F.col("doc_id") % 97).cast("string")).alias("identifier"), F.col("source").alias("value"), F.col("doc_id").alias("ord"))
    return reports.last_wins(d, "identifier", "value", "ord")


def rollup_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.workbook_rollup(_analyses(spark, sf_dir)).select("workbook", "analyses", "failures", "crosses", "checks", "verdict", F.concat_ws("; ", "warnings").alias("warnings"))


def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failure_summary(_analyses(spark, sf_dir))


def ordered_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ordered_analyses(_analyses(spark, sf_dir)).select("workbook", "ord", F.col("position").cast("int").alias("position"))


def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = reports.is_failure()
    kind, group, label = F.col("kind"), F.col("metric_group"), F.col("label")
    rate = (F.col("ord") % 60).cast("double")
    details = display.throughput_details(label, rate, rate / 2, F.when(F.col("ord") % 5 > 0, F.lit(25.0)), F.lit(15.0))
    return _analyses(spark, sf_dir).select("ord", display.title(kind, group, label, F.lit(None).cast("string")).alias("title"), display.verdict_text(kind, failed, F.col("verdict")).alias("text"), display.badge(kind, failed, F.col("verdict"), F.col("metric"), label).alias("badge"), details.alias("details"))


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses made of orders: few customers' are crosses alone, the rest has checks too."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    kind = F.when((key % 3 == 0) | (F.col("o_custkey") % 5 == 0), "cross").otherwise("degradation")
    bad = F.col("o_orderstatus") == "F"
    verdict = F.when((kind == "cross") & bad, "Cross detected").when(kind == "cross", "No cross detected").when(bad, "SSV NOK").otherwise("SSV OK")
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (key % len(names)).cast("int") + 1)
    label = F.when(kind == "cross", pick("Best Server", "Serving PCI", "Serving Cell ID")).otherwise(pick("Débit DL", "Débit UL", "Quality (SINR)", "Coverage (RSRP)"))
    return o.select(
        F.col("o_custkey").alias("workbook"), key.alias("ord"), kind.alias("kind"), label.alias("label"), F.concat(F.lit("L"), (key % 4 * 100).cast("string")).alias("sheet"), F.when(kind == "degradation", pick("throughput", "throughput", "quality", "coverage")).alias("metric_group"),
        F.when(kind == "degradation", pick("DL Throughput", "UL Throughput", "SINR", "RSRP")).alias("metric"), verdict.alias("verdict"), F.when(key % 7 == 0, F.array(F.concat(F.lit("w"), key.cast("string")))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def visible_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.visible(_analyses(spark, sf_dir)).select("workbook", "ord", "verdict")


def svg_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("image"), F.col("n_nationkey").alias("ord"), (F.col("n_nationkey") * 11).alias("x"), (F.col("n_nationkey") * 7).alias("y"), F.lit("#ea342d").alias("fill"))
    return reports.svg_markers(n, "image", 640, 360)


def kpi_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of nations drawn over a map for each region."""
    circle = F.struct(F.col("n_nationkey").alias("ord"), (F.col("n_nationkey") * 11).alias("cx"), (F.col("n_nationkey") * 7).alias("cy"), (F.col("n_nationkey") + 25).alias("radius"))
    per = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("image")).agg(F.sort_array(F.collect_list(circle)).alias("circles"))
    return per.select("image", previews.kpi_preview(F.lit(2100), F.lit(900), F.lit("data:,"), F.col("circles")).alias("svg"))


def throughput_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    verdict = F.when(k % 2 == 0, "SSV OK").otherwise("SSV NOK")
    card = previews.throughput_preview(F.when(k % 3 > 0, "L800"), (k * 3).cast("double"), (k * 2).cast("double"), F.when(k % 3 > 0, F.lit(15.0)), F.when(k % 3 > 0, F.lit(10.0)), verdict)
    return table(spark, sf_dir, "supplier").select("s_suppkey", card.alias("svg"))


def kml_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("site"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), (30 + F.col("n_nationkey") * 0.5).alias("lat"), (-7 - F.col("n_nationkey") * 0.25).alias("lng"))
    return reports.kml_document(n, "site")


def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("key")).alias("region"))).alias("body"))


def min_cost_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows and five names for each region, by a made-up cost."""
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.col("n_regionkey").alias("legend"), F.col("n_nationkey").cast("long").alias("row"))
    names = n.select(F.col("n_regionkey").alias("legend"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    costs = rows.join(names, "legend").select("legend", "row", "name", ((F.col("row") * 7 + F.col("k") * 13) % 11).cast("double").alias("cost"))
    return shapes.assign_rows(costs, ["legend"])


def mask_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-connected components of the masked cells of the customer grid, with their shape."""
    on = grid(spark, sf_dir).where("m = 1").select(F.col("image").alias("image_id"), "x", "y")
    return shapes.component_stats(shapes.image_components(on), ["image_id"]).select("comp", "area", "min_x", "max_x", "min_y", "max_y", F.round("fill_ratio", 6).alias("fill_ratio"))
