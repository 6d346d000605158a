"""The fixed pipelines over workbooks: throughput verdicts, image candidates, the cell database and its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import text
from fieldlens.operators import captions, reports, shapes, sites


def throughput_verdicts(cells: DataFrame) -> DataFrame:
    """A row for each workbook with both average rates on one sheet: band, rates, where they stand, thresholds, warnings, verdict.

    Of several labels of a side the last one counts, number or not; of several sheets the best scored one
    (50 points more with a known band, the first of equals).
    """
    norm = text.normalize_text(F.col("value"))
    side = F.when(norm.contains("avg dl throughput mbps"), "dl").when(norm.contains("avg ul throughput mbps"), "ul")
    key = ["workbook", "sheet_no", "sheet"]
    labels = cells.withColumn("side", side).where("side is not null").select(*key, "row", "col", "ord", "side")
    found = captions.offset_probe(labels, cells, key)
    of = lambda s: F.max_by(F.struct("number", text.cell_ref(F.col("row"), F.col("col")).alias("label"), text.cell_ref(F.col("found_row"), F.col("found_col")).alias("value")), F.when(F.col("side") == s, F.col("ord"))).alias(s)
    per = found.groupBy(*key).agg(of("dl"), of("ul"))
    per = per.select(*key, *[F.col(f"{s}.{a}").alias(f"{s}_{b}") for s in ("dl", "ul") for a, b in (("number", "mbps"), ("label", "label_ref"), ("value", "value_ref"))])
    per = per.where("dl_mbps is not null and ul_mbps is not null").withColumn("band", text.lte_band(F.col("sheet"), F.regexp_extract("workbook", "([^/]+)$", 1)))
    scored = reports.sheet_scores(per, "sheet").withColumn("score", F.col("score") + F.when(F.col("band").isNotNull(), 50).otherwise(0))
    best = captions.best_per(scored, ["workbook"], [F.desc("score"), F.col("sheet_no")])
    return captions.throughput_verdict(best).drop("score")


def image_candidates(cells: DataFrame, anchors: DataFrame, sheets: DataFrame, least: float = 120.0) -> DataFrame:
    """Images with the caption that they belong to: the best one for each target of a sheet, by score, with what the target is.

    Workbooks whose best score is below least have none.
    """
    key = ["workbook", "sheet_no"]
    caps = captions.match_profile(cells).where("profile is not null").select(*key, "ord", "row", "col", "value", "profile", "strength")
    near = captions.nearest_anchor(caps, anchors.select(*key, "anchor_no", "row", "col"), key)
    around = captions.nearby_score(anchors.select(*key, "anchor_no", "row", "col"), caps, key).withColumnRenamed("score", "nearby")
    places = anchors.select(*key, "anchor_no", "media", F.col("row").alias("anchor_row"), F.col("col").alias("anchor_col"))
    scored = near.join(around, [*key, "anchor_no"]).join(reports.sheet_scores(sheets, "sheet").select(*key, "sheet", "score"), key).join(places, [*key, "anchor_no"])
    total = 4 * F.col("score") + F.col("nearby") + F.greatest(F.lit(0), 180 - 32 * F.col("distance")) + 20 * F.col("strength")
    scored = scored.withColumn("score", total)
    best = captions.best_per(scored, [*key, "profile"], [F.desc("score"), F.col("ord")])
    ranked = reports.accepted_candidates(best, ["workbook"], "score", ["sheet_no", "ord"], least)
    kinds = captions.profiles(cells.sparkSession).select(F.col("key").alias("profile"), "label", "kind", "metric_group", "metric_name")
    caption = [F.col("value").alias("caption"), text.cell_ref(F.col("row"), F.col("col")).alias("caption_ref")]
    return ranked.join(F.broadcast(kinds), "profile").select(*key, "sheet", "media", "profile", "label", "kind", "metric_group", "metric_name", *caption, "anchor_row", "anchor_col", "score", "texts", "rank")


#: Header names of the cell tables, and the column (0-based) to take where a header is missing.
COLUMNS = {
    "2G": {"name": ("btsname", 2), "cell": ("cellname", 3), "freq": ("bcch", 7), "lat": ("latitude", 10), "lng": ("longitude", 11), "azimuth": ("azimut", 12)},
    "3G": {"name": ("nodebname", 3), "cell": ("cellname", 4), "freq": ("downlink uarfcn", 9), "lat": ("latitude", 11), "lng": ("longitude", 12), "azimuth": ("azimut", 13)},
}


def cell_database(cells: DataFrame) -> DataFrame:
    """Cells (workbook, ord, tech, name, cell, freq, lat, lng, azimuth) from the sheets 2G and 3G.

    The header row is the first with "technologie"; columns that it doesn't name are taken by place.
    Rows without a place or an azimuth go.
    """
    own = cells.where(F.col("sheet").isin(*COLUMNS))
    lower = own.withColumn("head", F.lower(F.trim("value")))
    header = lower.where("head = 'technologie'").groupBy("workbook", "sheet").agg(F.min("row").alias("header"))
    named = lower.join(header, ["workbook", "sheet"]).where(F.col("row") == F.col("header"))
    wanted = F.explode(F.array(*[F.struct(F.lit(t).alias("tech"), F.lit(f).alias("field"), F.lit(h).alias("head"), F.lit(p).alias("place")) for t, fs in COLUMNS.items() for f, (h, p) in fs.items()]))
    fields = header.select("workbook", "sheet", "header", wanted.alias("w")).select("workbook", "sheet", "header", "w.*").where("tech = sheet")
    at = fields.join(named.groupBy("workbook", "sheet", "head").agg(F.min("col").alias("found")), ["workbook", "sheet", "head"], "left").withColumn("col", F.coalesce("found", "place"))
    values = own.join(at.select("workbook", "sheet", "header", "tech", "field", "col"), ["workbook", "sheet", "col"]).where("row > header")
    wide = values.groupBy("workbook", "tech", F.col("row").cast("long").alias("ord")).pivot("field", ["name", "cell", "freq", "lat", "lng", "azimuth"]).agg(F.first("value"))
    typed = wide.withColumn("freq", F.col("freq").try_cast("double").cast("long")).withColumn("azimuth", text.parse_azimuth(F.col("azimuth")).cast("int"))
    return sites.valid_cells(typed).where("name is not null and cell is not null and azimuth is not null")


def merged_sites(cells: DataFrame) -> DataFrame:
    """Sites (workbook, site, ord, lat, lng) of a cell database with leader, the site each one merges into, and the merged
    site's name: co-located sites (50 m) whose names differ in a number behind are one; a base name's further sites are
    numbered.
    """
    first = cells.withColumn("site", text.site_base(F.col("name"))).groupBy("workbook", "site").agg(F.min("ord").alias("ord"), F.min_by("lat", "ord").alias("lat"), F.min_by("lng", "ord").alias("lng"))
    own = first.withColumn("group", F.concat_ws("|", "workbook", text.cluster_base(F.col("site"))))
    found = shapes.merge_co_located(own.withColumnRenamed("group", "base")).select(F.col("base").alias("group"), "ord", "leader", "cluster")
    named = F.concat(text.cluster_base(F.col("site")), F.when(F.col("cluster") > 0, F.concat(F.lit("_"), F.col("cluster").cast("string"))).otherwise(""))
    return own.join(found, ["group", "ord"]).select("workbook", "site", "ord", "lat", "lng", "leader", named.alias("merged"))


def merged_layers(cells: DataFrame) -> DataFrame:
    """(workbook, site, azimuth, lat, lng, layers_2g, layers_3g): the sectors of merged sites, with the layers of all that merged."""
    places = merged_sites(cells)
    heads = places.where("ord = leader").select("workbook", F.col("merged").alias("site"), "lat", "lng")
    own = cells.withColumn("site", text.site_base(F.col("name"))).join(places.select("workbook", "site", "merged"), ["workbook", "site"])
    of = lambda t: F.sort_array(F.collect_set(F.when(F.col("tech") == t, sites.layer(F.col("tech"), F.col("freq"))))).alias(f"layers_{t.lower()}")
    return own.groupBy("workbook", F.col("merged").alias("site"), "azimuth").agg(of("2G"), of("3G")).join(heads, ["workbook", "site"])


def neighbour_pairs(cells: DataFrame) -> DataFrame:
    """(workbook, src, tgt, layer) from the first sheet, whose header cells tell sources and targets of both layers."""
    first = cells.where("sheet_no = 0")
    norm = text.normalize_text(F.col("value"))
    kind = F.when(norm.contains("source") & norm.contains("gsm"), "source_gsm").when(norm.contains("target") & norm.contains("gsm"), "target_gsm").when(norm.contains("source") & norm.contains("dcs"), "source_dcs").when(norm.contains("target") & norm.contains("dcs"), "target_dcs")
    heads = first.withColumn("kind", kind).where("kind is not null").groupBy("workbook", "kind").agg(F.min(F.struct("row", "col")).alias("at")).select("workbook", "kind", F.col("at.row").alias("header"), "at.col")
    values = first.join(heads, ["workbook", "col"]).where("row > header")
    names = ["source_gsm", "target_gsm", "source_dcs", "target_dcs"]
    wide = values.groupBy("workbook", "row").pivot("kind", names).agg(F.first("value"))
    pairs = [wide.select("workbook", F.col(f"source_{s}").alias("src"), F.col(f"target_{s}").alias("tgt"), F.lit(s.upper()).alias("layer")) for s in ("gsm", "dcs")]
    return pairs[0].unionByName(pairs[1]).where("src is not null and tgt is not null")
