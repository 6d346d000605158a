"""From workbooks to verdicts: every caption's image is analysed, average rates are judged, and a report is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import color, display, text
from fieldlens.operators import angles, dots, legends, previews, reports, scenes
from fieldlens.sources import workbook
from fieldlens.storage import stored

from . import workbooks

#: The position of a workbook's throughput among its analyses: the last one.
LAST = 1_000_000


def _json(doc: Column, **parts: Column) -> Column:
    """A JSON object with more members, which are JSON already."""
    more = [F.concat(F.lit(f',"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in parts.items()]
    return F.concat(F.substr(doc, F.lit(1), F.length(doc) - 1), *more, F.lit("}"))


def _by_sector(rows: DataFrame, value: Column) -> DataFrame:
    """(image, by_sector): values by the sector's name, counted from 1."""
    entry = F.struct(F.concat(F.lit("sector_"), (F.col("sector") + 1).cast("string")).alias("k"), value.alias("v"))
    return rows.groupBy("image").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("by_sector"))


def cell_names(candidates: DataFrame, cells: DataFrame, images: DataFrame, sectors: DataFrame, ocr: DataFrame) -> DataFrame:
    """(image, sector, name): the cells that a map's sectors are, by its legend's rows.

    ocr has the lines (image, ord, line) that a reader of texts found in each legend.
    """
    rows = legends.parse_ocr(ocr, ["image"])
    own = candidates.select("workbook", F.col("sheet").alias("own_sheet"), "image", "profile")
    found = None
    for headers in {*display.IDENTIFIER_HEADERS.values(), display.OTHER_HEADERS}:
        mine = own.where(display.expected_headers(F.col("profile")) == F.array(*[F.lit(h) for h in headers]))
        part = mine.join(legends.identifier_lookup(cells, headers, own=mine), ["workbook", "own_sheet"]).select("image", "identifier", "name", "azimuth")
        found = part if found is None else found.unionByName(part)
    named = legends.identifiers_of_rows(rows, found, ["image"]).withColumnRenamed("name", "identifier")
    colored = scenes.row_colors(images, rows.select("image", "row", "y_center")).join(named, ["image", "row"]).join(found, ["image", "identifier"])
    shown = sectors.where("sector is not null").select("image", "sector", "r", "g", "b", F.col("site_angle").alias("direction"))
    return legends.rows_of_sectors(colored.select("image", "row", "r", "g", "b", "azimuth"), shown, ["image"]).join(colored.select("image", "row", "name"), ["image", "row"]).select("image", "sector", "name")


def _selection() -> Column:
    anchor = F.struct((F.col("anchor_row") + 1).alias("row"), (F.col("anchor_col") + 1).alias("col"), text.cell_ref(F.col("anchor_row"), F.col("anchor_col")).alias("ref"))
    return F.to_json(F.struct(F.col("sheet").alias("sheetName"), F.col("media").alias("mediaPath"), F.col("metric_group").alias("metricGroup"), F.col("metric_name").alias("metricName"), anchor.alias("anchor"), F.col("caption_ref").alias("captionCell"), F.col("texts").alias("nearbyText")))


COLUMNS = ["workbook", "ord", "kind", "label", "target_key", "sheet", "metric_group", "metric", "verdict", "cross", "failed", "warnings", "colors", "metrics", "site", "selection", "preview", "annotated"]


def _cross(candidates: DataFrame, cells: DataFrame, ocr: DataFrame | None) -> DataFrame:
    mine = candidates.where("kind = 'cross'")
    images = mine.select("image", "content")
    sectors = scenes.sector_table(images)
    judged = stored(scenes.judged_sectors(sectors), "judged")
    shown = sectors.where("sector is not null")
    hex_ = color.hex_code(F.col("r"), F.col("g"), F.col("b"))
    one = F.struct("sector", F.concat(F.lit("sector_"), (F.col("sector") + 1).cast("string")).alias("name"), F.array("r", "g", "b").alias("rgb"), hex_.alias("hex"), F.round("direction", 2).alias("dominant_angle"), F.round("site_angle", 2).alias("site_angle"), F.col("n").alias("point_count"))
    line = F.struct("sector", "direction", hex_.alias("hex"))
    colors = shown.groupBy("image").agg(F.transform(F.sort_array(F.collect_list(one)), lambda s: s.dropFields("sector")).alias("colors"), F.sort_array(F.collect_list(line)).alias("lines"))
    bounds = angles.sector_wedges(shown.select("image", "sector", "direction")).groupBy("image").agg(F.sort_array(F.collect_list("stop")).alias("bounds"))
    own = sectors.where("counted")
    looks = own.select("image", "sector", "direction")
    intrusion = _by_sector(angles.intrusion_ratio(scenes.sector_points(sectors), looks), F.round("ratio", 4)).withColumnRenamed("by_sector", "intrusion_by")
    main = _by_sector(looks, F.round("direction", 2)).withColumnRenamed("by_sector", "angles_by")
    rows = mine.join(judged.withColumnRenamed("warnings", "said"), "image").join(colors, "image", "left").join(bounds, "image", "left").join(intrusion, "image", "left").join(main, "image", "left")
    if ocr is None:
        rows = rows.withColumn("warnings", F.col("said"))
    else:
        details = judged.select("image", F.posexplode("details").alias("ord", "d")).select("image", "ord", "d.source", "d.target", "d.message")
        named = legends.warnings_with_names(details, cell_names(mine, cells, images, sectors, ocr))
        rows = rows.join(named, "image", "left").withColumn("warnings", F.coalesce("warnings", "said"))
    ok = F.col("status") == "ok"
    mode = F.when(F.col("mode") == "low_res", "low_res_serving_pci_fallback").otherwise("dense_cross_solver")
    whole = F.struct(
        F.round("mixed", 4).alias("mixed_bin_ratio"), F.round("misassigned", 4).alias("misassigned_pixel_ratio"), F.round("intrusion", 4).alias("max_intrusion_ratio"), F.col("intrusion_by").alias("intrusion_ratio_by_sector"), F.col("angles_by").alias("dominant_angles"),
        F.col("points").alias("total_point_pixels"), F.round("least", 2).alias("min_angle_separation"), F.round("confidence", 4).alias("confidence"), mode.alias("analysis_mode"), F.col("reason").alias("analysis_reason_code"), "warnings",
    )
    none = F.struct(F.lit(True).alias("analysis_unavailable"), "reason", F.col("status").alias("reason_code"))
    cross = F.coalesce("cross", F.lit(False))
    drawn = previews.cross_preview(F.col("width_px"), F.col("height_px"), F.col("preview"), F.col("site_x"), F.col("site_y"), F.col("lines"), F.coalesce("bounds", F.array().cast("array<double>")))
    site = F.when(ok, F.to_json(F.struct(F.round("site_x", 2).alias("x"), F.round("site_y", 2).alias("y")))).otherwise("{}")
    return rows.select("workbook", F.col("rank").cast("long").alias("ord"), "kind", "label", F.col("profile").alias("target_key"), "sheet", "metric_group", F.col("metric_name").alias("metric"), F.when(cross, "Cross detected").otherwise("No cross detected").alias("verdict"), cross.alias("cross"), cross.alias("failed"), "warnings", F.coalesce(F.to_json("colors"), F.lit("[]")).alias("colors"), F.when(ok, F.to_json(whole)).otherwise(F.to_json(none)).alias("metrics"), site.alias("site"), _selection().alias("selection"), "preview", F.when(ok, drawn).otherwise("").alias("annotated"))


def _degradations(candidates: DataFrame) -> DataFrame:
    mine = candidates.where("kind = 'degradation'")
    rows = mine.join(dots.kpi_analysis(mine.select("image", "content")), "image")
    ok = F.col("status") == "ok"
    name = [F.coalesce("metric_name", F.lit("KPI")).alias("metric_name"), F.coalesce("metric_group", F.lit("kpi")).alias("metric_group")]
    whole = F.struct(*name, F.col("dots").alias("total_point_count"), F.col("red_points").alias("red_point_count"), F.col("red_ratio").alias("red_point_ratio"), F.col("longest").alias("continuous_red_count"), F.col("runs").alias("degradation_run_count"), "red_link_distance", F.col("strategy").alias("red_cluster_strategy"), (F.col("runs") > 0).alias("degradation_detected"), "warnings")
    none = F.struct(*name, F.lit(True).alias("analysis_unavailable"), "reason", "warnings")
    failed = F.coalesce(F.col("verdict") == "SSV NOK", F.lit(False))
    drawn = F.when(failed, previews.kpi_preview(F.col("width_px"), F.col("height_px"), F.col("preview"), F.col("circles"))).otherwise("")
    return rows.select("workbook", F.col("rank").cast("long").alias("ord"), "kind", "label", F.col("profile").alias("target_key"), "sheet", "metric_group", F.col("metric_name").alias("metric"), F.when(failed, "SSV NOK").otherwise("SSV OK").alias("verdict"), F.lit(False).alias("cross"), failed.alias("failed"), "warnings", F.lit("[]").alias("colors"), F.when(ok, F.to_json(whole)).otherwise(F.to_json(none)).alias("metrics"), F.lit('{"x":0.0,"y":0.0}').alias("site"), _selection().alias("selection"), "preview", drawn.alias("annotated"))


def _rates(cells: DataFrame) -> DataFrame:
    rows = workbooks.throughput_verdicts(cells)
    failed = F.col("verdict") == "SSV NOK"
    text_of = lambda side: F.array(F.concat(F.col(f"{side}_label_ref"), F.lit(f": Avg {side.upper()} Throughput (Mbps)")), F.concat(F.col(f"{side}_value_ref"), F.format_string(": %.2f Mbps", f"{side}_mbps")))
    selection = F.to_json(F.struct(F.col("sheet").alias("sheetName"), F.lit("throughput").alias("metricGroup"), F.lit("Avg Throughput").alias("metricName"), F.col("dl_label_ref").alias("captionCell"), F.concat(text_of("ul"), text_of("dl")).alias("nearbyText")))
    metrics = F.to_json(F.struct(F.lit("Avg Throughput").alias("metric_name"), F.lit("throughput").alias("metric_group"), F.coalesce("band", F.lit("Unknown")).alias("band"), F.round("dl_mbps", 2).alias("dl_average_mbps"), F.round("ul_mbps", 2).alias("ul_average_mbps"), F.col("min_dl").alias("dl_threshold_mbps"), F.col("min_ul").alias("ul_threshold_mbps")))
    drawn = previews.throughput_preview(F.col("band"), F.col("dl_mbps"), F.col("ul_mbps"), F.col("min_dl"), F.col("min_ul"), F.col("verdict"))
    return rows.select("workbook", F.lit(LAST).cast("long").alias("ord"), F.lit("throughput_average").alias("kind"), F.lit("Avg Throughput").alias("label"), F.lit("throughput_average").alias("target_key"), "sheet", F.lit("throughput").alias("metric_group"), F.lit("Avg Throughput").alias("metric"), "verdict", F.lit(False).alias("cross"), failed.alias("failed"), "warnings", F.lit("[]").alias("colors"), metrics.alias("metrics"), F.lit('{"x":0.0,"y":0.0}').alias("site"), selection.alias("selection"), F.lit(None).cast("string").alias("preview"), drawn.alias("annotated"))


def analyses(books: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """All analyses of workbooks (path, content), one row each: kind, label, sheet, verdict, warnings, and JSON of the rest.

    A map that can't be read or judged is no failure: its metrics say why. ocr, if it is given, has the
    texts (image, ord, line) read in the legends; images are called workbook|sheet number|target.
    """
    cells = stored(workbook.read_cells(books), "cells")
    found = workbooks.image_candidates(cells, workbook.read_anchors(books), workbook.read_sheets(books))
    named = found.withColumn("image", F.concat_ws("|", "workbook", F.col("sheet_no").cast("string"), "profile"))
    media = workbook.read_media(books).select("workbook", "media", "mime", "content")
    candidates = stored(named.join(media, ["workbook", "media"]).withColumn("preview", reports.data_uri(F.col("content"), F.col("mime"))), "candidates")
    return _cross(candidates, cells, ocr).select(*COLUMNS).unionByName(_degradations(candidates).select(*COLUMNS)).unionByName(_rates(cells).select(*COLUMNS))


def _listed(c: str) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("ord", F.col(c).alias("v")))), lambda s: s["v"])


def validate(books: DataFrame, ocr: DataFrame | None = None, all_previews: bool = False) -> DataFrame:
    """(workbook, verdict, report): a JSON document for each workbook that has anything to judge; an analysis has few KB and a
    workbook some dozen of them.

    Pictures are in the report for failures only, where there are any, unless all_previews is set.
    """
    rows = stored(analyses(books, ocr), "analyses")
    bad = rows.groupBy("workbook").agg(F.max(F.col("failed").cast("int")).alias("any"))
    rows = rows.join(bad, "workbook")
    seen = F.lit(all_previews) | (F.col("any") == 0) | F.col("failed")
    head = F.to_json(F.struct("label", F.col("target_key").alias("targetKey"), F.col("kind").alias("analysisKind"), "cross", F.col("failed").alias("isFailure"), "verdict", "warnings", F.when(seen, F.col("preview")).alias("previewImage"), F.when(seen, F.col("annotated")).alias("annotatedPreview"), (~seen).alias("previewDeferred")))
    rows = rows.withColumn("doc", _json(head, detected_colors=F.col("colors"), metrics=F.col("metrics"), siteCenter=F.col("site"), selection=F.col("selection")))
    first = lambda c: F.min_by(c, "ord").alias(f"first_{c}")
    per = rows.groupBy("workbook").agg(*reports.rollup_counts(), _listed("doc").alias("docs"), _listed("label").alias("labels"), F.flatten(_listed("warnings")).alias("all_warnings"), *[first(c) for c in ("colors", "metrics", "site", "selection", "warnings")])
    verdict = reports.rollup_text(F.col("failed_checks"), F.col("crosses"), F.col("checks"))
    summary = F.struct(F.col("crosses").alias("crossedImages"), F.col("failures").alias("failedImages"), (F.col("analyses") - F.col("failures")).alias("clearImages"), "labels", F.col("all_warnings").alias("warnings"))
    top = F.to_json(F.struct(F.lit(True).alias("success"), (F.col("failures") > 0).alias("isFailure"), (F.col("crosses") > 0).alias("cross"), verdict.alias("verdict"), F.col("analyses").alias("analysisCount"), summary.alias("summary"), F.col("first_warnings").alias("warnings"), F.lit(all_previews).alias("includesAllPreviews")))
    report = _json(top, analyses=F.concat(F.lit("["), F.array_join("docs", ","), F.lit("]")), detected_colors=F.col("first_colors"), metrics=F.col("first_metrics"), siteCenter=F.col("first_site"), selection=F.col("first_selection"))
    return per.select("workbook", verdict.alias("verdict"), report.alias("report"))
