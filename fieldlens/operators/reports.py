"""Rankings, roll-ups and the documents made of results."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import color, display, text

#: Sheet names that the score looks for.
HINTS = ["3 l800 dt en mobilite", "l800 dt en mobilite", "3 l800 dt en mobility", "l800 mobility"]


def keyword_score(name: Column) -> Column:
    """Points of a sheet name for what it mentions."""
    t = text.normalize_text(name)
    has = lambda *words: F.when(sum((t.contains(w).cast("int") for w in words), F.lit(0)) > 0, 1).otherwise(0)
    return 24 * has("800") + 18 * has("dt") + 18 * has("mobilite", "mobile", "mobility") + 8 * F.when(t.startswith("3 "), 1).otherwise(0)


def sheet_scores(sheets: DataFrame, name: str = "name") -> DataFrame:
    """sheets with score: keyword points and 35 times the best similarity to a hint. Sheets are few and short."""

    @F.pandas_udf("double")
    def alike(v: pd.Series) -> pd.Series:
        return v.map(lambda t: max(difflib.SequenceMatcher(None, t, h).ratio() for h in HINTS))

    return sheets.withColumn("score", keyword_score(F.col(name)) + 35 * alike(text.normalize_text(F.col(name))))


def first_per(rows: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def accepted_candidates(rows: DataFrame, key: list[str], score: str, order: list[str], least: float) -> DataFrame:
    """rows with rank by score, ties by order; keys whose best score is below least go."""
    w = Window.partitionBy(*key)
    ranked = rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc(score), *order))).withColumn("_best", F.max(score).over(w))
    return ranked.where(F.col("_best") >= least).drop("_best")


def two_nearest_swatches(pixels: DataFrame, swatches: list[tuple[int, int, int]]) -> DataFrame:
    """pixels with swatch (nearest by Lab, first of equals), its distance, and margin: its share of the next one's."""
    here = color.lab(F.col("r"), F.col("g"), F.col("b"))
    rows = pixels.withColumn("_lab", F.struct(*[c.alias(n) for c, n in zip(here, "lab", strict=True)]))
    at = (F.col("_lab.l"), F.col("_lab.a"), F.col("_lab.b"))
    near = F.sort_array(F.array(*[F.struct(color.distance(at, color.lab(*[F.lit(c) for c in s])).alias("d"), F.lit(k).alias("k")) for k, s in enumerate(swatches)]))
    rows = rows.withColumn("_near", near)
    return rows.withColumn("swatch", F.col("_near")[0]["k"]).withColumn("distance", F.col("_near")[0]["d"]).withColumn("margin", F.col("_near")[0]["d"] / F.col("_near")[1]["d"]).drop("_lab", "_near")


def unlike_all(colors: DataFrame, strong: list[tuple[int, int, int]], reach: float) -> DataFrame:
    """The colours farther than reach from every strong one."""
    far = [color.distance((F.col("r"), F.col("g"), F.col("b")), tuple(F.lit(c) for c in s)) > reach for s in strong]
    return colors.where(F.forall(F.array(*far), lambda x: x))


def track(edges: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """edges (length) with start and stop along the track."""
    upto = F.sum("length").over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return edges.withColumn("stop", upto).withColumn("start", F.col("stop") - F.col("length"))


def track_offsets(pictures: DataFrame, views: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """views (key, angle) with offset and around: where a panorama of pictures (key, length) stands at an angle.

    Pictures share the circle equally; between the middles of two pictures the offset goes straight, and
    the first one follows the last.
    """
    middles = track(pictures, key, order).withColumn("middle", (F.col("start") + F.col("stop")) / 2)
    listed = middles.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, "middle"))), lambda s: s["middle"]).alias("_m"), F.max("stop").alias("around"))
    rows = views.join(listed, key)
    n = F.size("_m")
    at = F.pmod(F.col("angle"), F.lit(360.0)) / 360 * n
    k = F.least(F.floor(at).cast("int"), n - 1)
    here, there = F.get("_m", k), F.when(k + 1 < n, F.get("_m", k + 1)).otherwise(F.col("around") + F.get("_m", F.lit(0)))
    return rows.withColumn("offset", here + (at - k) * (there - here)).drop("_m")


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One value per key: that of the last row in the order."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def is_failure() -> Column:
    return F.col("verdict").isin("SSV NOK", "Cross detected")


def visible(analyses: DataFrame) -> DataFrame:
    """Failures only, where a workbook has any; all analyses elsewhere."""
    bad = F.max(is_failure().cast("int")).over(Window.partitionBy("workbook"))
    return analyses.withColumn("_any", bad).where((F.col("_any") == 0) | is_failure()).drop("_any")


def rollup_text(failed_checks: Column, crosses: Column, checks: Column) -> Column:
    """A workbook's verdict by counts: a failed check before a cross, a cross before checks that all passed."""
    return F.when(failed_checks > 0, "SSV NOK").when(crosses > 0, "Cross detected").when(checks > 0, "SSV OK").otherwise("No cross detected")


def rollup_counts() -> list[Column]:
    check = F.col("kind").isin(*display.CHECKS)
    return [F.count("*").alias("analyses"), F.count_if(is_failure()).alias("failures"), F.count_if(F.col("verdict") == "Cross detected").alias("crosses"), F.count_if(check).alias("checks"), F.count_if(check & is_failure()).alias("failed_checks")]


def workbook_rollup(analyses: DataFrame) -> DataFrame:
    """A workbook's counts, warnings in order and verdict."""
    listed = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "warnings"))), lambda s: s["warnings"])).alias("warnings")
    agg = analyses.groupBy("workbook").agg(*rollup_counts(), listed)
    return agg.withColumn("verdict", rollup_text(F.col("failed_checks"), F.col("crosses"), F.col("checks"))).drop("failed_checks")


def failure_summary(analyses: DataFrame, most: int = 4) -> DataFrame:
    """(workbook, summary): which metrics of which sheets failed: the first most of them, and how many more there are."""
    name = F.concat(F.coalesce(display.failure_metric(F.col("metric")), F.col("label")), F.lit(" of "), display.technology(F.col("sheet")), F.lit(" is DEGRADED"))
    bad = analyses.where(is_failure()).groupBy("workbook").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", name.alias("text")))), lambda s: s["text"]).alias("all"))
    extra = F.size("all") - most
    more = F.when(extra > 0, F.concat(F.lit(" | +"), extra.cast("string"), F.when(extra > 1, " more issues").otherwise(" more issue"))).otherwise("")
    return bad.select("workbook", F.concat(F.lit("SSV NOK : "), F.array_join(F.slice("all", 1, most), " | "), more).alias("summary"))


def ordered_analyses(analyses: DataFrame) -> DataFrame:
    """The maps of a workbook with position: sheets by their first analysis, then by category, then as they come."""
    maps = analyses.where(F.col("kind") != "throughput_average")
    first = F.min("ord").over(Window.partitionBy("workbook", F.coalesce("sheet", F.lit(""))))
    rows = maps.withColumn("_first", first).withColumn("_category", display.category(F.col("kind"), F.col("label"), F.col("metric_group")))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("workbook").orderBy("_first", "_category", "ord"))).drop("_first", "_category")


def svg_markers(marks: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """(key, svg): a data URI with a circle for each mark (ord, x, y, fill)."""
    one = F.format_string('<circle cx="%s" cy="%s" r="6" fill="%s"/>', F.col("x").cast("string"), F.col("y").cast("string"), F.col("fill"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", one.alias("s")))), lambda s: s["s"]), "")
    doc = F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">'), body, F.lit("</svg>"))
    return marks.groupBy(key).agg(doc.alias("doc")).select(key, F.concat(F.lit("data:image/svg+xml;base64,"), F.regexp_replace(F.base64(F.encode("doc", "UTF-8")), "[\r\n]", "")).alias("svg"))


def kml_document(places: DataFrame, key: str) -> DataFrame:
    """(key, kml): a KML document of placemarks (ord, name, lat, lng)."""
    name = F.replace(F.replace(F.replace(F.col("name"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    one = F.concat(F.lit("<Placemark><name>"), name, F.lit("</name><Point><coordinates>"), F.format_string("%.6f,%.6f,0", F.col("lng").cast("double"), F.col("lat").cast("double")), F.lit("</coordinates></Point></Placemark>"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", one.alias("s")))), lambda s: s["s"]), "")
    return places.groupBy(key).agg(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'), body, F.lit("</Document></kml>")).alias("kml"))


def kmz_files(documents: DataFrame, key: str) -> DataFrame:
    """(key, kmz): each KML document zipped as doc.kml, beside its images (an array of name and content) if there are any."""
    kind = documents.schema[key].dataType.simpleString()
    pictures = F.col("images") if "images" in documents.columns else F.array().cast("array<struct<name:string,content:binary>>")

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for pdf in parts:
            out = []
            for kml, images in zip(pdf.kml, pdf.images, strict=True):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(zipfile.ZipInfo("doc.kml"), kml.encode())
                    for p in images if images is not None else ():
                        z.writestr(zipfile.ZipInfo(f"images/{p['name']}"), bytes(p["content"]))
                out.append(data.getvalue())
            yield pd.DataFrame({key: pdf[key], "kmz": out})

    return documents.select(key, "kml", pictures.alias("images")).mapInPandas(pack, f"{key} {kind}, kmz binary")


def data_uri(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))
