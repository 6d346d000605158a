"""Legends: rows read by OCR, identifiers of cells, and which sector a row's colour means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import color, geo, text

from . import captions, shapes


def parse_ocr(lines: DataFrame, key: list[str]) -> DataFrame:
    """(key, row, text, x1, y1, x2, y2, y_center) of tab-separated lines (key, ord, line) from top to bottom.

    Coordinates are shares of the image from its lower left. Lines without a text and four numbers go.
    """
    part = F.split("line", "\t")
    number = lambda k: F.try_element_at(part, F.lit(k)).try_cast("double")
    rows = lines.select(*key, "ord", F.trim(F.try_element_at(part, F.lit(1))).alias("text"), *[number(k + 2).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])
    rows = rows.where("text <> '' and x1 is not null and y1 is not null and x2 is not null and y2 is not null").withColumn("y_center", (F.col("y1") + F.col("y2")) / 2)
    return rows.withColumn("row", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("y_center"), "ord")).cast("long")).drop("ord")


def identifiers_of_rows(rows: DataFrame, identifiers: DataFrame, key: list[str]) -> DataFrame:
    """(key, row, name, cost): each legend row with an identifier of its image, by least total edits. A legend has few rows."""
    pairs = rows.select(*key, "row", "text").join(identifiers.select(*key, F.col("identifier").alias("name")), key)
    costs = pairs.select(*key, "row", "name", text.identifier_cost(F.col("text"), F.col("name")).cast("double").alias("cost"))
    return shapes.assign_rows(costs, key)


def rows_of_sectors(rows: DataFrame, sectors: DataFrame, key: list[str], most: float = 120.0) -> DataFrame:
    """Sectors (key, sector, r, g, b, direction) with the legend row (key, row, r, g, b, azimuth) that names them.

    A row names the sector of the nearest colour, the first of equals, if it is within most; one whose
    azimuth confirms the sector's direction counts as nearer. Of several rows that name a sector the last
    one counts.
    """
    s = sectors.select(*key, "sector", "direction", *[F.col(c).alias(f"s{c}") for c in "rgb"])
    bonus = F.coalesce(geo.azimuth_bonus(F.col("direction"), F.col("azimuth")), F.lit(0.0))
    d = color.distance((F.col("r"), F.col("g"), F.col("b")), (F.col("sr"), F.col("sg"), F.col("sb"))) - bonus
    near = captions.best_per(rows.select(*key, "row", "r", "g", "b", "azimuth").join(s, key).withColumn("distance", d), [*key, "row"], [F.col("distance"), F.col("sector")])
    return captions.best_per(near.where(F.col("distance") <= most), [*key, "sector"], [F.desc("row")]).select(*key, "sector", "row", "distance")


def distinct_swatches(swatches: DataFrame, key: list[str], order: list[str], reach: float = 35.0) -> DataFrame:
    """(key, swatches): colours in their order, without those within reach of one kept before."""
    one = F.struct(*order, "r", "g", "b")
    listed = swatches.groupBy(*key).agg(F.sort_array(F.collect_list(one)).alias("all"))

    def apart(a: Column, b: Column) -> Column:
        return color.distance((a["r"], a["g"], a["b"]), (b["r"], b["g"], b["b"])) > reach

    kept = F.aggregate("all", F.slice("all", 1, 0), lambda have, s: F.when(F.forall(have, lambda h: apart(h, s)), F.array_append(have, s)).otherwise(have))
    return listed.select(*key, kept.alias("swatches"))


def missing_swatch(swatches: DataFrame, strong: DataFrame, candidates: DataFrame, key: list[str], reach: float = 60.0) -> DataFrame:
    """Each candidate colour (key, cand, r, g, b) with the nearest swatch (key, swatch, r, g, b) that no strong colour explains."""
    s = strong.select(*key, *[F.col(c).alias(f"t{c}") for c in "rgb"])
    near = color.distance((F.col("r"), F.col("g"), F.col("b")), (F.col("tr"), F.col("tg"), F.col("tb"))) <= reach
    explained = swatches.join(s, key).where(near).select(*key, "swatch").distinct()
    free = swatches.join(explained, [*key, "swatch"], "left_anti")
    c = candidates.select(*key, "cand", *[F.col(x).alias(f"c{x}") for x in "rgb"])
    d = color.distance((F.col("r"), F.col("g"), F.col("b")), (F.col("cr"), F.col("cg"), F.col("cb")))
    pairs = c.join(free, key).withColumn("distance", d)
    return captions.best_per(pairs, [*key, "cand"], [F.col("distance"), F.col("swatch")]).select(*key, "cand", "swatch", "distance")


def identifier_lookup(cells: DataFrame, headers: tuple[str, ...] = ("cell id",), name: str = "cell name", own: DataFrame | None = None) -> DataFrame:
    """(workbook, own_sheet if own is given, identifier, name, azimuth) of the tables under a header "cell name" that has one of headers within three columns.

    A table ends where two rows in a row have neither a name nor an identifier; an identifier has a digit.
    Sheets are read in order: the own one (workbook, own_sheet) first, then those with "donnees" in their
    name, then by name; of an identifier that comes again the last one counts.
    """
    norm = text.normalize_text(F.col("value"))
    read = cells.withColumn("head", norm)
    tops = read.where(F.col("head") == text.normalize_text(F.lit(name))).select("workbook", "sheet_no", F.col("row").alias("top"), F.col("col").alias("name_col"))
    right = read.where(F.col("head").isin(*headers, "azimuth")).select("workbook", "sheet_no", F.col("row").alias("top"), F.col("col").alias("c"), "head")
    at = lambda where: F.max(F.when(where, F.col("c")))
    table = ["workbook", "sheet_no", "top", "name_col"]
    heads = tops.join(right, ["workbook", "sheet_no", "top"]).where(F.col("c").between(F.col("name_col") + 1, F.col("name_col") + 3)).groupBy(*table).agg(at(F.col("head") != "azimuth").alias("id_col"), at(F.col("head") == "azimuth").alias("azimuth_col")).where("id_col is not null")
    under = cells.join(heads, ["workbook", "sheet_no"]).where("row > top and (col = name_col or col = id_col or col = azimuth_col)")
    pick = lambda c: F.max(F.when(F.col("col") == F.col(c), F.trim("value")))
    rows = under.groupBy(*table, "row", "sheet").agg(pick("name_col").alias("name"), text.normalize_identifier(pick("id_col")).alias("identifier"), pick("azimuth_col").alias("azimuth"))
    filled = rows.where("coalesce(name, '') <> '' or identifier <> ''")
    down = Window.partitionBy(*table).orderBy("row")
    step = F.col("row") - F.coalesce(F.lag("row").over(down), F.col("top"))
    whole = filled.withColumn("step", step).withColumn("broken", F.max((F.col("step") > 2).cast("int")).over(down)).where("broken = 0")
    known = whole.where("coalesce(name, '') <> ''").where(F.col("identifier").rlike("[0-9]"))
    known = known.join(own.select("workbook", "own_sheet").distinct(), "workbook") if own is not None else known.withColumn("own_sheet", F.lit(None).cast("string"))
    key = ["workbook"] if own is None else ["workbook", "own_sheet"]
    order = F.struct((~F.col("sheet").eqNullSafe(F.col("own_sheet"))).alias("other"), (~text.normalize_text(F.col("sheet")).contains("donnees")).alias("rest"), "sheet", "top", "name_col", "row")
    last = F.max_by(F.struct("name", text.parse_azimuth(F.col("azimuth")).alias("azimuth")), order)
    return known.groupBy(*key, "identifier").agg(last.alias("v")).select(*key, "identifier", "v.name", "v.azimuth")


def warnings_with_names(details: DataFrame, names: DataFrame) -> DataFrame:
    """details (image, ord, source, target, message) as (image, warnings): each message, and after it the same with the cells'
    names (image, sector, name) where both are known.
    """
    rows = details.join(names.select("image", F.col("sector").alias("source"), F.col("name").alias("from_name")), ["image", "source"], "left").join(names.select("image", F.col("sector").alias("target"), F.col("name").alias("to_name")), ["image", "target"], "left")
    named = F.when(F.col("from_name").isNotNull() & F.col("to_name").isNotNull(), F.format_string("Possible late HO from %s sector to %s sector", "from_name", "to_name"))
    both = F.struct("ord", F.array_compact(F.array("message", named)).alias("texts"))
    return rows.groupBy("image").agg(F.flatten(F.transform(F.sort_array(F.collect_list(both)), lambda s: s["texts"])).alias("warnings"))
