"""Captions, anchors and cells of sheets: who belongs to whom on a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.functions import text

#: The caption profiles in their order: key, label, kind, metric group, metric, phrases, tokens.
PROFILES: list[tuple[str, str, str, str | None, str | None, list[str], list[str]]] = [
    ("serving_pci", "Serving PCI", "cross", None, None, ["800 cells pci de la cellules serveuse", "2600 cells pci de la cellules serveuse", "1800 cells pci de la cellules serveuse", "cells pci de la cellules serveuse", "pci de la cellules serveuse", "serving cell pci", "serving pci"], ["cells", "pci", "serveuse"]),
    ("serving_cell_id", "Serving Cell ID", "cross", None, None, ["serving cell id"], ["serving", "cell", "id"]),
    ("best_server", "Best Server", "cross", None, None, ["best server"], ["best", "server"]),
    ("cs_rxlev", "CS RxLev", "degradation", "coverage", "RxLev", ["cs rxlev"], ["rxlev"]),
    ("cs_rxqual", "CS RxQual", "degradation", "quality", "RxQual", ["cs rxqual"], ["rxqual"]),
    ("coverage_rsrp", "Coverage (RSRP)", "degradation", "coverage", "RSRP", ["cells couverture rsrp", "coverage rsrp", "couverture rsrp"], ["couverture", "rsrp"]),
    ("quality_sinr", "Quality (SINR)", "degradation", "quality", "SINR", ["cells qualite sinr", "cells quality sinr", "qualite sinr", "quality sinr"], ["qualite", "sinr"]),
    ("coverage_rscp", "Coverage (RSCP)", "degradation", "coverage", "RSCP", ["cells couverture rscp", "coverage rscp", "couverture rscp", "best rscp in active set in connect state", "best rscp in active set"], ["rscp"]),
    ("quality_ecno", "Quality (EcNo)", "degradation", "quality", "EcNo", ["cells qualite ecno", "cells qualite ec no", "quality ecno", "qualite ecno", "qualite ec no", "best ec io in active set in connect state", "best ec io in active set"], ["ec", "io"]),
    ("quality_rsrq", "Quality (RSRQ)", "degradation", "quality", "RSRQ", ["cells qualite rsrq", "quality rsrq", "qualite rsrq"], ["qualite", "rsrq"]),
    ("throughput_dl", "Débit DL", "degradation", "throughput", "DL Throughput", ["debit dl en mobilite", "throughput dl en mobility"], ["debit", "dl", "mobilite"]),
    ("throughput_ul", "Débit UL", "degradation", "throughput", "UL Throughput", ["debit ul en mobilite", "throughput ul en mobility"], ["debit", "ul", "mobilite"]),
]
#: Mbps that a band must reach, down and up.
THRESHOLDS = {"L800": (15.0, 10.0), "L2100": (25.0, 15.0), "L2600": (50.0, 20.0)}
#: Where a label's number may stand, as (rows down, columns right), in order.
OFFSETS = [(0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (-1, 1)]


def profiles(spark: SparkSession) -> DataFrame:
    rows = [(k, *p) for k, p in enumerate(PROFILES)]
    return spark.createDataFrame(rows, "profile_no int, key string, label string, kind string, metric_group string, metric_name string, phrases array<string>, tokens array<string>")


def strength(norm: Column, phrases: list[str], tokens: list[str]) -> Column:
    """Points of a normalised text for one profile: 6 for each phrase it holds, 1 for each token."""
    return sum((F.when(norm.contains(p), 6).otherwise(0) for p in phrases), F.lit(0)) + sum((F.when(norm.contains(t), 1).otherwise(0) for t in tokens), F.lit(0))


def match_profile(cells: DataFrame, value: str = "value", least: int = 4, table: list[tuple] = PROFILES) -> DataFrame:
    """cells with profile (key of the best one, the first of equals; null below least points) and strength.

    One expression over the dozen profiles: no join and no row per pair.
    """
    norm = text.normalize_text(F.col(value))
    scored = cells.withColumn("_norm", norm)
    best = F.greatest(*[F.struct(strength(F.col("_norm"), p[5], p[6]).alias("s"), F.lit(-k).alias("k"), F.lit(p[0]).alias("key")) for k, p in enumerate(table)])
    scored = scored.withColumn("_best", best)
    return scored.withColumn("strength", F.col("_best.s")).withColumn("profile", F.when(F.col("strength") >= least, F.col("_best.key"))).drop("_norm", "_best")


def nearest_anchor(cells: DataFrame, anchors: DataFrame, on: list[str]) -> DataFrame:
    """Each cell with its closest anchor by rows plus columns; the lowest anchor_no of equals. Cells and anchors without a
    place come last: they have the lowest anchor_no and no distance. Sheets without anchors have no rows.

    Each place of cells asks once. The columns up to a place's own are parted into stretches of 1, 2, 4, ... columns, one
    at most of each width; anchors stand in all stretches around them, and one pass down and one up the rows of a
    stretch keeps the best so far. The same from the right. So no cell meets all anchors of a sheet.
    """
    place, known = [*on, "row", "col"], F.col("row").isNotNull() & F.col("col").isNotNull()
    number = F.struct(F.col("anchor_no").isNull().alias("none"), F.col("anchor_no").alias("anchor_no"))
    box = anchors.groupBy(*on).agg(F.min(F.when(known, F.col("col"))).cast("long").alias("lo"), F.max(F.when(known, F.col("col"))).cast("long").alias("hi"), F.min(number).alias("lowest"))
    box = box.withColumn("wide", F.col("hi") - F.col("lo") + 1).withColumn("bits", F.sequence(F.lit(0), F.length(F.bin("wide")) - 1)).hint("merge")
    row, left, right = F.col("row").cast("long"), F.col("col") - F.col("lo"), F.col("hi") - F.col("col")
    half = lambda x, bit: F.call_function("shiftright", x, bit)
    node = lambda side, x, bit, at: F.struct(F.lit(side).alias("side"), bit.alias("bit"), at.alias("node"), x.alias("x"))
    holds = lambda side, x: F.transform(F.filter("bits", lambda i: half(x, i) % 2 == 0), lambda i: node(side, x, i, half(x, i)))
    upto = lambda x: F.least(F.greatest(x + 1, F.lit(0)), F.col("wide"))
    asks = lambda side, x: F.transform(F.filter("bits", lambda i: half(upto(x), i) % 2 == 1), lambda i: node(side, x, i, half(upto(x), i) - 1))
    stand = anchors.where(known).groupBy(*place).agg(F.min(number).alias("number")).join(box, on)
    stand = stand.select(*place, "number", F.lit(None).cast(box.schema["lowest"].dataType).alias("lowest"), F.explode(F.concat(holds(0, left), holds(1, right))).alias("n"))
    ask = cells.select(*place).distinct().join(box, on)
    ask = ask.select(*place, F.lit(None).cast(box.schema["lowest"].dataType).alias("number"), "lowest", F.explode_outer(F.when(known, F.concat(asks(0, left), asks(1, right)))).alias("n"))
    along = Window.partitionBy(*on, "n.side", "n.bit", "n.node")
    so_far = lambda r, order: F.min(F.when(F.col("number").isNotNull(), F.struct((r - F.col("n.x")).alias("d"), F.col("number")))).over(along.orderBy(order))
    swept = stand.unionByName(ask).withColumn("above", so_far(-row, F.asc("row"))).withColumn("below", so_far(row, F.desc("row"))).where("lowest is not null")
    found = lambda c, r: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.d") + F.col("n.x") + r).alias("distance"), F.col(f"{c}.number")))
    best = swept.groupBy(*place).agg(F.min(F.least(found("above", row), found("below", -row))).alias("best"), F.min("lowest").alias("lowest"))
    kept = [*[F.col(k).alias(f"_{k}") for k in place], F.coalesce("best.number", "lowest")["anchor_no"].alias("anchor_no"), F.col("best.distance").cast(cells.schema["row"].dataType).alias("distance")]
    same = [F.col(k) == F.col(f"_{k}") for k in on] + [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ("row", "col")]
    return cells.join(best.select(*kept).hint("merge"), same).select(*cells.columns, "anchor_no", "distance")


def nearby_score(anchors: DataFrame, cells: DataFrame, on: list[str], reach: int = 10, most: int = 6) -> DataFrame:
    """Per anchor: score, sum of 12 strength / (1 + distance) over captions within reach, and the first most of them as
    texts "A1: value", sorted.

    Places meet, not cells: captions of one place are their sum and their first texts, anchors of one place ask once.
    Places are dealt into squares of the grid as wide as the reach, so that anchors meet only the squares around them.
    """
    side, place = reach + 1, [*on, "row", "col"]
    cell = lambda c: F.floor(F.col(c) / side)
    known = "row is not null and col is not null"
    held = cells.where(f"strength > 0 and {known}")
    sums = held.groupBy(*place).agg(F.sum("strength").alias("strength"))
    said = held.select(*place, F.concat(text.cell_ref(F.col("row"), F.col("col")), F.lit(": "), F.col("value")).alias("said")).where("said is not null")
    said = said.withColumn("k", F.row_number().over(Window.partitionBy(*place).orderBy("said"))).where(F.col("k") <= most).groupBy(*place).agg(F.collect_list("said").alias("said"))
    c = sums.join(said.hint("merge"), place, "left").select(*on, cell("row").alias("gr"), cell("col").alias("gc"), F.col("row").alias("r2"), F.col("col").alias("c2"), "strength", "said")
    a = anchors.where(known).select(*place).distinct()
    a = a.withColumn("gr", F.explode(F.array(cell("row") - 1, cell("row"), cell("row") + 1))).withColumn("gc", F.explode(F.array(cell("col") - 1, cell("col"), cell("col") + 1)))
    d = F.abs(F.col("row") - F.col("r2")) + F.abs(F.col("col") - F.col("c2"))
    near = a.join(c.hint("merge"), [*on, "gr", "gc"]).withColumn("distance", d).where(F.col("distance") <= reach)
    first = lambda lists: F.slice(F.sort_array(F.flatten(F.collect_list(lists))), 1, most)
    at = near.groupBy(*place).agg(F.sum(12 * F.col("strength") / (1 + F.col("distance"))).alias("score"), first("said").alias("texts"))
    stand = anchors.groupBy(*place, "anchor_no").agg(F.count("*").alias("times")).join(at.hint("merge"), place)
    again = F.flatten(F.array_repeat("texts", F.least("times", F.lit(most)).cast("int")))
    agg = stand.groupBy(*on, "anchor_no").agg(F.sum(F.col("times") * F.col("score")).alias("score"), first(again).alias("texts"))
    return anchors.select(*on, "anchor_no").join(agg.hint("merge"), [*on, "anchor_no"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def offset_probe(labels: DataFrame, cells: DataFrame, on: list[str], offsets: list[tuple[int, int]] = OFFSETS) -> DataFrame:
    """Each label cell with the first number found at the offsets, in their order, and where it stands (null if none has one)."""
    tries = F.explode(F.array(*[F.struct(F.lit(k).alias("prio"), F.lit(r).alias("dr"), F.lit(c).alias("dc")) for k, (r, c) in enumerate(offsets)]))
    wanted = labels.select(*on, "row", "col", tries.alias("o")).select(*on, "row", "col", (F.col("row") + F.col("o.dr")).alias("r2"), (F.col("col") + F.col("o.dc")).alias("c2"), "o.prio")
    values = cells.select(*on, F.col("row").alias("r2"), F.col("col").alias("c2"), text.first_number(F.col("value")).alias("number")).where("number is not null")
    found = wanted.join(values, [*on, "r2", "c2"]).groupBy(*on, "row", "col").agg(F.min(F.struct("prio", "number", F.col("r2").alias("found_row"), F.col("c2").alias("found_col"))).alias("f"))
    return labels.join(found.select(*on, "row", "col", "f.number", "f.found_row", "f.found_col"), [*on, "row", "col"], "left")


def throughput_verdict(metrics: DataFrame, band: str = "band", dl: str = "dl_mbps", ul: str = "ul_mbps") -> DataFrame:
    """metrics with min_dl, min_ul, warnings and verdict: SSV NOK if a rate is below its band's or the band is unknown."""
    pick = lambda k: F.coalesce(*[F.when(F.col(band) == b, t[k]) for b, t in THRESHOLDS.items()])
    rows = metrics.withColumn("min_dl", pick(0)).withColumn("min_ul", pick(1))
    low_dl, low_ul = F.col(dl) < F.col("min_dl"), F.col(ul) < F.col("min_ul")
    warn = lambda side, c, m: F.format_string(f"Avg {side} Throughput %.2f Mbps is below the %s minimum of %.0f Mbps.", F.col(c), F.col(band), F.col(m))
    listed = F.array_compact(F.array(F.when(low_dl, warn("DL", dl, "min_dl")), F.when(low_ul, warn("UL", ul, "min_ul")), F.when(F.col("min_dl").isNull(), "Unknown LTE band for throughput thresholds.")))
    return rows.withColumn("warnings", listed).withColumn("verdict", F.when(F.size("warnings") > 0, "SSV NOK").otherwise("SSV OK"))


def best_per(rows: DataFrame, key: list[str], by: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which must settle ties."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where("_k = 1").drop("_k")


def label_intervals(images: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """Each image with the label whose stretch of columns, up to the next label, holds it. Labels of a row are few."""
    by = Window.partitionBy(*on).orderBy("label_col")
    spans = labels.withColumn("next_col", F.lead("label_col").over(by))
    listed = spans.groupBy(*on).agg(F.collect_list(F.struct("label_col", "next_col", "label")).alias("_all"))
    hit = F.filter("_all", lambda s: (s["label_col"] <= F.col("col")) & (s["next_col"].isNull() | (F.col("col") < s["next_col"])))
    return images.join(listed, on, "left").withColumn("label", F.try_element_at(hit, F.lit(1))["label"]).drop("_all")


def fill_sections(rows: DataFrame, key: list[str], order: list[str], header: Column) -> DataFrame:
    """rows with section: the last header at or above each row."""
    by = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("section", F.last(header, ignorenulls=True).over(by))


def positional_zip(left: DataFrame, right: DataFrame, key: list[str], left_by: list[Column], right_by: list[Column]) -> DataFrame:
    """The i-th row of left with the i-th of right, for each key, as far as the shorter goes; position counts from 1."""
    number = lambda df, by: df.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy(*by)))
    return number(left, left_by).join(number(right, right_by), [*key, "position"])


def until_blank_rows(rows: DataFrame, key: list[str], order: list[str], blank: Column, most: int = 2) -> DataFrame:
    """The rows of a table up to where most blank rows follow one another, blank ones left out."""
    by = Window.partitionBy(*key).orderBy(*order)
    window = by.rowsBetween(-(most - 1), Window.currentRow)
    run = (F.sum(blank.cast("int")).over(window) >= most) & (F.count("*").over(window) >= most)
    stop = F.max(run.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_blank", blank).withColumn("_stop", stop).where("_stop = 0 and not _blank").drop("_blank", "_stop")
