"""What results are called where they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The colours of layers on maps.
LAYER_COLORS = {"900": "#ff9800", "1800": "#ffeb3b", "3011": "#4caf50", "3032": "#00bcd4", "10788": "#2196f3", "10813": "#9c27b0", "10838": "#e91e63"}
#: Analyses that pass or fail, beside those that look for a cross.
CHECKS = ("degradation", "throughput_average")
#: Target keys and the identifier headers that their legends name.
IDENTIFIER_HEADERS = {"serving_cell_id": ("cell id",), "best_server": ("psc", "cell id")}
OTHER_HEADERS = ("pci", "cell id", "psc")


def title(kind: Column, group: Column, label: Column, caption: Column) -> Column:
    """A card's title: the metric group of a degradation map, else the label."""
    own = F.when(kind == "degradation", F.when(group == "coverage", "Coverage").when(group == "quality", "Quality"))
    return F.coalesce(own, label, caption, F.lit("SSV map"))


def verdict_text(kind: Column, failed: Column, verdict: Column) -> Column:
    return F.when(kind.isin(*CHECKS), F.when(failed, "NOK").otherwise("OK")).otherwise(verdict)


def badge(kind: Column, failed: Column, verdict: Column, metric: Column, label: Column) -> Column:
    name = F.coalesce(metric, label, F.lit("SSV"))
    return F.when(kind == "degradation", F.concat(name, F.when(failed, " NOK").otherwise(" OK"))).when(kind == "cross", F.coalesce(verdict, F.lit("No cross detected"))).otherwise(F.coalesce(verdict, name))


def failure_metric(metric: Column) -> Column:
    """A metric's name in the summary of failures."""
    return F.when(metric == "DL Throughput", "Throughput DL").when(metric == "UL Throughput", "Throughput UL").otherwise(metric)


def technology(sheet: Column) -> Column:
    return F.coalesce(sheet, F.lit("SSV"))


def layer_color(layer: Column) -> Column:
    """The layer's own colour; 1800 for any 2G band but 900, grey for other 3G channels."""
    return F.coalesce(*[F.when(layer == k, v) for k, v in LAYER_COLORS.items()], F.lit("#aaaaaa"))


def warning_summary(warning: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(warning, F.lit("")), r"(?i)^Continuous red points detected\s*", "Continuous red run "), r"\.$", "")


def visible_warnings(warnings: Column) -> Column:
    """Warnings without those that only count continuous red points."""
    return F.filter(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: ~F.coalesce(w, F.lit("")).rlike(r"(?i)^Continuous red points detected\s*\("))


def category(kind: Column, label: Column, group: Column) -> Column:
    """Where an analysis stands among those of its sheet."""
    first = {"Serving PCI": 0, "Serving Cell ID": 1, "Best Server": 2}
    order = F.coalesce(*[F.when((kind == "cross") & (label == k), n) for k, n in first.items()], F.when(group == "coverage", 3), F.when(group == "quality", 4), F.when(label == "Débit UL", 6))
    return F.coalesce(order, F.lit(5))


def throughput_details(label: Column, dl: Column, ul: Column, min_dl: Column, min_ul: Column) -> Column:
    """The line below a throughput map: the workbook's average beside its minimum."""
    down = F.lower(label).contains("dl")
    value, least = F.when(down, dl).otherwise(ul), F.when(down, min_dl).otherwise(min_ul)
    number = lambda c: F.coalesce(F.format_string("%.2f Mbps", c.cast("double")), F.lit("--"))
    ok = F.coalesce(value >= least, F.lit(False))
    side = F.when(down, "DL").otherwise("UL")
    shown = F.when(value.isNull(), "--").otherwise(number(value))
    minimum = F.when(least.isNull(), "--").otherwise(number(least))
    return F.concat(F.lit("Throughput "), side, F.when(ok, " OK").otherwise(" NOK"), F.lit(" : average "), side, F.lit(" "), shown, F.lit(" (minimum is "), minimum, F.lit(")"))


def expected_headers(target: Column) -> Column:
    """The identifier headers that a target's legend may name, as an array."""
    array = lambda names: F.array(*[F.lit(n) for n in names])
    own = F.lit(None).cast("array<string>")
    for key, names in IDENTIFIER_HEADERS.items():
        own = F.when(target == key, array(names)).otherwise(own)
    return F.coalesce(own, array(OTHER_HEADERS))


def uses_exact_clusters(metric: Column, group: Column, sheet: Column) -> Column:
    """Maps whose red dots are told by exact colour: throughput, and SINR or RSRP on an LTE or VoLTE sheet."""
    m, s = F.lower(F.trim(F.coalesce(metric, F.lit("")))), F.lower(F.coalesce(sheet, F.lit("")))
    lte = s.contains("volte") | s.contains("l800") | s.contains("l2100") | s.contains("l2600") | s.contains("lte")
    return (F.lower(F.coalesce(group, F.lit(""))) == "throughput") | (m.isin("sinr", "rsrp") & lte)


def coordinates(lat: Column, lng: Column) -> Column:
    return F.format_string("%.6f, %.6f", lat, lng)


def natural_order(name: Column) -> Column:
    """Sorts names by the first number in them, then by themselves."""
    return F.struct(F.regexp_extract(name, r"(\d+)", 1).try_cast("long").alias("n"), name.alias("name"))


def sector_media(media: Column, urls: Column, url: Column) -> Column:
    """A sector's images: its media, else its URLs, else its one URL, as an array of (url, label)."""
    item = lambda u: F.struct(u.alias("url"), F.lit("").alias("label"))
    return F.when(F.size(media) > 0, media).when(F.size(urls) > 0, F.transform(urls, item)).when(url.isNotNull(), F.array(item(url))).otherwise(F.slice(media, 1, 0))


def image_index(index: Column, step: Column, n: Column) -> Column:
    """The image that a step leads to, around the end; null without images."""
    return F.when(n > 0, F.pmod(index + step, n))
