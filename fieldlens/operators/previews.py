"""Drawings over maps, as SVG data URIs made of columns alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlens.functions import geo


def svg_uri(svg: Column) -> Column:
    return F.concat(F.lit("data:image/svg+xml;base64,"), F.regexp_replace(F.base64(F.encode(svg, "UTF-8")), "[\r\n]", ""))


def _two(c: Column) -> Column:
    return F.format_string("%.2f", c.cast("double"))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _frame(width: Column, height: Column, uri: Column, body: Column) -> Column:
    w, h = width.cast("string"), height.cast("string")
    return svg_uri(_text('<svg xmlns="http://www.w3.org/2000/svg" width="', w, '" height="', h, '" viewBox="0 0 ', w, " ", h, '"><image href="', uri, '" width="', w, '" height="', h, '" />', body, "</svg>"))


def cross_preview(width: Column, height: Column, uri: Column, x: Column, y: Column, sectors: Column, boundaries: Column) -> Column:
    """A map with its site, a line for each sector (direction, hex) and a dashed one for each boundary between two."""

    def line(angle: Column, length: float, style: Column) -> Column:
        x2, y2 = geo.project(x, y, angle, F.lit(length))
        return _text('<line x1="', _two(x), '" y1="', _two(y), '" x2="', _two(x2), '" y2="', _two(y2), '" ', style, " />")

    own = F.transform(sectors, lambda s: line(s["direction"], 80.0, _text('stroke="', s["hex"], '" stroke-width="4" stroke-linecap="round"')))
    between = F.transform(boundaries, lambda a: line(a, 72.0, F.lit('stroke="#ffffff" stroke-width="2" stroke-dasharray="5 4" opacity="0.65"')))
    site = _text('<circle cx="', _two(x), '" cy="', _two(y), '" r="8" fill="none" stroke="#ffffff" stroke-width="3" /><circle cx="', _two(x), '" cy="', _two(y), '" r="3" fill="#ffffff" />')
    return _frame(width, height, uri, F.concat(F.array_join(own, ""), F.array_join(between, ""), site))


def kpi_preview(width: Column, height: Column, uri: Column, circles: Column) -> Column:
    """A map with circles (cx, cy, radius) around its clusters; strokes grow with the map's width."""
    scale = F.greatest(F.lit(1.0), width / 1400)
    inner, outer = F.least(F.lit(5.0), 3 * scale), F.least(F.lit(10.0), 6 * scale)

    def circle(c: Column) -> Column:
        at = _text('<circle cx="', _two(c["cx"]), '" cy="', _two(c["cy"]), '" r="', _two(c["radius"]), '" ')
        return _text(at, 'fill="#ff7c87" fill-opacity="0.16" stroke="#fff4f4" stroke-width="', _two(inner), '" />', at, 'fill="none" stroke="#ff7684" stroke-width="', _two(outer), '" stroke-dasharray="10 7" />')

    return _frame(width, height, uri, F.array_join(F.transform(circles, circle), ""))


def throughput_preview(band: Column, dl: Column, ul: Column, min_dl: Column, min_ul: Column, verdict: Column) -> Column:
    """A card with a workbook's average rates, their minima and the verdict."""
    failed = verdict == "SSV NOK"
    least = lambda c: F.when(c.isNull(), "n/a").otherwise(F.format_string("%.0f Mbps", c.cast("double")))

    def line(y: int, size: int, fill: str, *parts: str | Column) -> Column:
        return _text(f'<text x="40" y="{y}" fill="{fill}" font-size="{size}" font-family="Inter, sans-serif">', *parts, "</text>")

    return svg_uri(_text(
        '<svg xmlns="http://www.w3.org/2000/svg" width="900" height="420" viewBox="0 0 900 420"><rect width="900" height="420" rx="32" fill="#101a29" /><rect x="38" y="34" width="200" height="62" rx="16" fill="',
        F.when(failed, "#FF2900").otherwise("#00FF37"), '" /><text x="62" y="74" fill="', F.when(failed, "#fff5f2").otherwise("#001f08"), '" font-size="30" font-weight="700" font-family="Inter, sans-serif">', verdict, "</text>",
        line(150, 34, "#dbe8ff", "Throughput summary"), line(196, 24, "#9fc3f6", "Band: ", F.coalesce(band, F.lit("Unknown"))),
        line(266, 28, "#dbe8ff", "Avg DL Throughput: ", _two(dl), " Mbps"), line(306, 22, "#9fc3f6", "Minimum: ", least(min_dl)),
        line(366, 28, "#dbe8ff", "Avg UL Throughput: ", _two(ul), " Mbps"), line(406, 22, "#9fc3f6", "Minimum: ", least(min_ul)), "</svg>",
    ))
