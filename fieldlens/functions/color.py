"""Colour functions on r, g, b columns of 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """(hue, saturation, value), each from 0 to 1."""
    rf, gf, bf = (c.cast("double") / 255 for c in (r, g, b))
    high, low = F.greatest(rf, gf, bf), F.least(rf, gf, bf)
    span = high - low
    turn = F.when(span == 0, 0.0).when(high == rf, F.pmod((gf - bf) / span, F.lit(6.0))).when(high == gf, (bf - rf) / span + 2).otherwise((rf - gf) / span + 4)
    return F.pmod(turn / 6, F.lit(1.0)), F.when(high == 0, 0.0).otherwise(span / high), high


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE Lab under D65."""

    def linear(c: Column) -> Column:
        u = c.cast("double") / 255
        return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))

    rl, gl, bl = linear(r), linear(g), linear(b)
    # fixed values: the sRGB matrix and the D65 white point
    x = (0.4124564 * rl + 0.3575761 * gl + 0.1804375 * bl) / 0.95047
    y = 0.2126729 * rl + 0.7151522 * gl + 0.0721750 * bl
    z = (0.0193339 * rl + 0.1191920 * gl + 0.9503041 * bl) / 1.08883

    def root(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(7.787 * t + 16.0 / 116.0)

    fx, fy, fz = root(x), root(y), root(z)
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def hex_code(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def circular_distance(a: Column, b: Column, around: float) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(around))
    return F.least(d, around - d)


def hue_bin(degrees: Column) -> Column:
    """One of 12 bins, shifted by 15 degrees so that red is one bin."""
    return F.floor(F.pmod(degrees + 15, F.lit(360.0)) / 30)


def sector_color_name(r: Column, g: Column, b: Column) -> Column:
    h, s, v = hsv(r, g, b)
    d = h * 360
    named = F.when((d < 20) | (d >= 340), "Red")
    for upto, name in ((50, "Orange"), (75, "Yellow"), (165, "Green"), (205, "Cyan"), (280, "Blue")):
        named = named.when(d < upto, name)
    return F.when((v < 0.20) | (s < 0.20), "Neutral").otherwise(named.otherwise("Purple"))


def is_colorful(r: Column, g: Column, b: Column, least_s: float = 0.50, least_v: float = 0.35) -> Column:
    _, s, v = hsv(r, g, b)
    return (s >= least_s) & (v >= least_v)


def is_reddish(r: Column, g: Column, b: Column) -> Column:
    _, s, v = hsv(r, g, b)
    return (s >= 0.35) & (v >= 0.30) & (r >= 1.05 * g) & (r >= 1.15 * b)


def is_red_cluster_pixel(r: Column, g: Column, b: Column) -> Column:
    """Hue within 8 units of red on the half-degree scale, saturation and value of 150 at least."""
    h, s, v = hsv(r, g, b)
    half = F.round(h * 180)
    return ((half <= 8) | (half >= 172)) & (F.round(s * 255) >= 150) & (F.round(v * 255) >= 150)


def is_degraded_hue(degrees: Column, legend: Column) -> Column:
    """Near red, or within 10 degrees of the legend's hue where there is one."""
    return (degrees <= 40) | (degrees >= 345) | F.coalesce(circular_distance(degrees, legend, 360.0) <= 10, F.lit(False))


def outside_legend(x: Column, y: Column, width: Column, height: Column, share_x: float = 0.22, share_y: float = 0.25) -> Column:
    return ~((x < share_x * width) & (y < share_y * height))
