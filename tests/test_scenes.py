import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from fieldlens.operators import dots, scenes
from fieldlens.shipping import ship
from fieldlens.sources.images import encode_png

WHITE, ROAD, BLUE, YELLOW, RED = (247, 247, 247), (192, 202, 214), (37, 72, 235), (240, 224, 40), (234, 52, 45)


def canvas(w, h, legend=(BLUE, YELLOW, RED)):
    a = np.full((h, w, 3), WHITE, np.uint8)
    for x in range(0, w, 58):
        a[:, x : x + 2] = ROAD
    for y in range(0, h, 48):
        a[y : y + 2] = ROAD
    for k, c in enumerate(legend):
        a[8 + 16 * k : 18 + 16 * k, 8:18] = c
    return a


def disc(a, cx, cy, r, c):
    y, x = np.ogrid[: a.shape[0], : a.shape[1]]
    a[(x - cx) ** 2 + (y - cy) ** 2 <= r * r] = c


def branch(a, site, angle, length, c, step=10):
    t = math.radians(angle)
    for d in [*range(12, 37, 3), *range(40, length, step)]:
        disc(a, round(site[0] + d * math.cos(t)), round(site[1] - d * math.sin(t)), 4 if d < 40 else 3, c)


def no_cross():
    a = canvas(583, 286)
    for angle, length, c in ((90, 95, BLUE), (182, 180, YELLOW), (320, 185, RED)):
        branch(a, (360, 88), angle, length, c)
    return a


def crossed():
    a = no_cross()
    for angle in range(145, 202, 8):
        branch(a, (360, 88), angle, 110, BLUE, 18)
    for angle in range(280, 345, 8):
        branch(a, (360, 88), angle, 115, YELLOW, 18)
    return a


def images(spark, **named):
    ship(spark)
    return spark.createDataFrame([(k, bytearray(encode_png(v))) for k, v in named.items()], "image string, content binary")


def connected(a, site, angle, length, c):
    t = math.radians(angle)
    for d in range(12, length, 2):
        disc(a, round(site[0] + d * math.cos(t)), round(site[1] - d * math.sin(t)), 2, c)


def gsm_trace():
    cyan, deep, orange = (12, 252, 252), (9, 9, 250), (251, 77, 11)
    a = canvas(583, 286, (cyan, deep, orange))
    connected(a, (300, 134), 112, 112, cyan)
    connected(a, (300, 134), 285, 150, deep)
    branch(a, (300, 134), 190, 150, orange, 8)
    for x, y, c in ((430, 60, cyan), (120, 230, deep), (470, 220, orange), (500, 120, cyan)):
        disc(a, x, y, 4, c)
    return a


def small_dots(more=()):
    """A map without a fan: dots far apart, in groups about its middle."""
    a = canvas(500, 300)
    for k in range(4):  # what is densest stands for the site
        disc(a, 246 + 8 * (k % 2), 146 + 8 * (k // 2), 5, BLUE)
    for angle, c, n in ((90, BLUE, 5), (210, RED, 4), *more):
        for k in range(n):
            t = math.radians(angle - 24 + 12 * k)
            disc(a, round(250 + 90 * math.cos(t)), round(150 - 90 * math.sin(t)), 4, c)
    return a


def test_cross_verdicts(spark):
    df = images(spark, plain=no_cross(), crossed=crossed(), blank=canvas(583, 286, ()), gsm=gsm_trace()).unionByName(spark.createDataFrame([("broken", bytearray(b"no image")), ("none", None)], "image string, content binary"))
    sectors = scenes.sector_table(df)
    got = {r.image: r for r in scenes.judged_sectors(sectors).collect()}
    assert (got["plain"].status, got["plain"].verdict, got["plain"]["mode"]) == ("ok", "No cross detected", "dense")
    assert (got["crossed"].verdict, got["crossed"].misassigned > 0.18) == ("Cross detected", True)
    assert (got["blank"].status, got["blank"].verdict) == ("insufficient_site_center_density", None)
    assert got["broken"].status == got["none"].status == "unreadable_image" and got["broken"].verdict is None
    assert got["gsm"].status == "ok" and got["gsm"].points > 300
    main = sectors.where("image = 'plain'").orderBy("sector").collect()
    assert [(r.r, r.g, r.b) for r in main] == [BLUE, YELLOW, RED] and all(abs(r.direction - want) < 8 for r, want in zip(main, (90, 182, 320), strict=True))
    assert sectors.where("image = 'gsm'").count() == 3


def test_small_maps_are_told_by_their_dots(spark):
    two = small_dots()
    three = small_dots(((330, (20, 200, 60), 2),))
    mixed = small_dots(((150, RED, 6), (30, BLUE, 4)))
    large = np.full((600, 1000, 3), WHITE, np.uint8)
    large[:300, :500] = two
    sectors = scenes.sector_table(images(spark, two=two, three=three, large=large, mixed=mixed))
    got = {r.image: r for r in scenes.judged_sectors(sectors).collect()}
    assert (got["two"].status, got["two"]["mode"], got["two"].verdict, got["two"].points) == ("ok", "low_res", "No cross detected", 9)
    assert got["two"].reason.startswith("insufficient") and got["two"].warnings == []
    assert got["large"].status != "ok" and got["large"].verdict is None
    shown = sectors.where("image = 'three'").orderBy("sector").collect()
    assert [(r.counted, r.n) for r in shown] == [(True, 5), (True, 4), (False, 2)] and (shown[2].r, shown[2].g, shown[2].b) == YELLOW
    assert got["three"].points == 9
    assert got["mixed"]["mode"] == "low_res" and got["mixed"].points >= 9


def test_largest_cluster_wraps():
    a = np.array([350.0, 5.0, 20.0, 100.0, 110.0, 200.0])
    assert scenes.largest_cluster(a).tolist() == [True, True, True, False, False, False]
    assert scenes.largest_cluster(np.array([1.0, 90.0, 200.0])).all()


def large_run():
    a = canvas(980, 420)
    for k in range(6):
        disc(a, 280 + 48 * k, 210, 12, RED)
    for k in range(4):
        disc(a, 300 + 60 * k, 320, 10, YELLOW)
    return a


def two_runs():
    a = canvas(760, 320)
    for n, x in ((6, 170), (8, 420)):
        for k in range(n):
            disc(a, x + 24 * k, 176, 6, RED)
    for k in range(4):
        disc(a, 200 + 40 * k, 260, 5, YELLOW)
    return a


def sparse():
    a = canvas(420, 220)
    for x in range(96, 253, 26):
        disc(a, x, 118, 3, (60, 180, 75))
    return a


GREEN, ORANGE, KHAKI = (60, 180, 75), (231, 156, 104), (205, 147, 98)


def rows_of_dots(reds):
    a = canvas(520, 250)
    for k in range(3):
        for j in range(12):
            disc(a, 90 + 18 * j, 120 + 18 * k, 3, (GREEN, YELLOW, BLUE)[k])
    for x, y in reds:
        disc(a, x, y, 3, RED)
    return a


def sparse_red_run():
    a = canvas(520, 250, (BLUE, YELLOW, KHAKI))
    for k in range(6):
        disc(a, 120 + 28 * k, 150, 3, KHAKI)
        disc(a, 120 + 28 * k, 200, 3, GREEN)
    return a


def top_label():
    a = canvas(520, 250)
    for k in range(8):
        disc(a, 150 + 14 * k, 20 + 12 * (k % 2), 4, ORANGE)
    for k in range(5):
        disc(a, 220 + 22 * k, 210, 3, ORANGE)
    return a


def center_label():
    a = canvas(520, 250)
    for n, y in ((6, 130), (5, 144)):
        for k in range(n):
            disc(a, 220 + 14 * k, y, 3, ORANGE)
    for k in range(3):
        disc(a, 120 + 40 * k, 200, 3, BLUE)
    return a


def test_kpi_verdicts(spark):
    cluster = rows_of_dots([(250 + 10 * k, 148) for k in range(7)] + [(130 + 12 * k, 88) for k in range(3)])
    df = images(spark, large=large_run(), two=two_runs(), sparse=sparse(), low=rows_of_dots([(250, 210), (262, 210)]), cluster=cluster, run=sparse_red_run(), top=top_label(), center=center_label(), few=canvas(300, 200)).unionByName(spark.createDataFrame([("broken", bytearray(b"x"))], "image string, content binary"))
    got = {r.image: r for r in dots.kpi_analysis(df).collect()}
    assert (got["large"].verdict, got["large"].longest, got["large"].runs, got["large"].warnings) == ("SSV NOK", 6, 1, ["Continuous red points detected (6)."])
    assert (got["two"].verdict, got["two"].longest, got["two"].runs, got["two"].red_points) == ("SSV NOK", 8, 2, 14)
    assert (got["sparse"].verdict, got["sparse"].runs, got["sparse"].dots, got["sparse"].warnings) == ("SSV OK", 0, 7, [])
    assert got["low"].verdict == "SSV OK" and got["low"].strategy == "ordered_chain"
    assert got["top"].verdict == got["center"].verdict == "SSV OK"
    assert got["run"].verdict == "SSV OK" and got["run"].red_points == 6  # told by the legend, but of no red that counts
    assert (got["few"].status, got["few"].verdict) == ("insufficient_points", None) and got["broken"].status == "unreadable_image"
    assert got["large"].circles[0].radius == 25 + 240 // 2 and got["large"].red_link_distance > 18


def test_degraded_dots_and_runs(spark):
    df = images(spark, run=sparse_red_run(), center=center_label(), plain=sparse())
    parts, swatches = scenes.component_table(df), scenes.read_legends(df)
    assert [(r.r, r.g, r.b) for r in swatches.where("image = 'run' and degraded").collect()] == [KHAKI]
    assert abs(swatches.where("image = 'run' and degraded").first().hue - 24) <= 8
    points = dots.measurement_dots(parts)
    red = dots.visual_red_dots(points, swatches)
    assert {r.image: r["count"] for r in red.groupBy("image").count().collect()} == {"run": 6}
    bare = swatches.where("image = ''")
    runs = dots.degraded_runs(points, dots.visual_red_dots(points, bare))
    assert {(r.image, r["count"]) for r in runs.groupBy("image", "run").count().collect()} == {("run", 6), ("center", 6)}  # one row of a label is a run, both together were none
    assert dots.overlay_clusters(parts, swatches).count() == 0
    flags = parts.where(F.col("layer") == "colorful").where("image = 'run'").select(dots.is_red().alias("red"), dots.is_solid_circle().alias("solid"), dots.has_symbol().alias("symbol"), dots.is_low_res_point().alias("low"), dots.is_header_noise().alias("noise"))
    assert flags.where("symbol or noise").count() == 0 and flags.where("low").count() == 12


def test_overlay_clusters(spark):
    a = canvas(700, 500, ())
    spots = [(200 + 40 * k, 300 + (60 if k % 3 else 0) + 10 * k) for k in range(9)]
    for x, y in spots:
        disc(a, x, y, 8, RED)
    df = images(spark, a=a)
    found = dots.overlay_clusters(scenes.component_table(df), scenes.read_legends(df)).collect()
    assert [(r.n, r.route_score > 0) for r in found] == [(9, True)]


def test_row_colors(spark):
    df = images(spark, a=canvas(520, 250))
    rows = spark.createDataFrame([("a", 1, 1 - 13 / 70), ("a", 2, 1 - 45 / 70), ("a", 3, 0.0)], "image string, row long, y_center double")
    assert {r.row: (r.r, r.g, r.b) for r in scenes.row_colors(df, rows).collect()} == {1: BLUE, 2: RED}


def test_legends(spark):
    got = scenes.read_legends(images(spark, a=canvas(520, 250), b=canvas(520, 250, (BLUE,)))).orderBy("center_y").collect()
    assert [(r.image, (r.r, r.g, r.b), r.degraded) for r in got] == [("a", BLUE, False), ("a", YELLOW, False), ("a", RED, True)]


def test_labels_against_flood_fill():
    rng = np.random.default_rng(2)
    for _ in range(20):
        m = rng.random((17, 23)) < rng.choice([0.3, 0.5, 0.7])
        got = scenes.label(m)
        want = np.zeros_like(got)
        n = 0
        for y, x in zip(*np.nonzero(m), strict=True):
            if not want[y, x]:
                n += 1
                todo = [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < 17 and 0 <= b < 23 and m[a, b] and not want[a, b]:
                        want[a, b] = n
                        todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        pairs = set(zip(got.ravel().tolist(), want.ravel().tolist(), strict=True))
        assert len(pairs) == n + 1 and (0, 0) in pairs


def test_outline_and_polygon():
    square = np.ones((5, 7), bool)
    area, length, cx, cy = scenes.polygon(scenes.outline(square))
    assert (area, length, cx, cy) == (24.0, 20.0, 3.0, 2.0)
    assert scenes.polygon(scenes.outline(np.ones((1, 1), bool)))[:2] == (0.0, 0.0)
    y, x = np.ogrid[:31, :31]
    area, length, cx, cy = scenes.polygon(scenes.outline((x - 15) ** 2 + (y - 15) ** 2 <= 196))
    assert area == pytest.approx(math.pi * 14**2, rel=0.08) and (cx, cy) == pytest.approx((15, 15))


def test_density_and_opening():
    rng = np.random.default_rng(4)
    m = rng.random((12, 15)) < 0.4
    d = scenes.density(m, 2)
    assert all(d[y, x] == m[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].sum() for y in range(12) for x in range(15))
    dot = np.zeros((20, 20), bool)
    dot[3, 3] = True
    dot[8:16, 8:16] = True
    got = scenes.opened(dot)
    assert not got[3, 3] and got[10, 10] and not got[8, 8] and got.sum() >= 50
