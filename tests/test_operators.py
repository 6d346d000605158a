import itertools
import math

import pytest
from pyspark.sql import functions as F

from fieldlens.functions import color, geo, text
from fieldlens.operators import angles, captions, reports, shapes, sites
from fieldlens.plans import angle_queries


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def test_texts(spark):
    got = one(spark, text.normalize_text(F.lit("  Débit DL — en Mobilité ")), text.normalize_text(F.lit(None)), text.first_number(F.lit("12,5 Mbps")), text.first_number(F.lit("none")), text.lte_band(F.lit("3. L1800 DT"), F.lit("L2600.xlsx")), text.lte_band(F.lit("x"), F.lit("L2600.xlsx")), text.lte_band(F.lit("x"), F.lit("y")), text.cell_ref(F.lit(11), F.lit(27)), text.column_index(F.lit("AB")), text.identifier_cost(F.lit("23430 (200,37.88%)"), F.lit("23436")), text.identifier_cost(F.lit("none"), F.lit("23436")))
    assert tuple(got) == ("debit dl en mobilite", "", 12.5, None, "L800", "L2600", None, "AB12", 27, 1, 15)


def test_forms_of_letters(spark):
    import re
    import unicodedata

    def plain(t):
        flat = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
        return re.sub(r"[^a-z0-9]+", " ", flat).strip()

    texts = ["ＤＬ　Ｔhroughput", "ﬁeld ﬂow", "½ mast ㎒", "x² №5", "Œuvre Ǆ", "e\u0301te\u0301", "日本 DL", "①②⑳", "ℒ800"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.normalize_text(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == {t: plain(t) for t in texts}


def test_cells_and_their_sites(spark):
    cells = spark.createDataFrame([(1, "3G_ALPHA_1", "ALPHA_1A", 0), (2, "3G_BETA", "SHARED1", 10), (3, "3G_SHARED", "SHARED1", 20), (4, "3G_GAMMA", "SHARED1", 30)], "ord int, name string, cell string, azimuth int")
    wanted = spark.createDataFrame([("alpha__1a",), ("shared 1",), ("none",), (None,)], "cell string")
    got = {r.cell: (r.site, r.azimuth) for r in sites.cell_sites(wanted, cells).collect()}
    assert got == {"alpha__1a": ("ALPHA_1", 0), "shared 1": ("SHARED", 20), "none": (None, None), None: (None, None)}


def test_colours(spark):
    names = {"Red": (234, 52, 45), "Yellow": (240, 224, 40), "Blue": (37, 72, 235), "Cyan": (8, 254, 254), "Neutral": (247, 247, 247)}
    for name, rgb in names.items():
        assert one(spark, color.sector_color_name(*[F.lit(c) for c in rgb]))[0] == name
    import colorsys

    for rgb in [(1, 2, 3), (200, 100, 50), (0, 0, 0), (255, 255, 255), (20, 200, 90)]:
        got = one(spark, *color.hsv(*[F.lit(c) for c in rgb]))
        assert list(got) == pytest.approx(colorsys.rgb_to_hsv(*[c / 255 for c in rgb]))


def test_geo(spark):
    lat, lng = geo.destination(F.lit(33.0), F.lit(-7.0), F.lit(90.0), 1000.0)
    assert one(spark, geo.haversine_m(F.lit(33.0), F.lit(-7.0), lat, lng))[0] == pytest.approx(1000, abs=1e-3)
    ring = one(spark, geo.wedge(F.lit(33.0), F.lit(-7.0), F.lit(120.0), 80.0))[0]
    assert len(ring) == 15 and ring[0] == ring[-1]
    assert one(spark, geo.azimuth_bonus(F.lit(92.0), F.lit(0.0)))[0] > 20
    assert list(one(spark, *geo.valid_position(F.lit("-33.5"), F.lit("7.2")))) == [33.5, -7.2]
    assert list(one(spark, *geo.valid_position(F.lit("95"), F.lit("7.2")))) == [None, None]


def matrix(spark, rows):
    return spark.createDataFrame([("c", s, z, n) for s, row in enumerate(rows) for z, n in enumerate(row)], "image string, source int, zone int, n long")


def directions(spark, *d):
    return spark.createDataFrame([("c", s, float(a)) for s, a in enumerate(d)], "image string, sector int, direction double")


def test_late_handover_cases(spark):
    m = matrix(spark, [[221, 0, 15], [64, 0, 118], [113, 369, 433]])
    d = directions(spark, 102.13, 285.68, 308.04)
    assert [(r.source, r.target) for r in angles.late_handover(m, d).collect()] == [(1, 0)]


def broadcasts(df):
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_late_handover_meets_without_broadcast(spark, data):
    assert not broadcasts(angle_queries.late_ho_rules(spark, str(data)))
    m = matrix(spark, [[221, 0, 15], [64, 0, 118], [113, 369, 433]]).where("n > 0")
    m = m.unionByName(m.selectExpr("'d' as image", "source", "zone", "n")).unionByName(m.selectExpr("'e' as image", "source", "zone", "n")).unionByName(m.selectExpr("cast(null as string) as image", "source", "zone", "n"))
    m = m.unionByName(spark.createDataFrame([("c", None, 2, 1), ("c", 2, None, 1), ("f", 0, 0, 5)], "image string, source int, zone int, n long"))
    d = directions(spark, 102.13, 285.68, 308.04)
    d = d.unionByName(d.selectExpr("'d' as image", "sector", "direction").where("sector < 2")).unionByName(d.selectExpr("'e' as image", "sector", "direction").where("sector > 0")).unionByName(d.selectExpr("'g' as image", "sector", "direction"))
    got = angles.late_handover(m, d.unionByName(d))
    assert sorted((r.image, r.source, r.target) for r in got.collect()) == [("c", 1, 0), ("d", 1, 0)]


def test_pair_late_handover_cases(spark):
    d = directions(spark, 66.92, 189.07, 316.66)
    metrics = spark.createDataFrame([("c", 0.0275, 0.1836)], "image string, misassigned double, mixed double")
    own = spark.createDataFrame([("c", 0, 0.0), ("c", 1, 62 / 338), ("c", 2, 14 / 783)], "image string, sector int, ratio double")
    got = angles.handover_warnings(matrix(spark, [[622, 0, 0], [3, 273, 62], [14, 0, 769]]), d, metrics, own).collect()
    assert sorted((r.kind, r.source, r.target) for r in got) == [("late_ho_pair", 1, 2), ("late_ho_pair", 2, 1)]
    calm = spark.createDataFrame([("c", 0.0042, 0.0)], "image string, misassigned double, mixed double")
    own = spark.createDataFrame([("c", 0, 0.0), ("c", 1, 3 / 271), ("c", 2, 14 / 783)], "image string, sector int, ratio double")
    got = angles.handover_warnings(matrix(spark, [[622, 0, 0], [3, 268, 0], [14, 0, 769]]), d, calm, own).collect()
    assert sorted((r.kind, r.source, r.target) for r in got) == [("late_ho_minor_pair", 0, 2), ("late_ho_minor_pair", 2, 0)]


def test_pair_late_handover_meets_without_broadcast(spark, data):
    assert not broadcasts(angle_queries.pair_ho_rules(spark, str(data))) and not broadcasts(angle_queries.minor_pair_rules(spark, str(data)))
    m = matrix(spark, [[622, 0, 0], [3, 273, 62], [14, 0, 769]])
    m = m.unionByName(m.selectExpr("'d' as image", "source", "zone", "n")).unionByName(m.selectExpr("'e' as image", "source", "zone", "n"))
    d = directions(spark, 66.92, 189.07, 316.66)
    d = d.unionByName(d.selectExpr("'d' as image", "sector", "direction")).unionByName(d.selectExpr("'e' as image", "sector", "direction"))
    metrics = spark.createDataFrame([("c", 0.08, 0.20), ("c", 0.0, 0.0), ("d", 0.09, 0.0), ("e", 0.0, 0.0)], "image string, misassigned double, mixed double")
    own = spark.createDataFrame([("c", 1, 0.18), ("c", 1, 0.2), ("d", 1, 0.2), ("e", 1, 0.25), ("e", 2, 0.2)], "image string, sector int, ratio double")
    got = angles.pair_late_handover(m, d, metrics, own).collect()
    assert sorted(tuple(r) for r in got) == [("c", "late_ho_pair", 1, 2), ("c", "late_ho_pair", 2, 1)]


def test_captions(spark):
    wanted = {"Serving Cell ID": "serving_cell_id", "Best Server": "best_server", "CS RxLev": "cs_rxlev", "Cells Qualité SINR": "quality_sinr", "Best RSCP in active set in connect state": "coverage_rscp", "Best Ec/Io in active set": "quality_ecno", "Débit DL en mobilité": "throughput_dl", "Débit UL en mobilité": "throughput_ul", "hello": None}
    got = captions.match_profile(spark.createDataFrame([(t,) for t in wanted], "value string")).collect()
    assert {r.value: r.profile for r in got} == wanted


def most_joined(spark, df):
    """The most rows that a join gives as df runs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = df._jdf.queryExecution()
        run.toRdd().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")

    def walk(node):
        own = node.metrics().apply("numOutputRows").value() if "Join" in node.nodeName() else 0
        return max([own, *[walk(node.children().apply(k)) for k in range(node.children().size())]])

    return walk(run.executedPlan())


def test_nearby_score_meets_by_places(spark):
    spots = [(0, 3, 4), (0, 3, 14), (0, 9, 8), (0, 13, 4), (0, 14, 4), (0, 40, 20), (1, 3, 4), (0, None, 4), (None, 3, 4)]
    cells = [(*spots[k % len(spots)], None if k % 11 == 0 else f"v{k * 7 % 50}", k % 4 if k % 13 else None) for k in range(900)]
    anchors = [(*spots[k % len(spots)], k // 2 if k % 17 else None) for k in range(300)] + [(2, 0, 0, 7)]
    c = spark.createDataFrame(cells, "sheet int, row int, col int, value string, strength int")
    a = spark.createDataFrame(anchors, "sheet int, row int, col int, anchor_no long")
    got = captions.nearby_score(a, c, ["sheet"])
    assert 0 < most_joined(spark, captions.nearby_score(a, c, ["sheet"])) <= 1000
    scores, texts = {}, {}
    for (s, r, k, no), (s2, r2, k2, value, strength) in itertools.product(anchors, cells):
        if None not in (s, r, k, no, r2) and s == s2 and (strength or 0) > 0 and abs(r - r2) + abs(k - k2) <= 10:
            scores[s, no] = scores.get((s, no), 0) + 12 * strength / (1 + abs(r - r2) + abs(k - k2))
            texts.setdefault((s, no), []).extend([f"{chr(65 + k2)}{r2 + 1}: {value}"] * (value is not None))
    want = [(s, no, round(scores.get((s, no), 0.0), 6), sorted(texts[s, no])[:6] if (s, no) in texts else None) for s, _, _, no in anchors]
    assert sorted([(r.sheet, r.anchor_no, round(r.score, 6), r.texts) for r in got.collect()], key=repr) == sorted(want, key=repr)


def test_nearest_anchor_against_all_pairs(spark):
    import random

    pick = random.Random(3)
    spot = lambda wide, high: (pick.randrange(-high, high), pick.randrange(-wide, wide))
    anchors = [(s, *spot(w, h), pick.randrange(40)) for s, w, h in ((0, 5, 5), (0, 200, 3), (1, 3, 300), (2, 1, 1)) for _ in range(60)] + [(1, None, 4, 0), (1, 2, 2, None), (3, 5, None, 9), (3, None, None, 8), (4, 7, 7, None), (None, 1, 1, 1)]
    cells = [(s, *spot(w, h)) for s in (0, 1, 2, 4, 5) for w, h in ((6, 6), (400, 400)) for _ in range(60)] + [(1, None, 3), (3, 1, 1), (None, 1, 1), (0, 2, 2), (0, 2, 2)]
    a, c = spark.createDataFrame(anchors, "sheet int, row int, col int, anchor_no long"), spark.createDataFrame([(k, *x) for k, x in enumerate(cells)], "id int, sheet int, row int, col int")
    got = captions.nearest_anchor(c, a, ["sheet"])
    assert got.columns == ["id", "sheet", "row", "col", "anchor_no", "distance"] and got.schema["distance"].dataType.simpleString() == "int"
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
    want = []
    for k, (s, r, col) in enumerate(cells):
        far = [(None in (r, col, r2, c2), abs((r or 0) - (r2 or 0)) + abs((col or 0) - (c2 or 0)) if None not in (r, col, r2, c2) else 0, no is None, no or 0) for s2, r2, c2, no in anchors if s is not None and s == s2]
        if far:
            lost, d, none, no = min(far)
            want.append((k, None if none else no, None if lost else d))
    assert sorted((r.id, r.anchor_no, r.distance) for r in got.collect()) == sorted(want)


def test_throughput(spark):
    rows = spark.createDataFrame([("L2100", 24.0, 16.0), ("L800", 12.0, 8.0), ("L800", 15.0, 10.0), (None, 90.0, 90.0)], "band string, dl_mbps double, ul_mbps double")
    got = captions.throughput_verdict(rows).collect()
    assert [r.verdict for r in got] == ["SSV NOK", "SSV NOK", "SSV OK", "SSV NOK"]
    assert got[0].warnings == ["Avg DL Throughput 24.00 Mbps is below the L2100 minimum of 25 Mbps."]


def test_islands_wrap(spark):
    rows = spark.createDataFrame([("k", float(a)) for a in (350, 355, 5, 12, 100, 110, 200)], "k string, angle double")
    got = {r.island: (r.n, r.span) for r in angles.angular_islands(rows, ["k"]).collect()}
    assert got == {0: (4, 22.0), 1: (2, 10.0), 2: (1, 0.0)}
    assert angles.largest_island(rows, ["k"]).first().n == 4


def test_box_sum_and_components(spark):
    cells = [(0, x, y, (x * 7 + y * 3) % 3 == 0) for x in range(8) for y in range(6)]
    df = spark.createDataFrame([(i, x, y, int(m)) for i, x, y, m in cells], "image int, x int, y int, m int")
    got = {(r.x, r.y): r.density for r in shapes.box_sum(df, ["image"], 1).collect()}
    for _, x, y, _ in cells:
        assert got[x, y] == sum(m for _, a, b, m in cells if abs(a - x) <= 1 and abs(b - y) <= 1)
    snake = [(x, 0) for x in range(9)] + [(8, 1), (8, 2)] + [(x, 3) for x in range(8)] + [(20, 20)]
    parts = shapes.image_components(spark.createDataFrame([("i", x, y) for x, y in snake], "image_id string, x int, y int"))
    assert sorted(r.area for r in shapes.component_stats(parts, ["image_id"]).collect()) == [1, 19]


def test_connected_against_search(spark):
    pts = [(k, (k * 37 % 101) / 3.0, (k * 53 % 97) / 3.0) for k in range(120)]
    df = spark.createDataFrame([(1, *p) for p in pts], "one int, id long, x double, y double")
    got = {r.id: r.component for r in shapes.connected(df, shapes.distance_pairs(df, ["one"], 2.5)).collect()}
    label = {k: k for k, _, _ in pts}
    for _ in pts:
        for (a, x, y), (b, u, v) in itertools.combinations(pts, 2):
            if math.hypot(x - u, y - v) <= 2.5:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_assignment_and_merge(spark):
    costs = spark.createDataFrame([("k", r, n, float(c)) for r, n, c in [(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 9)]], "k string, row long, name string, cost double")
    assert {r.row: r["name"] for r in shapes.assign_rows(costs, ["k"]).collect()} == {1: "b", 2: "a"}
    import random
    from fractions import Fraction

    rng = random.Random(5)
    for n, m in ((1, 1), (3, 3), (3, 5), (5, 6)):
        c = [[Fraction(rng.randint(0, 6)) for _ in range(m)] for _ in range(n)]
        best = min(sum(c[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        chosen = shapes.cheapest(c)
        assert len(set(chosen)) == n and sum(c[i][j] for i, j in enumerate(chosen)) == best
    many = spark.createDataFrame([("m", i, f"n{j:02d}", float((i * 7 + j * 3) % 13)) for i in range(14) for j in range(14)] + [("t", i, n, 1.0) for i in range(3) for n in "cab"], costs.schema)
    got = shapes.assign_rows(many, ["k"]).collect()
    assert len({r["name"] for r in got if r.k == "m"}) == 14 and [r["name"] for r in sorted(got, key=lambda r: r.row) if r.k == "t"] == ["a", "b", "c"]
    places = spark.createDataFrame([("S", 1, 30.0, -7.0), ("S", 2, 30.0003, -7.0), ("S", 3, 30.0006, -7.0), ("T", 4, 30.0, -7.0)], "base string, ord long, lat double, lng double")
    assert {r.ord: (r.leader, r.cluster) for r in shapes.merge_co_located(places).collect()} == {1: (1, 0), 2: (1, 0), 3: (3, 1), 4: (4, 0)}


def test_reports(spark):
    marks = spark.createDataFrame([(1, 2, 30, 40, "#fff"), (1, 1, 10, 20, "#000")], "image int, ord int, x int, y int, fill string")
    import base64

    svg = base64.b64decode(reports.svg_markers(marks, "image", 100, 50).first().svg.split(",")[1]).decode()
    assert svg.index('cx="10"') < svg.index('cx="30"')
    kml = reports.kml_document(spark.createDataFrame([("s", 1, "A & B", 30.0, -7.0)], "site string, ord int, name string, lat double, lng double"), "site")
    assert "A &amp; B" in kml.first().kml
    import io
    import zipfile

    assert zipfile.ZipFile(io.BytesIO(bytes(reports.kmz_files(kml, "site").first().kmz))).namelist() == ["doc.kml"]
    names = spark.createDataFrame([("3. L800 DT en mobilite",), ("Cover",), ("5. L800 Volte en Mobilite",)], "name string")
    assert [r.name for r in reports.sheet_scores(names).orderBy(F.desc("score")).collect()] == ["3. L800 DT en mobilite", "5. L800 Volte en Mobilite", "Cover"]


def test_red_clusters(spark):
    dots = [("a", k, 250.0 + 10 * k, 148.0) for k in range(7)] + [("a", 10 + k, 30.0, 20.0) for k in range(2)]
    df = spark.createDataFrame([(i, k, x, y, 520, 250) for i, k, x, y in dots], "image_id string, id long, x double, y double, width_px int, height_px int")
    got = shapes.red_clusters(df, ["image_id"]).collect()
    assert [(r.n, r.extent, r.radius, r.cx, r.cy) for r in got] == [(7, 60.0, 55, 280, 148)]
    diagonal = spark.createDataFrame([("d", k, 100.0 + 20 * k, 100.0 + 20 * k, 520, 250) for k in range(6)] + [("s", k, 50.0 + 4.5 * (k % 3), 50.0 + 9 * (k // 3), 520, 250) for k in range(6)], df.schema)
    assert [(r.image_id, r.n, r.radius) for r in shapes.red_clusters(diagonal, ["image_id"]).collect()] == [("d", 6, 75)]


def test_a_sector_alone_holds_all_angles(spark):
    rows = spark.createDataFrame([("i", 1, 10.0), ("i", 1, 200.0)], "image string, sector int, angle double")
    assert angles.intrusion_ratio(rows).first().ratio == 0.0
    assert angles.cross_verdict(rows).first().verdict == "No cross detected"


def test_nearest_and_extent_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    pts = [("a", k, rng.random() * 10, rng.random() * 400) for k in range(150)] + [("a", 150 + k, 5000.0 + k, 7.0) for k in range(3)] + [("b", 1, 0.0, 0.0), ("b", 2, 0.0, 0.0), ("c", 9, 1.0, 1.0)]
    df = spark.createDataFrame(pts, "k string, id long, x double, y double")
    got = {(r.k, r.a, r["rank"]): (r.b, round(r.distance, 9)) for r in shapes.nearest_distances(df, ["k"], 3).collect()}
    want = {}
    for g, i, x, y in pts:
        near = sorted((math.hypot(x - u, y - v), j) for h, j, u, v in pts if h == g and j != i)[:3]
        want.update({(g, i, n + 1): (j, round(d, 9)) for n, (d, j) in enumerate(near)})
    assert got == want
    far = {r.k: (r.n, round(r.extent, 9)) for r in shapes.extent(df, ["k"]).collect()}
    for g in "abc":
        own = [(x, y) for h, _, x, y in pts if h == g]
        assert far[g] == (len(own), round(max(math.dist(p, q) for p in own for q in own), 9))

def test_sites(spark):
    cells = spark.createDataFrame([(1, "2G_A", "c1", "2G", 0, 50), (2, "3G_A", "c2", "3G", 0, 10700), (3, "2G_B", "c3", "2G", 120, 700)], "ord int, name string, cell string, tech string, azimuth int, freq long")
    assert tuple(sites.sites_by_technology(cells).first()) == (1, 0, 1)
    assert {(r.site, r.azimuth): (r.layers_2g, r.layers_3g) for r in sites.layer_sets(cells).collect()} == {("A", 0): (["900"], ["10700"]), ("B", 120): (["1800"], [])}
