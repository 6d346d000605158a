from pyspark.sql import functions as F

from fieldlens.functions import display
from fieldlens.operators import chains


def frame(spark, dots):
    return spark.createDataFrame([("k", i, float(x), float(y)) for i, (x, y) in enumerate(dots)], "k string, id long, x double, y double")


def test_chain_follows_the_route(spark):
    line = [(20 * i, 100 + 3 * (i % 2)) for i in range(10)]
    gap = [(20 * i, 100) for i in range(11, 16)]
    far = [(900, 900), (920, 900), (940, 900)]
    got = chains.dot_chains(frame(spark, line + gap + far), ["k"]).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.chain, r.pos)):
        by.setdefault(r.chain, []).append(r.id)
    assert by[0] in (list(range(15)), list(range(14, -1, -1))) and sorted(by[1]) == [15, 16, 17]


def test_loops_cores_rows(spark):
    ring = [(0, 0), (10, 0), (20, 0), (20, 10), (20, 20), (10, 20), (0, 20), (0, 10)]
    tail = [(32, 20), (44, 20)]
    assert sorted(r.id for r in chains.loop_core(frame(spark, ring + tail), ["k"], 13.0).collect()) == list(range(8))
    assert chains.loop_core(frame(spark, [(30 * k, 0) for k in range(12)]), ["k"], 40.0).count() == 6
    line = spark.createDataFrame([("k", i, 20.0 * i, 100.0, i not in (3,) and i < 11) for i in range(16)], "k string, id long, x double, y double, flag boolean")
    runs = chains.flagged_runs(line, ["k"], 4).collect()
    assert sorted(sorted(r.id for r in runs if r.run == n) for n in {r.run for r in runs}) in ([[4, 5, 6, 7, 8, 9, 10]], [[0, 1, 2, 4, 5, 6, 7, 8, 9, 10]])
    tight = [(i % 4 * 5, i // 4 * 5) for i in range(12)] + [(60, 60)]
    assert sorted(r.id for r in chains.dense_core(frame(spark, tight), ["k"]).collect()) == list(range(12))
    label = [(10 * i, 0) for i in range(4)] + [(10 * i, 14) for i in range(4)]
    assert chains.text_like(frame(spark, label), ["k"]).first().text_like
    assert not chains.text_like(frame(spark, [(10 * i, 3 * i) for i in range(8)]), ["k"]).first().text_like
    spot = chains.hotspots(frame(spark, [(0, 0), (30, 40)]), ["k"]).first()
    assert (spot.cx, spot.cy, spot.radius) == (15.0, 20.0, 43.0)


def test_display(spark):
    show = spark.range(1).select(
        display.badge(F.lit("degradation"), F.lit(True), F.lit("SSV NOK"), F.lit("RSRP"), F.lit("x")), display.layer_color(F.lit("900")), display.layer_color(F.lit("5")), display.warning_summary(F.lit("Continuous red points detected (7).")),
        display.visible_warnings(F.array(F.lit("Continuous red points detected (7)."), F.lit("b"))), display.coordinates(F.lit(1.0), F.lit(-2.0)), display.verdict_text(F.lit("cross"), F.lit(False), F.lit("No cross detected")), display.title(F.lit("degradation"), F.lit("coverage"), F.lit("x"), F.lit(None)),
        display.expected_headers(F.lit("best_server")), display.expected_headers(F.lit("serving_pci")), display.uses_exact_clusters(F.lit("SINR"), F.lit("quality"), F.lit("L2100 DT")), display.image_index(F.lit(0), F.lit(-1), F.lit(3)),
    ).first()
    assert tuple(show) == ("RSRP NOK", "#ff9800", "#aaaaaa", "Continuous red run (7)", ["b"], "1.000000, -2.000000", "No cross detected", "Coverage", ["psc", "cell id"], ["pci", "cell id", "psc"], True, 2)
    media = "array<struct<url:string,label:string>>"
    one = lambda m, u, x: spark.range(1).select(display.sector_media(F.lit(m).cast(media) if m is None else m, u, x)).first()[0]
    assert [tuple(r) for r in one(None, F.array(F.lit("u")), F.lit("v"))] == [("u", "")] and [tuple(r) for r in one(None, F.lit(None).cast("array<string>"), F.lit("v"))] == [("v", "")]
    names = spark.createDataFrame([("img10",), ("img9",), ("x",)], "n string").orderBy(display.natural_order(F.col("n")))
    assert [r.n for r in names.collect()] == ["x", "img9", "img10"]
