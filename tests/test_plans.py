import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldlens.operators import reports
from fieldlens.plans import audit, validation
from fieldlens.sources import workbook
from fieldlens.sources.images import encode_png

from .test_scenes import canvas, crossed, large_run, no_cross, sparse
from .test_sources import books


@pytest.fixture(scope="module")
def reports_of(spark):
    sheet = "3. L800 DT en mobilite"
    own = [(0, 0, "Serving PCI"), (20, 0, "Coverage (RSRP)"), (40, 0, "Quality SINR"), (60, 3, "Cell Name"), (60, 4, "PCI"), (61, 3, "SITE_1"), (61, 4, "101")]
    rates = [(0, 1, "Avg DL Throughput (Mbps)"), (0, 2, 12.0), (1, 1, "Avg UL Throughput (Mbps)"), (1, 2, 16.0)]
    both = {sheet: own, "L800 rates": rates}
    one = {sheet: [(0, 0, "Serving PCI")]}
    pictures = lambda *p: {sheet: [(1 + 20 * k, 0, encode_png(x)) for k, x in enumerate(p)]}
    df = books(
        spark, bad=workbook.write_workbook(both, pictures(crossed(), large_run(), sparse())), crossed=workbook.write_workbook(one, pictures(crossed())), clear=workbook.write_workbook(one, pictures(no_cross())),
        ok=workbook.write_workbook({sheet: [(0, 0, "Coverage (RSRP)")]}, pictures(sparse())), blank=workbook.write_workbook(one, pictures(canvas(300, 200))), broken=workbook.write_workbook(one, {sheet: [(1, 0, b"no image")]}), nothing=workbook.write_workbook({"Cover": [(0, 0, "x")]}),
    )
    return {r.workbook: (r.verdict, json.loads(r.report)) for r in validation.validate(df).collect()}


def test_verdicts_of_workbooks(reports_of):
    assert {k: v for k, (v, _) in reports_of.items()} == {"bad": "SSV NOK", "crossed": "Cross detected", "clear": "No cross detected", "ok": "SSV OK", "blank": "No cross detected", "broken": "No cross detected"}


def test_report_of_a_workbook(reports_of):
    doc = reports_of["bad"][1]
    assert (doc["success"], doc["isFailure"], doc["cross"], doc["verdict"], doc["analysisCount"]) == (True, True, True, "SSV NOK", 4)
    assert [(a["label"], a["verdict"], a["isFailure"]) for a in doc["analyses"]] == [("Serving PCI", "Cross detected", True), ("Coverage (RSRP)", "SSV NOK", True), ("Quality (SINR)", "SSV OK", False), ("Avg Throughput", "SSV NOK", True)]
    assert doc["summary"]["failedImages"] == 3 and doc["summary"]["clearImages"] == 1 and len(doc["summary"]["labels"]) == 4
    cross, kpi, fine, rate = doc["analyses"]
    assert [c["name"] for c in cross["detected_colors"]] == ["sector_1", "sector_2", "sector_3"] and cross["detected_colors"][0]["rgb"] == [37, 72, 235]
    assert cross["metrics"]["analysis_mode"] == "dense_cross_solver" and cross["metrics"]["misassigned_pixel_ratio"] > 0.18 and set(cross["metrics"]["dominant_angles"]) == {"sector_1", "sector_2", "sector_3"}
    assert cross["selection"]["anchor"] == {"row": 2, "col": 1, "ref": "A2"} and cross["selection"]["captionCell"] == "A1" and cross["selection"]["nearbyText"] == ["A1: Serving PCI"]
    assert kpi["metrics"]["continuous_red_count"] == 6 and kpi["metrics"]["degradation_detected"] and kpi["annotatedPreview"].startswith("data:image/svg+xml;base64,")
    assert fine["previewDeferred"] and "previewImage" not in fine and cross["previewImage"].startswith("data:image/png;base64,")
    assert rate["metrics"]["dl_threshold_mbps"] == 15.0 and rate["selection"]["nearbyText"][0] == "B2: Avg UL Throughput (Mbps)" and "previewImage" not in rate
    assert doc["summary"]["warnings"] == [w for a in doc["analyses"] for w in a["warnings"]] and doc["metrics"] == cross["metrics"]


def test_what_cannot_be_judged_says_why(reports_of):
    blank, broken = (reports_of[k][1]["analyses"][0]["metrics"] for k in ("blank", "broken"))
    assert blank["analysis_unavailable"] and blank["reason_code"] == "insufficient_site_center_density" and broken["reason_code"] == "unreadable_image"
    assert reports_of["clear"][1]["analyses"][0]["siteCenter"]["x"] > 300


def test_legend_names_cells(spark):
    from fieldlens.operators import legends

    details = spark.createDataFrame([("i", 0, 0, 1, "m"), ("i", 1, 1, 2, "n")], "image string, ord int, source int, target int, message string")
    names = spark.createDataFrame([("i", 0, "A"), ("i", 1, "B")], "image string, sector int, name string")
    assert legends.warnings_with_names(details, names).first().warnings == ["m", "Possible late HO from A sector to B sector", "n"]
    sheet = "3. L800 DT en mobilite"
    cells = [(0, 0, "Serving PCI"), (60, 3, "Cell Name"), (60, 4, "PCI"), (61, 3, "SITE_1"), (61, 4, "101"), (62, 3, "SITE_2"), (62, 4, "102")]
    book = workbook.write_workbook({sheet: cells}, {sheet: [(1, 0, encode_png(no_cross()))]})
    line = lambda k, t: f"{t}\t0.2\t{1 - (18 + 16 * k) / 80}\t0.5\t{1 - (8 + 16 * k) / 80}"
    ocr = spark.createDataFrame([("w|0|serving_pci", 0, line(0, "101 (50%)")), ("w|0|serving_pci", 1, line(2, "102 (40%)"))], "image string, ord int, line string")
    df = books(spark, w=book)
    read = workbook.read_cells(df)
    from fieldlens.operators import scenes
    from fieldlens.plans import workbooks

    found = workbooks.image_candidates(read, workbook.read_anchors(df), workbook.read_sheets(df)).withColumn("image", F.concat_ws("|", "workbook", F.col("sheet_no").cast("string"), "profile"))
    pictures = found.join(workbook.read_media(df).select("workbook", "media", "content"), ["workbook", "media"]).select("image", "content")
    got = validation.cell_names(found, read, pictures, scenes.sector_table(pictures), ocr)
    assert {r.sector: r["name"] for r in got.collect()} == {0: "SITE_1", 2: "SITE_2"}


def audit_book():
    labels = [(2, 2 * k, f"{30 * k}  Degrés") for k in range(6)] + [(8, 2 * k, f"{180 + 30 * k} DEGRÉS") for k in range(6)]
    place = [(20, 0, "Coordonnées GPS Lat:"), (20, 1, "33.5"), (20, 2, "Long:"), (20, 3, "7.25 E"), (21, 5, "Azimut"), (22, 0, "Secteur 1"), (22, 5, 50.0), (23, 0, "Secteur 2"), (23, 5, "130"), (24, 0, "Secteur 3"), (24, 5, "x")]
    after = [(40, 0, "Coordonnées GPS Lat:"), (40, 1, "none"), (40, 2, "Long:"), (40, 3, "7"), (42, 0, "Secteur 1"), (42, 4, 60.0), (43, 0, "Secteur 2"), (43, 4, 140.0)]
    photos = [(70, 0, "Photos Azimut"), (72, 0, "Apres optimisation"), (74, 0, "Secteur 1"), (74, 6, "Secteur 2"), (80, 0, "Appendix 3: Tilt Méc"), (82, 0, "Secteur 1"), (82, 6, "Secteur 2")]
    shots = [(3, 2 * k, bytes([k])) for k in range(6)] + [(9, 2 * k, bytes([6 + k])) for k in range(6)]
    sector = [(75, 1, b"s1"), (76, 7, b"s2"), (83, 3, b"s1 tilt"), (99, 0, b"lost")]
    return workbook.write_workbook({"Audit": labels + place + after + photos}, {"Audit": shots + sector})


def test_site_audit(spark):
    df = books(spark, **{"SITE A & B.xlsx": audit_book()})
    cells, anchors, media = workbook.read_cells(df).cache(), workbook.read_anchors(df).cache(), workbook.read_media(df)
    contents = {r.media: bytes(r.content) for r in media.collect()}
    assert {r.angle: contents[r.media] for r in audit.panoramas(cells, anchors).collect()} == {30 * k: bytes([k]) for k in range(12)}
    config = audit.sector_config(cells)
    assert {(r.phase, r.sector_no, r["name"], r.azimuth) for r in config.collect()} == {("avant", 1, "Secteur 1", 50.0), ("avant", 2, "Secteur 2", 130.0), ("apres", 1, "Secteur 1", 60.0), ("apres", 2, "Secteur 2", 140.0)}
    assert tuple(audit.site_place(cells).first())[1:] == (33.5, -7.25)
    got = {(r.sector_no, r.image_no): (contents[r.media], r.section) for r in audit.sector_images(cells, anchors).collect()}
    assert got == {(1, 1): (b"s1", "Photos Azimut"), (2, 1): (b"s2", "Photos Azimut"), (1, 2): (b"s1 tilt", "Photos Tilt Méc")}
    views = config.where("phase = 'apres'").select("workbook").distinct().select("workbook", F.explode(F.array(F.lit(70.0), F.lit(100.0), F.lit(130.0))).alias("angle"))
    assert {r.angle: r.sector for r in audit.in_view(config.where("phase = 'apres'"), views, ["workbook"]).collect()} == {70.0: "Secteur 1", 100.0: None, 130.0: "Secteur 2"}
    kmz = audit.audit_kmz(cells, anchors, media).first()
    z = zipfile.ZipFile(io.BytesIO(bytes(kmz.kmz)))
    assert len(z.namelist()) == 15 and z.read("images/pano_330.jpg") == bytes([11]) and z.read("images/sector_2.jpg") == b"s2"
    kml = z.read("doc.kml").decode()
    from xml.etree import ElementTree

    ElementTree.fromstring(kml)
    assert kml.count("<Placemark>") == 15 and "SITE A &amp; B - Site Audit" in kml and "Secteur 1 (60.0°)" in kml
    bare = audit.audit_kml(audit.site_place(cells), config.where("false").withColumn("picture", F.lit(None).cast("string")), audit.panoramas(cells, anchors).where("false")).first().kml
    assert bare.count("<Polygon>") == 3


def test_panoramas_turn(spark):
    pictures = spark.createDataFrame([("s", k, float(w)) for k, w in enumerate((100, 200, 100, 100))], "site string, k int, length double")
    views = spark.createDataFrame([("s", float(a)) for a in (0, 45, 90, 315, 359.99999)], "site string, angle double")
    got = [round(r.offset, 2) for r in reports.track_offsets(pictures, views, ["site"], ["k"]).orderBy("angle").collect()]
    assert got == [50.0, 125.0, 200.0, 500.0, 550.0]
