from pyspark.sql import functions as F

from fieldlens.operators import legends
from fieldlens.sources import uploads


def test_rows_and_identifiers(spark):
    lines = spark.createDataFrame([("i", 0, "23430 (200,37.88%)\t0.1\t0.8\t0.3\t0.9"), ("i", 1, "23440 x\t0.1\t0.2\t0.3\t0.3"), ("i", 2, "broken"), ("i", 3, "\t1\t1\t1\t1")], "image string, ord int, line string")
    rows = legends.parse_ocr(lines, ["image"])
    assert [(r.row, r.text, round(r.y_center, 2)) for r in rows.orderBy("row").collect()] == [(1, "23430 (200,37.88%)", 0.85), (2, "23440 x", 0.25)]
    ids = spark.createDataFrame([("i", "23440"), ("i", "23430")], "image string, identifier string")
    assert {r.row: r["name"] for r in legends.identifiers_of_rows(rows, ids, ["image"]).collect()} == {1: "23430", 2: "23440"}


def test_sectors_find_their_rows(spark):
    rows = spark.createDataFrame([("i", 1, 230, 50, 40, 0.0), ("i", 2, 40, 70, 230, None)], "image string, row int, r int, g int, b int, azimuth double")
    sectors = spark.createDataFrame([("i", 0, 234, 52, 45, 90.0), ("i", 1, 37, 72, 235, 10.0), ("i", 2, 60, 255, 60, 10.0)], "image string, sector int, r int, g int, b int, direction double")
    assert {r.sector: r.row for r in legends.rows_of_sectors(rows, sectors, ["image"]).collect()} == {0: 1, 1: 2}


def test_swatches(spark):
    s = spark.createDataFrame([("i", 1, 200, 0, 0), ("i", 2, 210, 5, 5), ("i", 3, 0, 0, 200)], "image string, swatch int, r int, g int, b int")
    kept = legends.distinct_swatches(s, ["image"], ["swatch"]).first().swatches
    assert [k.swatch for k in kept] == [1, 3]
    strong = s.where("swatch = 1").select("image", "r", "g", "b")
    cand = spark.createDataFrame([("i", 7, 10, 10, 190)], "image string, cand int, r int, g int, b int")
    assert legends.missing_swatch(s, strong, cand, ["image"]).first().swatch == 3


CELLS = "workbook string, sheet_no int, sheet string, row int, col int, value string"


def test_identifier_lookup(spark):
    own = [("w", 0, "Own", 3, 19, "Cell Name"), ("w", 0, "Own", 3, 20, "Cell ID"), ("w", 0, "Own", 4, 19, "A"), ("w", 0, "Own", 4, 20, "23435"), ("w", 0, "Own", 6, 19, "B"), ("w", 0, "Own", 6, 20, "23436"), ("w", 0, "Own", 9, 20, "999"), ("w", 0, "Own", 9, 19, "far")]
    other = [("w", 1, "Z", 0, 0, "Cell name"), ("w", 1, "Z", 0, 1, "Azimuth"), ("w", 1, "Z", 0, 3, "cell id"), ("w", 1, "Z", 1, 3, "234-35"), ("w", 1, "Z", 1, 0, "C"), ("w", 1, "Z", 1, 1, "120"), ("w", 1, "Z", 2, 0, "no digits"), ("w", 1, "Z", 2, 3, "abc")]
    cells = spark.createDataFrame(own + other, CELLS)
    assert {r.identifier: (r["name"], r.azimuth) for r in legends.identifier_lookup(cells).collect()} == {"23435": ("C", 120.0), "23436": ("B", None)}
    first = spark.createDataFrame([("w", "Z")], "workbook string, own_sheet string")
    assert {r.identifier: r["name"] for r in legends.identifier_lookup(cells, own=first).collect()} == {"23435": "A", "23436": "B"}


def test_the_last_row_of_a_colour_counts(spark):
    rows = spark.createDataFrame([("i", 1, 230, 50, 40, None), ("i", 2, 236, 54, 48, None), ("i", 3, 0, 255, 0, None)], "image string, row int, r int, g int, b int, azimuth double")
    sectors = spark.createDataFrame([("i", 0, 234, 52, 45, 90.0), ("i", 1, 37, 72, 235, 10.0)], "image string, sector int, r int, g int, b int, direction double")
    assert [(r.sector, r.row) for r in legends.rows_of_sectors(rows, sectors, ["image"]).collect()] == [(0, 2)]


def test_uploads(spark):
    ok = lambda u: uploads.is_allowed_url(F.lit(u), ["a.example.com", ".store.example.org"])
    row = spark.range(1).select(ok("https://a.example.com/x"), ok("https://b.store.example.org/x"), ok("http://a.example.com/x"), ok("https://evil.com/a.example.com"), ok("nonsense"), uploads.safe_name(F.lit(" ../Ä b.xlsx")), uploads.should_retry(F.lit("degradation"), F.lit("Quality"), F.lit(False), F.lit(3)), uploads.should_retry_error(F.lit("degradation"), F.lit("coverage"), F.lit("It does not contain enough colored measurement points.")), uploads.is_larger(F.lit(800), F.lit(400), F.lit(1000), F.lit(500)), uploads.preparation(F.lit(" Direct "), F.lit(False))).first()
    assert tuple(row) == (True, True, False, False, False, "b.xlsx", True, True, True, "direct")
