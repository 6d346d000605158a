import numpy as np
from pyspark.sql import functions as F

from fieldlens.plans import workbooks
from fieldlens.sources import images, workbook
from fieldlens.streaming import rollup


def books(spark, **named):
    from fieldlens.shipping import ship

    ship(spark)
    return spark.createDataFrame([(k, bytearray(v)) for k, v in named.items()], "path string, content binary")


def test_workbook_round_trip(spark):
    png = images.encode_png(np.full((4, 5, 3), 200, np.uint8))
    data = workbook.write_workbook({"One": [(0, 0, "a & b"), (2, 27, 3.5)], "Two": [(1, 1, "x")]}, {"Two": [(3, 2, png)]})
    df = books(spark, w=data, broken=b"no zip")
    assert {(r.sheet, r.row, r.col, r.value, r.is_str) for r in workbook.read_cells(df).collect()} == {("One", 0, 0, "a & b", True), ("One", 2, 27, "3.5", False), ("Two", 1, 1, "x", True)}
    assert [r.sheet for r in workbook.read_cells(df, only=("Two",)).collect()] == ["Two"]
    assert [(r.sheet, r.row, r.col, r.media) for r in workbook.read_anchors(df).collect()] == [("Two", 3, 2, "xl/media/image1.png")]
    media = workbook.read_media(df).withColumn("again", workbook.image_mime(F.col("content"))).first()
    assert (media.mime, media.again, bytes(media.content)) == ("image/png", "image/png", png)


def test_files_are_read_through_spark(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook.write_workbook({"S": [(0, 0, "v")]}))
    assert workbook.read_cells(workbook.files(spark, str(tmp_path))).first().value == "v"


def test_throughput_pipeline(spark):
    cells = [(3, 1, "Avg DL Throughput (Mbps)"), (3, 2, "24"), (4, 1, "Avg UL Throughput (Mbps)"), (4, 2, 16.0)]
    df = books(spark, w=workbook.write_workbook({"Cover": [(0, 0, "x")], "L2100 DT": cells}))
    r = workbooks.throughput_verdicts(workbook.read_cells(df)).first()
    assert (r.band, r.dl_mbps, r.ul_mbps, r.verdict, r.warnings, r.dl_label_ref, r.ul_value_ref) == ("L2100", 24.0, 16.0, "SSV NOK", ["Avg DL Throughput 24.00 Mbps is below the L2100 minimum of 25 Mbps."], "B4", "C5")


def test_image_candidates(spark):
    png = images.encode_png(np.zeros((2, 2, 3), np.uint8))
    df = books(spark, w=workbook.write_workbook({"3. L800 DT en mobilite": [(0, 0, "Serving PCI"), (20, 0, "Best Server")]}, {"3. L800 DT en mobilite": [(1, 0, png), (21, 0, png)]}))
    got = workbooks.image_candidates(workbook.read_cells(df), workbook.read_anchors(df), workbook.read_sheets(df)).orderBy("media").collect()
    assert [(r.profile, r.media, r.kind, r.caption_ref, r.texts[0]) for r in got] == [("serving_pci", "xl/media/image1.png", "cross", "A1", "A1: Serving PCI"), ("best_server", "xl/media/image2.png", "cross", "A21", "A21: Best Server")]


def test_cell_database_and_neighbours(spark):
    head = ["Technologie", "x", "BTSName", "CellName", "Latitude", "Longitude", "Azimut", "BCCH"]
    rows = [["2G", "", "2G_A", "A1", "33.1", "7.2", 0.0, 50.0], ["2G", "", "2G_A", "A2", "33.1", "7.2", 120.0, 700.0], ["2G", "", "2G_B", "B1", "", "7.2", 0.0, 1.0]]
    cells = [(0, c, v) for c, v in enumerate(head)] + [(r, c, v) for r, row in enumerate(rows, 1) for c, v in enumerate(row) if v != ""]
    df = books(spark, w=workbook.write_workbook({"2G": cells}))
    got = workbooks.cell_database(workbook.read_cells(df, only=("2G", "3G"))).orderBy("ord").collect()
    assert [(r["name"], r.cell, r.freq, r.lat, r.lng, r.azimuth) for r in got] == [("2G_A", "A1", 50, 33.1, -7.2, 0), ("2G_A", "A2", 700, 33.1, -7.2, 120)]
    pairs = [(0, 0, "Source GSM"), (0, 1, "Target GSM"), (0, 2, "Source DCS"), (0, 3, "Target DCS"), (1, 0, "A1"), (1, 1, "B1"), (2, 2, "A2"), (2, 3, "B2")]
    n = workbooks.neighbour_pairs(workbook.read_cells(books(spark, w=workbook.write_workbook({"N": pairs}))))
    assert {(r.src, r.tgt, r.layer) for r in n.collect()} == {("A1", "B1", "GSM"), ("A2", "B2", "DCS")}


def test_images(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 255, (7, 9, 3), dtype=np.uint8)
    assert (images.decode_png(images.encode_png(a)) == a).all()
    row = lambda line: line[:, ::-1].tobytes() + b"\0" * (-line.size % 4)
    head = b"BM" + b"\0" * 8 + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (9).to_bytes(4, "little") + (7).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + b"\0" * 24
    bmp = head + b"".join(row(line) for line in a[::-1])
    assert (images.decode_bmp(bmp) == a).all()
    df = images.pixels(books(spark, i=images.encode_png(a)).withColumnRenamed("path", "image_id"))
    assert df.count() == 63 and df.where("x = 2 and y = 3").first()[3:] == tuple(int(v) for v in a[3, 2])


def test_jpeg_against_the_image_source(spark, tmp_path):
    """What Java's writer makes and Spark's reader reads, baseline, progressive and grey."""
    from fieldlens.sources import jpeg

    rng = np.random.default_rng(3)
    a = np.full((75, 109, 3), 247, np.uint8)
    y, x = np.ogrid[:75, :109]
    for _ in range(20):
        a[(x - rng.integers(0, 109)) ** 2 + (y - rng.integers(0, 75)) ** 2 <= rng.integers(9, 150)] = rng.integers(0, 255, 3)
    (tmp_path / "a.png").write_bytes(images.encode_png(a))
    java = spark._jvm.javax.imageio
    source = java.ImageIO.read(spark._jvm.java.io.File(str(tmp_path / "a.png")))
    for name, kind, progressive in (("base", 1, False), ("progressive", 1, True), ("grey", 10, False)):
        plain = spark._jvm.java.awt.image.BufferedImage(109, 75, kind)
        plain.createGraphics().drawImage(source, 0, 0, None)
        writer = java.ImageIO.getImageWritersByFormatName("jpeg").next()
        to = java.ImageIO.createImageOutputStream(spark._jvm.java.io.File(str(tmp_path / f"{name}.jpg")))
        writer.setOutput(to)
        how = writer.getDefaultWriteParam()
        if progressive:
            how.setProgressiveMode(1)
        writer.write(None, java.IIOImage(plain, None, None), how)
        to.close()
    got = images.read_images(spark, str(tmp_path / "*.jpg")).collect()
    assert len(got) == 3
    for r in got:
        want = np.frombuffer(r.data, np.uint8).reshape(75, 109, r.channels)[..., ::-1].astype(int)
        mine = jpeg.decode_jpeg((tmp_path / r.image_id.rpartition("/")[2]).read_bytes()).astype(int)
        assert np.abs(mine - want).max() <= 3 and np.abs(mine - want).mean() < 0.5


def test_png_kinds():
    import struct
    import zlib

    rng = np.random.default_rng(5)

    def filtered(px, n, kinds):
        """Rows of bytes by the filters' own definition."""
        out = b""
        for y in range(len(px)):
            line = bytes([k := kinds[y % len(kinds)]])
            for i in range(px.shape[1]):
                a = int(px[y, i - n]) if i >= n else 0
                b = int(px[y - 1, i]) if y else 0
                c = int(px[y - 1, i - n]) if y and i >= n else 0
                e = a + b - c
                paeth = a if abs(e - a) <= abs(e - b) and abs(e - a) <= abs(e - c) else b if abs(e - b) <= abs(e - c) else c
                line += bytes([(int(px[y, i]) - (0, a, b, (a + b) // 2, paeth)[k]) % 256])
            out += line
        return out

    def png(width, height, depth, color, data, interlace=0, more=()):
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlace)) + b"".join(chunk(*m) for m in more) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")

    a = rng.integers(0, 255, (13, 9, 3), dtype=np.uint8)
    for kinds in ((0, 1, 2), (4, 3, 2, 1, 0), (3,)):
        assert (images.decode_png(png(9, 13, 8, 2, filtered(a.reshape(13, -1), 3, kinds))) == a).all()
    wide = np.repeat(a[..., None], 2, axis=3)
    assert (images.decode_png(png(9, 13, 16, 2, filtered(wide.reshape(13, -1), 6, (4,)))) == a).all()
    passes = b"".join(filtered(np.ascontiguousarray(a[y::dy, x::dx]).reshape(len(range(y, 13, dy)), -1), 3, (2, 4)) for x, y, dx, dy in images.PASSES if x < 9 and y < 13)
    assert (images.decode_png(png(9, 13, 8, 2, passes, 1)) == a).all()
    bits = rng.integers(0, 2, (4, 11), dtype=np.uint8)
    packed = np.packbits(bits, axis=1)
    assert (images.decode_png(png(11, 4, 1, 0, filtered(packed, 1, (0,))))[..., 1] == bits * 255).all()
    palette = rng.integers(0, 255, (2, 3), dtype=np.uint8)
    got = images.decode_png(png(11, 4, 1, 3, filtered(packed, 1, (0,)), more=((b"PLTE", palette.tobytes()), (b"tRNS", b"\xff\x00"))))
    assert (got == np.where(bits[..., None] == 0, palette[0], 255)).all()


def test_broken_images_are_told(spark):
    import pytest

    good = images.encode_png(np.zeros((3, 3, 3), np.uint8))
    for bad in (b"", b"nonsense", b"\xff\xd8\xff\xda\x00\x02", good[:40], b"BM", b"\x89PNG\r\n\x1a\n"):
        with pytest.raises(ValueError):
            images.decode(bad)
    df = books(spark, a=good, b=b"nonsense").withColumnRenamed("path", "image_id")
    assert {r.image_id for r in images.pixels(df).collect()} == {"a"}
    twice = df.unionAll(df).select("content")
    assert images.distinct_images(twice).count() == 2


def test_merged_sites(spark):
    rows = [(1, "2G", "2G_X_1", 50, 33.0, -7.0, 0), (2, "3G", "3G_X_2", 3011, 33.0001, -7.0, 0), (3, "2G", "2G_X_3", 700, 34.0, -7.0, 120), (4, "2G", "2G_Y", 700, 33.0, -7.0, 0)]
    cells = spark.createDataFrame([("w", *r) for r in rows], "workbook string, ord long, tech string, name string, freq long, lat double, lng double, azimuth int")
    assert {(r.site, r.merged) for r in workbooks.merged_sites(cells).collect()} == {("X_1", "X"), ("X_2", "X"), ("X_3", "X_1"), ("Y", "Y")}
    assert {(r.site, r.azimuth): (r.layers_2g, r.layers_3g) for r in workbooks.merged_layers(cells).collect()} == {("X", 0): (["900"], ["3011"]), ("X_1", 120): (["1800"], []), ("Y", 0): (["1800"], [])}


def test_spark_image_source(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(images.encode_png(np.full((3, 4, 3), 9, np.uint8)))
    r = images.read_images(spark, str(tmp_path)).first()
    assert (r.width, r.height, r.channels) == (4, 3, 3)


def test_stream(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet")
    schema = e.schema
    stream = spark.readStream.schema(schema).parquet(f"{data}/events*.parquet")
    shape = lambda d: rollup.windowed_verdicts(d.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("workbook"), F.lit("degradation").alias("kind"), F.when(F.col("event_type") == "error", "SSV NOK").otherwise("SSV OK").alias("verdict")), window="30 days")
    q = shape(stream).writeStream.format("memory").queryName("verdicts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("verdicts").agg(F.sum("analyses")).first()[0] == e.count()
    assert shape(e).agg(F.sum("analyses")).first()[0] == e.count()
