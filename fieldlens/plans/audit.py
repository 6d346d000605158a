"""Site audits: a workbook's first sheet has twelve panoramas, a place, and sectors before and after an optimisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import geo, text
from fieldlens.operators import captions, reports
from fieldlens.storage import stored

#: What the sheet says, and the sectors that stand in where it names none.
ANGLES = [f"{a} DEGRÉS" for a in range(0, 360, 30)]
PLACE, PHOTOS = "Coordonnées GPS Lat:", "PHOTOS AZIMUT"
SECTIONS = (("Photos Tilt Elec", ("APPENDIX 4", "TILT ELEC")), ("Photos Tilt Méc", ("APPENDIX 3", "TILT MEC", "TILT MÉC")), ("Antennas Photos", ("APPENDIX 2", "ANTENNAS PHOTOS")))
STAND_IN = (("Secteur 1", 50.0), ("Secteur 2", 130.0), ("Secteur 3", 220.0))
SECTOR_COLORS = ("ff0000ff", "ff00ff00", "ffff0000")


def _texts(cells: DataFrame) -> DataFrame:
    """Text cells of the first sheet with line, the row counted from 1."""
    return cells.where("sheet_no = 0 and is_str").withColumn("line", F.col("row") + 1)


def _number(v: Column) -> Column:
    """The number that a text begins with."""
    return F.regexp_extract(v, r"^\s*([-+]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")


def _starts(cells: DataFrame) -> DataFrame:
    """(workbook, phase, start): the first two lines that name a place head the sectors before and after."""
    own = _texts(cells).where(F.col("value").contains(PLACE))
    k = F.row_number().over(Window.partitionBy("workbook").orderBy("line", "ord"))
    return own.withColumn("k", k).where("k <= 2").select("workbook", F.when(F.col("k") == 1, "avant").otherwise("apres").alias("phase"), F.col("line").alias("start"))


def sector_config(cells: DataFrame) -> DataFrame:
    """(workbook, phase, sector_no, name, azimuth): sectors listed within 20 lines below a phase's start that have an azimuth.

    The azimuth stands in the column of the last header "Azimut" within 15 lines, else in column E.
    """
    heads = _starts(cells)
    own = _texts(cells)
    within = lambda a, b: (F.col("line") >= F.col("start") + a) & (F.col("line") < F.col("start") + b)
    columns = heads.join(own.where(F.col("value").contains("Azimut")), "workbook").where(within(0, 15)).groupBy("workbook", "phase").agg(F.max_by("col", F.struct("line", "ord")).alias("azimuth_col"))
    named = heads.join(own.where(F.col("value").startswith("Secteur ")), "workbook").where(within(1, 20)).select("workbook", "phase", "row", "ord", F.col("value").alias("name"))
    named = named.join(columns, ["workbook", "phase"], "left").withColumn("col", F.coalesce("azimuth_col", F.lit(4)))
    values = cells.where("sheet_no = 0").select("workbook", "row", "col", _number(F.col("value")).alias("azimuth"))
    rows = named.join(values, ["workbook", "row", "col"]).where("azimuth is not null")
    return rows.withColumn("sector_no", F.row_number().over(Window.partitionBy("workbook", "phase").orderBy("row", "ord"))).select("workbook", "phase", "sector_no", "name", "azimuth")


def site_place(cells: DataFrame) -> DataFrame:
    """(workbook, lat, lng) by the last line with a place that is one; a value stands in the next filled column by its letters."""
    lines = _texts(cells).where(F.col("value").contains(PLACE)).select("workbook", "row").distinct()
    letters = F.regexp_extract(text.cell_ref(F.lit(0), F.col("col")), "([A-Z]+)", 1)
    row = cells.where("sheet_no = 0").join(lines, ["workbook", "row"]).withColumn("letters", letters)
    after = row.withColumn("next", F.lead("value").over(Window.partitionBy("workbook", "row").orderBy("letters")))
    pick = lambda label: F.max_by("next", F.when(F.col("is_str") & F.col("value").contains(label) & F.col("next").isNotNull(), F.col("letters")))
    per = after.groupBy("workbook", "row").agg(pick("Lat:").alias("a"), pick("Long:").alias("o"))
    lat, lng = geo.valid_position(_number(F.col("a")).cast("string"), _number(F.col("o")).cast("string"))
    good = per.select("workbook", "row", lat.alias("lat"), lng.alias("lng")).where("lat is not null and lng is not null")
    return good.groupBy("workbook").agg(F.max_by(F.struct("lat", "lng"), "row").alias("p")).select("workbook", "p.lat", "p.lng")


def photo_lines(cells: DataFrame) -> DataFrame:
    """(workbook, line, phase, section): the lines below the photos' heading that a first sector heads."""
    own = _texts(cells).withColumn("upper", F.upper("value"))
    top = own.where(F.col("upper").contains(PHOTOS)).groupBy("workbook").agg(F.max("line").alias("top"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "upper"))), lambda s: s["upper"]), " ")
    lines = own.join(top, "workbook").where("line > top").groupBy("workbook", "line").agg(listed.alias("all"))
    said = F.col("all")
    phase = F.when(said.contains("AVANT OPTIMISATION"), "avant").when(said.contains("APRES OPTIMISATION"), "apres")
    section = F.lit(None).cast("string")
    for name, marks in reversed(SECTIONS):
        for m in marks:
            section = F.when(said.contains(m), name).otherwise(section)
    down = Window.partitionBy("workbook").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("head", phase).withColumn("own_section", F.when(F.col("head").isNull(), section))
    rows = rows.withColumn("phase", F.last("head", ignorenulls=True).over(down)).withColumn("section", F.coalesce(F.last("own_section", ignorenulls=True).over(down), F.lit("Photos Azimut")))
    return rows.where(F.col("head").isNull() & said.contains("SECTEUR 1") & F.col("phase").isNotNull()).select("workbook", "line", "phase", "section")


def _labels(cells: DataFrame) -> DataFrame:
    """(workbook, line, label_col, label, angle, section): degrees, and the sectors on photo lines after the optimisation."""
    own = _texts(cells)
    clean = F.regexp_replace(F.upper("value"), r"\s+", " ")
    degrees = own.withColumn("clean", clean).where(F.col("clean").isin(ANGLES)).select("workbook", "line", F.col("col").alias("label_col"), F.col("value").alias("label"), F.regexp_extract("clean", "([0-9]+)", 1).cast("int").alias("angle"), F.lit("").alias("section"))
    after = photo_lines(cells).where("phase = 'apres'").select("workbook", "line", "section")
    sectors = own.where(F.col("value").startswith("Secteur")).join(after, ["workbook", "line"]).select("workbook", "line", F.col("col").alias("label_col"), F.col("value").alias("label"), F.lit(None).cast("int").alias("angle"), "section")
    return degrees.unionByName(sectors)


def _placed_images(labels: DataFrame, anchors: DataFrame) -> DataFrame:
    """(workbook, line, col, anchor_no, media): images by the line of labels above them: one row below, or two below sectors."""
    images = anchors.where("sheet_no = 0").select("workbook", "anchor_no", "col", "media", F.col("row").alias("at"))
    near = labels.select("workbook", F.col("line").alias("at"), F.col("line").alias("near")).distinct()
    far = labels.where("angle is null").select("workbook", (F.col("line") + 1).alias("at"), F.col("line").alias("far")).distinct()
    rows = images.join(near, ["workbook", "at"], "left").join(far, ["workbook", "at"], "left")
    return rows.withColumn("line", F.coalesce("near", "far")).where("line is not null").select("workbook", "line", "col", "anchor_no", "media")


def _is_degrees(labels: DataFrame) -> DataFrame:
    """(workbook, line, degrees): whether a line's first label is an angle."""
    return labels.groupBy("workbook", "line").agg(F.min_by(F.col("angle").isNotNull(), "label_col").alias("degrees"))


def panoramas(cells: DataFrame, anchors: DataFrame) -> DataFrame:
    """(workbook, angle, media): on lines of degrees, the i-th label and the i-th image from the left, by angle."""
    labels = _labels(cells)
    lines = _is_degrees(labels).where("degrees").select("workbook", "line")
    images = _placed_images(labels, anchors).join(lines, ["workbook", "line"])
    own = labels.join(lines, ["workbook", "line"])
    both = captions.positional_zip(own, images, ["workbook", "line"], [F.col("label_col")], [F.col("col"), F.col("anchor_no")])
    return both.where("angle is not null").select("workbook", "angle", "media")


def sector_images(cells: DataFrame, anchors: DataFrame) -> DataFrame:
    """(workbook, sector_no, name, image_no, media, section): images below the label whose columns hold them, for the sectors
    after the optimisation; of sectors of one name the first counts.
    """
    labels = _labels(cells)
    lines = _is_degrees(labels).where("not degrees").select("workbook", "line")
    images = _placed_images(labels, anchors).join(lines, ["workbook", "line"])
    own = labels.join(lines, ["workbook", "line"])
    named = captions.label_intervals(images, own.select("workbook", "line", "label_col", "label"), ["workbook", "line"]).where("label is not null")
    sections = own.groupBy("workbook", "line").agg(F.max("section").alias("section"))
    config = sector_config(cells).where("phase = 'apres'").groupBy("workbook", F.col("name").alias("label")).agg(F.min("sector_no").alias("sector_no"))
    rows = named.join(sections, ["workbook", "line"]).join(config, ["workbook", "label"])
    image_no = F.row_number().over(Window.partitionBy("workbook", "sector_no").orderBy("line", "col", "anchor_no"))
    return rows.withColumn("image_no", image_no).select("workbook", "sector_no", F.col("label").alias("name"), "image_no", "media", "section")


def in_view(sectors: DataFrame, views: DataFrame, key: list[str], reach: float = 15.0) -> DataFrame:
    """views (key, angle) with the first sector (key, sector_no, name, azimuth) that looks within reach degrees of the angle."""
    listed = sectors.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("sector_no", "name", "azimuth"))).alias("_s"))
    near = F.filter("_s", lambda s: geo.separation(s["azimuth"], F.col("angle")) <= reach)
    return views.join(listed, key, "left").withColumn("sector", F.try_element_at(near, F.lit(1))["name"]).drop("_s")


def _point(lat: Column, lng: Column) -> Column:
    return F.concat(lng.cast("string"), F.lit(","), lat.cast("string"), F.lit(",0"))


def _placemark(name: Column, text_: Column, shape: Column) -> Column:
    return F.concat(F.lit("<Placemark><name>"), name, F.lit("</name><description><![CDATA["), text_, F.lit("]]></description>"), shape, F.lit("</Placemark>"))


def audit_kml(places: DataFrame, sectors: DataFrame, views: DataFrame, phase: str = "apres") -> DataFrame:
    """(workbook, kml): a document with a site's place (workbook, lat, lng), a wedge of 80 m for each sector of the phase
    (workbook, phase, sector_no, name, azimuth, picture) and a mark 30 m out for each panorama (workbook, angle).

    Sites without sectors get three that stand in. picture may be null.
    """
    places = stored(places, "places")
    own = stored(sectors.where(F.col("phase") == phase).select("workbook", "sector_no", "name", "azimuth", "picture"), "sectors")
    kinds = F.array(*[F.struct(F.lit(k + 1).alias("sector_no"), F.lit(n).alias("name"), F.lit(a).alias("azimuth")) for k, (n, a) in enumerate(STAND_IN)])
    bare = places.join(own.select("workbook").distinct(), "workbook", "left_anti").select("workbook", F.explode(kinds).alias("s")).select("workbook", "s.*", F.lit(None).cast("string").alias("picture"))
    rows = own.unionByName(bare).join(places, "workbook")
    lat, lng = F.col("lat"), F.col("lng")
    ring = F.array_join(F.transform(geo.wedge(lat, lng, F.col("azimuth"), 80.0), lambda p: _point(p["lat"], p["lng"])), " ")
    tone = F.element_at(F.array(*[F.lit(c) for c in SECTOR_COLORS]), F.pmod(F.col("sector_no") - 1, F.lit(3)).cast("int") + 1)
    style = F.concat(F.lit("<Style><LineStyle><color>"), tone, F.lit("</color><width>2</width></LineStyle><PolyStyle><color>40"), F.substr(tone, F.lit(3)), F.lit("</color></PolyStyle></Style>"))
    azimuth = F.format_string("%s°", F.col("azimuth").cast("string"))
    picture = F.coalesce(F.concat(F.lit('<br/><img src="images/'), F.col("picture"), F.lit('" width="350"/>')), F.lit(""))
    wedge = _placemark(F.concat("name", F.lit(" ("), azimuth, F.lit(")")), F.concat(F.lit("<h3>"), "name", F.lit("</h3><p>Azimuth: "), azimuth, F.lit(" | Beamwidth: 60°</p>"), picture), F.concat(style, F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>"), ring, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon>")))
    listed = lambda c, order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, c.alias("t")))), lambda s: s["t"]), "")
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sector_no", F.concat("name", F.lit(": "), azimuth).alias("t")))), lambda s: s["t"]), " | ")
    wedges = rows.groupBy("workbook").agg(listed(wedge, "sector_no").alias("wedges"), names.alias("names"))
    mlat, mlng = geo.destination(lat, lng, F.col("angle").cast("double"), 30.0)
    angle = F.format_string("%d°", "angle")
    mark = _placemark(angle, F.concat(F.lit("<h3>Panorama "), angle, F.lit('</h3><img src="images/'), F.format_string("pano_%d.jpg", "angle"), F.lit('" width="400"/>')), F.concat(F.lit("<Point><coordinates>"), _point(mlat, mlng), F.lit("</coordinates></Point>")))
    marks = views.join(places, "workbook").groupBy("workbook").agg(listed(mark, "angle").alias("marks"))
    full = places.join(wedges, "workbook", "left").join(marks, "workbook", "left")
    site = F.regexp_replace(F.regexp_extract("workbook", "([^/]+)$", 1), r"\.xlsx$", "")
    safe = F.replace(F.replace(F.replace(site, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    about = F.concat(F.lit("<h2>360° Telecom Site Audit</h2><p>CGPS: "), F.format_string("%.6f, %.6f", "lat", "lng"), F.lit("</p><p>"), F.coalesce("names", F.lit("")), F.lit("</p>"))
    folder = lambda name, c: F.concat(F.lit(f"<Folder><name>{name}</name>"), F.coalesce(c, F.lit("")), F.lit("</Folder>"))
    own_mark = _placemark(safe, about, F.concat(F.lit("<Point><coordinates>"), _point(lat, lng), F.lit("</coordinates></Point>")))
    doc = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>'), safe, F.lit(" - Site Audit</name>"), folder("Site", own_mark), folder("Sectors", F.col("wedges")), folder("360° Panoramic Photos", F.col("marks")), F.lit("</Document></kml>"))
    return full.select("workbook", doc.alias("kml"))


def audit_kmz(cells: DataFrame, anchors: DataFrame, media: DataFrame, phase: str = "apres") -> DataFrame:
    """(workbook, kmz): the audit's document zipped with its panoramas and the first picture of each sector."""
    views = stored(panoramas(cells, anchors), "panoramas")
    pictures = stored(sector_images(cells, anchors), "pictures").where("image_no = 1").select("workbook", "sector_no", "media", F.format_string("sector_%d.jpg", "sector_no").alias("picture"))
    own = sector_config(cells).join(pictures.select("workbook", "sector_no", "picture").withColumn("phase", F.lit("apres")), ["workbook", "phase", "sector_no"], "left")
    kml = audit_kml(site_place(cells), own, views, phase)
    named = views.select("workbook", "media", F.format_string("pano_%d.jpg", "angle").alias("name")).unionByName(pictures.select("workbook", "media", F.col("picture").alias("name")))
    files = named.join(media.select("workbook", "media", "content"), ["workbook", "media"]).groupBy("workbook").agg(F.sort_array(F.collect_list(F.struct("name", "content"))).alias("images"))
    return reports.kmz_files(kml.join(files, "workbook", "left"), "workbook")
