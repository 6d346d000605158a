"""Sites, cells, layers and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import geo, text


def layer(tech: Column, freq: Column) -> Column:
    """A cell's layer: the 2G band by its channel, the 3G channel itself."""
    return F.when(tech == "2G", F.when(freq < 500, "900").otherwise("1800")).otherwise(freq.cast("string"))


def layer_sets(cells: DataFrame) -> DataFrame:
    """(site, azimuth, layers_2g, layers_3g) of cells (name, tech, azimuth, freq), sets sorted."""
    own = cells.withColumn("site", text.site_base(F.col("name"))).withColumn("layer", layer(F.col("tech"), F.col("freq")))
    of = lambda t: F.sort_array(F.collect_set(F.when(F.col("tech") == t, F.col("layer"))))
    return own.groupBy("site", "azimuth").agg(of("2G").alias("layers_2g"), of("3G").alias("layers_3g"))


def sites_by_technology(cells: DataFrame) -> DataFrame:
    """One row: how many sites have 2G only, 3G only, and both."""
    per = cells.groupBy(text.site_base(F.col("name")).alias("site")).agg(F.bool_or(F.col("tech") == "2G").alias("g2"), F.bool_or(F.col("tech") == "3G").alias("g3"))
    return per.agg(F.count_if(F.col("g2") & ~F.col("g3")).alias("only_2g"), F.count_if(F.col("g3") & ~F.col("g2")).alias("only_3g"), F.count_if(F.col("g2") & F.col("g3")).alias("both"))


def near_sites(sites: DataFrame, base: str, reach: float) -> DataFrame:
    """(base, a, b, meters) of places of the same base name under reach meters apart, a < b.

    Places meet within squares of latitude and longitude that are reach wide, and those beside.
    """
    lat_side = reach / geo.EARTH_M * 57.29577951308232
    rows = sites.withColumn("gy", F.floor(F.col("lat") / lat_side))
    left = rows.select(base, F.col("ord").alias("a"), "lat", "lng", "gy")
    right = rows.select(base, F.col("ord").alias("b"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), F.explode(F.array(F.col("gy") - 1, F.col("gy"), F.col("gy") + 1)).alias("gy"))
    d = geo.haversine_m(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"))
    return left.join(right, [base, "gy"]).where("a < b").withColumn("meters", d).where(F.col("meters") < reach).select(base, "a", "b", "meters")


def unpivot_neighbours(wide: DataFrame) -> DataFrame:
    """(src, tgt, layer): one row per filled pair of each layer; duplicates stay."""
    of = lambda s: wide.select(F.col(f"source_{s}").alias("src"), F.col(f"target_{s}").alias("tgt"), F.lit(s.upper()).alias("layer"))
    return of("gsm").unionByName(of("dcs")).where("src is not null and tgt is not null")


def _fragments(key: Column) -> Column:
    """All that a key holds: its substrings, of which a key of k letters has k (k + 1) / 2."""
    size = F.length(key)
    starts = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substr(key, i, n)))))


def match_sites(wanted: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """wanted with site: the first known one (site, ord) whose key is the wanted key, holds it, or is held by it.

    Keys are short, so what a key holds are rows of its own that meet the other side's keys in a join by
    equality. Distinct keys are matched once.
    """
    keys = wanted.select(text.neighbour_key(F.col(name)).alias("key")).distinct()
    k = known.select("ord", "site", text.neighbour_key(F.col("site")).alias("known_key"))
    k = k.groupBy("known_key").agg(F.min(F.struct("ord", "site")).alias("first"))
    holds = keys.select("key", F.explode(_fragments(F.col("key"))).alias("known_key")).join(k, "known_key").select("key", "first")
    held = k.select("first", F.explode(_fragments(F.col("known_key"))).alias("key")).join(keys, "key").select("key", "first")
    found = holds.unionByName(held).groupBy("key").agg(F.min("first").alias("first")).select("key", "first.site")
    return wanted.withColumn("key", text.neighbour_key(F.col(name))).join(found, "key", "left").drop("key")


def cell_sites(wanted: DataFrame, cells: DataFrame, name: str = "cell") -> DataFrame:
    """wanted with site and azimuth of the cell it names, by cells (ord, name, cell, azimuth); null where no cell has the name.

    Of several sites with such a cell, the one that the cell's name without its last letter points to
    counts, else the first.
    """
    own = cells.select("ord", text.site_base(F.col("name")).alias("site"), "azimuth", text.neighbour_identifier(F.col("cell")).alias("id"))
    order = own.groupBy("site").agg(F.min("ord").alias("site_ord"))
    per = own.join(order, "site").groupBy("id", "site").agg(F.min("site_ord").alias("site_ord"), F.min_by("azimuth", "ord").alias("azimuth"))
    ids = wanted.select(text.neighbour_identifier(F.col(name)).alias("id")).where("id <> ''").distinct()
    several = per.join(ids, "id", "left_semi").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.when(F.length("id") > 1, F.expr("substr(id, 1, length(id) - 1)")).otherwise(F.col("id")).alias("parent"))
    pointed = match_sites(several, order.select(F.col("site_ord").alias("ord"), "site"), "parent").select("id", F.col("site").alias("pointed"))
    both = per.join(ids, "id", "left_semi").join(pointed, "id", "left")
    first = F.min(F.struct((F.coalesce(F.col("site") != F.col("pointed"), F.lit(True))).alias("other"), "site_ord", "site", "azimuth")).alias("at")
    found = both.groupBy("id").agg(first).select("id", "at.site", "at.azimuth")
    return wanted.withColumn("id", text.neighbour_identifier(F.col(name))).join(found, "id", "left").drop("id")


def neighbour_targets(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, site, azimuth): distinct sectors that a cell's neighbours stand on, its own left out."""
    own = cell_sites(pairs.select("src").distinct(), cells, "src").where("site is not null").withColumnsRenamed({"site": "own_site", "azimuth": "own_azimuth"})
    to = cell_sites(pairs.select("tgt").distinct(), cells, "tgt").where("site is not null")
    return pairs.join(own, "src").join(to, "tgt").where("site <> own_site or azimuth <> own_azimuth").select("src", "site", "azimuth").distinct()


def highlighted(cells: DataFrame, pairs: DataFrame, source: str) -> DataFrame:
    """The cells to highlight for a clicked one: itself, and all on its neighbours' sectors."""
    own = text.neighbour_identifier(F.lit(source))
    targets = neighbour_targets(cells, pairs.where(text.neighbour_identifier(F.col("src")) == own)).select("site", "azimuth").distinct()
    rows = cells.withColumn("site", text.site_base(F.col("name")))
    return rows.join(targets, ["site", "azimuth"], "left_semi").unionByName(rows.where(text.neighbour_identifier(F.col("cell")) == own)).distinct()


def slice_cells(cells: DataFrame) -> DataFrame:
    """(site, azimuth, tech, layer, cell): the first cell of each layer of a sector."""
    own = cells.withColumn("site", text.site_base(F.col("name"))).withColumn("layer", layer(F.col("tech"), F.col("freq")))
    return own.groupBy("site", "azimuth", "tech", "layer").agg(F.min_by("cell", "ord").alias("cell"))


def valid_cells(cells: DataFrame) -> DataFrame:
    """cells with lat and lng as numbers, north and west; rows whose place is no place go, and so do rows without one.

    (An origin at 0, 0 for missing places, as a viewer might take it, is not a place of a cell.)
    """
    lat, lng = geo.valid_position(F.col("lat"), F.col("lng"))
    return cells.withColumn("_lat", lat).withColumn("_lng", lng).where("_lat is not null and _lng is not null").drop("lat", "lng").withColumnsRenamed({"_lat": "lat", "_lng": "lng"})


def sector_polygons(sectors: DataFrame, meters: float = 150.0) -> DataFrame:
    """sectors (site, azimuth, lat, lng, layers array) with one ring for each layer, which share the radius equally."""
    n = F.size("layers")
    rings = sectors.select("*", F.posexplode("layers").alias("k", "layer")).withColumn("inner", meters * F.col("k") / n).withColumn("outer", meters * (F.col("k") + 1) / n)
    bearings = F.sequence(F.lit(0), F.lit(12))

    def arc(radius: Column) -> Column:
        def at(i: Column) -> Column:
            la, lo = geo.destination(F.col("lat"), F.col("lng"), F.col("azimuth") - 30 + i * 5, radius)
            return F.struct(la.alias("lat"), lo.alias("lng"))

        return F.transform(bearings, at)

    return rings.withColumn("ring", F.concat(arc(F.col("inner")), F.reverse(arc(F.col("outer"))), F.slice(arc(F.col("inner")), 1, 1)))
