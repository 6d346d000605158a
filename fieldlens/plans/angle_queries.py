"""Registered queries on angle samples, from the events table: sectors are event types, images are users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.functions import geo
from fieldlens.operators import angles

from .inputs import table


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    sector = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", 2)
    e = table(spark, sf_dir, "events").withColumn("sector", sector).where("sector is not null")
    return e.select(F.col("user_id").alias("image"), "sector", F.pmod(F.col("value") * 7, F.lit(360.0)).alias("angle"))


def circular_mean_by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return angles.sector_directions(points(spark, sf_dir)).select("image", "sector", "n", F.round("direction", 4).alias("direction"))


def misassigned_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return angles.misassigned_ratio(points(spark, sf_dir)).select("image", F.round("ratio", 6).alias("ratio"))


def mixed_bin_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return angles.mixed_bin_ratio(points(spark, sf_dir)).select("image", F.round("ratio", 6).alias("ratio"))


def zone_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return angles.zone_matrix(points(spark, sf_dir))


def intrusion_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return angles.intrusion_ratio(points(spark, sf_dir)).select("image", "sector", F.round("ratio", 6).alias("ratio"))


def cross_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = angles.cross_verdict(points(spark, sf_dir))
    return v.select("image", "points", *[F.round(c, 6).alias(c) for c in ("misassigned", "mixed", "intrusion")], F.round("confidence", 4).alias("confidence"), "cross", "verdict")


def least_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return angles.least_separation(angles.sector_directions(points(spark, sf_dir))).select("image", F.round("least", 4).alias("least"))


def late_ho_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The late-handover rule on a matrix made for it: sector 0 of every third user serves in sector 1's zone."""
    return angles.late_handover(*_cases(spark, sf_dir, "late"))


def pair_ho_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix, directions = _cases(spark, sf_dir, "pair")
    return angles.pair_late_handover(matrix, directions, _calm(matrix), _own_intrusion(matrix))


def minor_pair_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix, directions = _cases(spark, sf_dir, "minor")
    return angles.minor_pair_late_handover(matrix, directions, _calm(matrix), _own_intrusion(matrix))


def _cases(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Zone matrices of 3 x 3 by customer, around the rule's own thresholds, and directions 120 degrees and some apart."""
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(k.alias("image"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("cell"))
    s, t = F.floor(F.col("cell") / 3).cast("int"), (F.col("cell") % 3).cast("int")
    i = F.col("image")
    if kind == "late":
        n = F.when((s == 0) & (t == 0), i % 40).when((s == 0) & (t == 1), 60 + i % 90).when(s == 0, i % 31).when(s == t, 300 + i % 200).otherwise(i % 60)
    elif kind == "pair":
        n = F.when((s == 0) & (t == 0), 380 + i % 60).when((s == 0) & (t == 1), 80 + i % 45).when(s == 0, i % 26).when(s == t, 700 + i % 100).otherwise(i % 40)
    else:
        n = F.when((s == 0) & (t == 0), 900 + i % 90).when((s == 0) & (t == 1), 10 + i % 45).when(s == 0, i % 3).when(s == t, 800 + i % 50).otherwise(i % 25)
    matrix = base.select("image", s.alias("source"), t.alias("zone"), n.cast("long").alias("n")).where("n > 0")
    directions = table(spark, sf_dir, "customer").select(k.alias("image"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("sector"))
    return matrix, directions.withColumn("direction", F.pmod(F.col("sector") * 120 + F.col("image") % 90 * F.col("sector"), F.lit(360)).cast("double"))


def _calm(matrix: DataFrame) -> DataFrame:
    return matrix.select("image").distinct().select("image", F.lit(0.01).alias("misassigned"), F.lit(0.02).alias("mixed"))


def _own_intrusion(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("image", F.col("source").alias("sector")).agg((F.sum(F.when(F.col("source") != F.col("zone"), F.col("n")).otherwise(0)) / F.sum("n")).alias("ratio"))


def angular_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors' angles of a user and weekday, in islands parted by gaps over 40 degrees; the largest of each."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    e = e.select(F.col("user_id").alias("image"), (F.col("event_id") % 3).alias("part"), F.pmod(F.col("value") * 7, F.lit(360.0)).alias("angle"))
    return angles.largest_island(e, ["image", "part"]).select("image", "part", "island", "n", F.round("span", 4).alias("span"))


def error_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("bad", F.col("event_type").isin("error", "click", "view"))
    return angles.degraded_runs(e, ["user_id"], ["ts", "event_id"], "bad", least=4).select("user_id", "run", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "n")


def azimuth_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bonus = geo.azimuth_bonus(F.pmod(F.col("value") * 7, F.lit(360.0)), (F.col("event_id") * 10 % 360).cast("double"))
    return e.select("event_id", F.round(bonus, 4).alias("bonus"))


POINTS = """
e AS (
  SELECT user_id AS image, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS sector, fmod(value * 7, 360.0) AS angle
  FROM events WHERE event_type IN ('click', 'view', 'purchase')
), d AS (
  SELECT image, sector, count(*) AS n, fmod(degrees(atan2(sum(sin(radians(angle))), sum(cos(radians(angle))))) + 360, 360) AS direction
  FROM e GROUP BY image, sector
)"""
WEDGES = (
    POINTS
    + """, w0 AS (
  SELECT image, sector, direction, coalesce(lead(direction) OVER o, first_value(direction) OVER o) AS nxt FROM d WINDOW o AS (PARTITION BY image ORDER BY direction, sector)
), w1 AS (
  SELECT image, sector, direction, fmod((direction + CASE WHEN nxt < direction THEN nxt + 360 ELSE nxt END) / 2, 360) AS stop FROM w0
), w AS (
  SELECT image, sector, stop, coalesce(lag(stop) OVER (PARTITION BY image ORDER BY direction, sector), last_value(stop) OVER (PARTITION BY image ORDER BY direction, sector ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS start FROM w1
), z AS (
  SELECT e.image, e.sector, e.angle, coalesce((SELECT min(w.sector) FROM w WHERE w.image = e.image AND (CASE WHEN w.start < w.stop THEN e.angle >= w.start AND e.angle < w.stop ELSE e.angle >= w.start OR e.angle < w.stop END)), 0) AS zone FROM e
)"""
)
SEP = "least(fmod(abs({a} - {b}), 360), 360 - fmod(abs({a} - {b}), 360))"
MIS = f"""mis AS (
  SELECT image, avg(CASE WHEN other + 12 < own THEN 1.0 ELSE 0.0 END) AS ratio FROM (
    SELECT e.image, e.sector, e.angle, min(CASE WHEN d.sector = e.sector THEN {SEP.format(a="d.direction", b="e.angle")} END) AS own, min(CASE WHEN d.sector <> e.sector THEN {SEP.format(a="d.direction", b="e.angle")} END) AS other
    FROM (SELECT *, row_number() OVER () AS rid FROM e) e JOIN d USING (image) GROUP BY e.image, e.sector, e.angle, e.rid
  ) GROUP BY image
)"""
MIX = """mix AS (
  SELECT image, CAST(sum(CASE WHEN sectors >= 2 AND most / CAST(total AS DOUBLE) < 0.85 THEN total ELSE 0 END) AS DOUBLE) / sum(total) AS ratio FROM (
    SELECT image, bin, sum(n) AS total, max(n) AS most, count(*) AS sectors FROM (
      SELECT image, CAST(floor(angle / 10) AS BIGINT) % 36 AS bin, sector, count(*) AS n FROM e GROUP BY ALL
    ) GROUP BY image, bin
  ) GROUP BY image
)"""
INTR = "intr AS (SELECT image, sector, avg(CASE WHEN zone <> sector THEN 1.0 ELSE 0.0 END) AS ratio FROM z GROUP BY image, sector)"
LEAST = f"lst AS (SELECT a.image, coalesce(min(CASE WHEN a.sector < b.sector THEN {SEP.format(a='a.direction', b='b.direction')} END), 0.0) AS least FROM d a JOIN d b USING (image) GROUP BY a.image)"

_CELLS = "SELECT c_custkey AS image, CAST(c // 3 AS INT) AS source, CAST(c % 3 AS INT) AS zone, {n} AS n FROM customer, (SELECT unnest(range(9)) AS c)"
_N = {
    "late": "CASE WHEN c = 0 THEN c_custkey % 40 WHEN c = 1 THEN 60 + c_custkey % 90 WHEN c = 2 THEN c_custkey % 31 WHEN c IN (4, 8) THEN 300 + c_custkey % 200 ELSE c_custkey % 60 END",
    "pair": "CASE WHEN c = 0 THEN 380 + c_custkey % 60 WHEN c = 1 THEN 80 + c_custkey % 45 WHEN c = 2 THEN c_custkey % 26 WHEN c IN (4, 8) THEN 700 + c_custkey % 100 ELSE c_custkey % 40 END",
    "minor": "CASE WHEN c = 0 THEN 900 + c_custkey % 90 WHEN c = 1 THEN 10 + c_custkey % 45 WHEN c = 2 THEN c_custkey % 3 WHEN c IN (4, 8) THEN 800 + c_custkey % 50 ELSE c_custkey % 25 END",
}


def _rule_sql(kind: str, where: str, score: str, name: str, both: bool) -> str:
    sql = f"""
WITH m AS (SELECT * FROM ({_CELLS.format(n=_N[kind])}) WHERE n > 0),
dirs AS (SELECT c_custkey AS image, s AS sector, CAST(fmod(s * 120 + (c_custkey % 90) * s, 360) AS DOUBLE) AS direction FROM customer, (SELECT unnest(range(3)) AS s)),
r AS (SELECT image, source AS s, CAST(sum(n) AS DOUBLE) AS total, CAST(sum(CASE WHEN zone = source THEN n ELSE 0 END) AS DOUBLE) AS own FROM m GROUP BY image, source),
zt AS (SELECT image, zone AS t, CAST(sum(n) AS DOUBLE) AS zone_total FROM m GROUP BY image, zone),
p AS (
  SELECT a.image, a.s, b.s AS t, a.total, max(a.total) OVER (PARTITION BY a.image) AS most, coalesce(m.n, 0) AS moved, a.own / a.total AS own_share, coalesce(m.n, 0) / a.total AS share,
    b.own / b.total AS t_own_share, (coalesce(zt.zone_total, 0) - coalesce(m.n, 0) - b.own) / zt.zone_total AS t_other, (a.total - a.own - coalesce(m.n, 0)) / a.total AS s_other, (a.total - a.own) / a.total AS intruding,
    {SEP.format(a="da.direction", b="db.direction")} AS apart
  FROM r a JOIN r b ON a.image = b.image AND a.s <> b.s JOIN dirs da ON da.image = a.image AND da.sector = a.s JOIN dirs db ON db.image = b.image AND db.sector = b.s
  LEFT JOIN m ON m.image = a.image AND m.source = a.s AND m.zone = b.s LEFT JOIN zt ON zt.image = a.image AND zt.t = b.s
), q AS (SELECT *, row_number() OVER (PARTITION BY image, s ORDER BY moved DESC, t) AS rank FROM p),
best AS (SELECT image, s, t FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY {score} DESC, s, t) AS k FROM q WHERE {where}) WHERE k = 1)
SELECT image, '{name}' AS kind, CAST(s AS INT) AS source, CAST(t AS INT) AS target FROM best"""
    return sql + (f" UNION ALL SELECT image, '{name}' AS kind, CAST(t AS INT) AS source, CAST(s AS INT) AS target FROM best" if both else "")


SQL = {
    "circular_mean_by_sector": f"WITH {POINTS} SELECT image, sector, n, round(direction, 4) AS direction FROM d",
    "misassigned_ratio": f"WITH {POINTS}, {MIS} SELECT image, round(ratio, 6) AS ratio FROM mis",
    "mixed_bin_ratio": f"WITH {POINTS}, {MIX} SELECT image, round(ratio, 6) AS ratio FROM mix",
    "zone_matrix": f"WITH {WEDGES} SELECT image, sector AS source, zone, count(*) AS n FROM z GROUP BY ALL",
    "intrusion_ratio": f"WITH {WEDGES}, {INTR} SELECT image, sector, round(ratio, 6) AS ratio FROM intr",
    "least_separation": f"WITH {POINTS}, {LEAST} SELECT image, round(least, 4) AS least FROM lst",
    "cross_verdict": f"""WITH {WEDGES}, {MIS}, {MIX}, {INTR}, {LEAST},
t AS (SELECT image, count(*) AS points FROM e GROUP BY image),
a AS (SELECT t.image, points, mis.ratio AS misassigned, mix.ratio AS mixed, i.intrusion, least FROM t JOIN mis USING (image) JOIN mix USING (image) JOIN (SELECT image, max(ratio) AS intrusion FROM intr GROUP BY image) i USING (image) JOIN lst USING (image))
SELECT image, points, round(misassigned, 6) AS misassigned, round(mixed, 6) AS mixed, round(intrusion, 6) AS intrusion,
  round(greatest(0.05, least(0.99, 0.35 + 0.35 * least(points / 1800.0, 1.0) + 0.20 * least(least / 110, 1.0) + 0.10 * greatest(0.0, 1 - 0.25 * greatest(misassigned / 0.18, mixed / 0.20, intrusion / 0.18)))), 4) AS confidence,
  misassigned >= 0.18 OR mixed >= 0.20 OR intrusion >= 0.18 AS cross,
  CASE WHEN misassigned >= 0.18 OR mixed >= 0.20 OR intrusion >= 0.18 THEN 'Cross detected' ELSE 'No cross detected' END AS verdict FROM a""",
    "late_ho_rules": _rule_sql("late", "own_share <= 0.12 AND total <= most * 0.85 AND share >= 0.25 AND t_own_share >= 0.80 AND apart >= 60 AND t_other <= 0.35", "share * 0.45 + t_own_share * 0.30 + least(apart / 180, 1.0) * 0.15 + (1 - t_other) * 0.10", "late_ho", False),
    "pair_ho_rules": _rule_sql("pair", "rank = 1 AND own_share >= 0.75 AND share >= 0.15 AND intruding BETWEEN 0.18 AND 0.24 AND s_other <= 0.05 AND t_own_share >= 0.90 AND t_other <= 0.08 AND apart >= 90", "share * 0.45 + own_share * 0.20 + t_own_share * 0.20 + (1 - t_other) * 0.10 + least(apart / 180, 1.0) * 0.05", "late_ho_pair", True),
    "minor_pair_rules": _rule_sql("minor", "rank = 1 AND share BETWEEN 0.015 AND 0.05 AND intruding <= 0.05 AND t_own_share >= 0.95 AND apart >= 90", "share * 0.45 + t_own_share * 0.35 + least(apart / 180, 1.0) * 0.20", "late_ho_minor_pair", True),
    "angular_islands": """WITH e AS (SELECT user_id AS image, event_id % 3 AS part, fmod(value * 7, 360.0) AS angle FROM events WHERE event_type = 'error'),
f AS (SELECT *, coalesce(CASE WHEN angle - lag(angle) OVER (PARTITION BY image, part ORDER BY angle) > 40 THEN 1 ELSE 0 END, 0) AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY image, part ORDER BY angle RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f),
h AS (SELECT image, part, island, count(*) AS n, min(angle) AS lo, max(angle) AS hi FROM g GROUP BY ALL),
i AS (SELECT *, max(island) OVER v > 0 AND min(lo) OVER v + 360 - max(hi) OVER v <= 40 AND island = max(island) OVER v AS merge FROM h WINDOW v AS (PARTITION BY image, part)),
j AS (SELECT image, part, CASE WHEN merge THEN 0 ELSE island END AS island, sum(n) AS n, max(CASE WHEN merge THEN hi - 360 ELSE hi END) - min(CASE WHEN merge THEN lo - 360 ELSE lo END) AS span FROM i GROUP BY ALL)
SELECT image, part, CAST(island AS BIGINT) AS island, CAST(n AS BIGINT) AS n, round(span, 4) AS span FROM (SELECT *, row_number() OVER (PARTITION BY image, part ORDER BY n DESC, span DESC, island) AS k FROM j) WHERE k = 1""",
    "error_runs": """WITH a AS (SELECT user_id, event_type IN ('error', 'click', 'view') AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
b AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS grp FROM a WHERE bad),
c AS (SELECT user_id, grp, min(pos) AS start, max(pos) AS stop, count(*) AS n FROM b GROUP BY user_id, grp HAVING count(*) >= 4)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start) AS INT) AS run, start, stop, n FROM c""",
    "azimuth_bonus": f"""SELECT event_id, round(CASE WHEN s > 65 THEN 0.0 ELSE 40.0 * (65.0 - s) / 65.0 END, 4) AS bonus FROM (
SELECT event_id, {SEP.format(a="c", b="z")} AS s FROM (SELECT event_id, fmod(450.0 - fmod(value * 7, 360.0), 360) AS c, CAST(event_id * 10 % 360 AS DOUBLE) AS z FROM events))""",
}
