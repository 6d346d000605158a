"""DuckDB SQL of the queries in cell_queries."""

from __future__ import annotations

from fieldlens.operators.captions import PROFILES

from .cell_queries import PART_PROFILES

NORM = "trim(regexp_replace(lower(strip_accents(coalesce({v}, ''))), '[^a-z0-9]+', ' ', 'g'))"
PIX = "px AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, CAST(l_partkey * 37 % 256 AS INT) AS r, CAST(l_suppkey * 91 % 256 AS INT) AS g, CAST(l_orderkey * 53 % 256 AS INT) AS b FROM lineitem)"
HSV = (
    PIX
    + """, p1 AS (SELECT *, r / 255.0::DOUBLE AS rf, g / 255.0::DOUBLE AS gf, b / 255.0::DOUBLE AS bf FROM px),
p2 AS (SELECT *, greatest(rf, gf, bf) AS hi, greatest(rf, gf, bf) - least(rf, gf, bf) AS span FROM p1),
p3 AS (SELECT *, CASE WHEN span = 0 THEN 0.0::DOUBLE WHEN hi = rf THEN CASE WHEN gf < bf THEN (gf - bf) / span + 6 ELSE (gf - bf) / span END WHEN hi = gf THEN (bf - rf) / span + 2 ELSE (rf - gf) / span + 4 END AS turn FROM p2),
hsv AS (SELECT *, fmod(turn / 6, 1.0) AS h, CASE WHEN hi = 0 THEN 0.0::DOUBLE ELSE span / hi END AS s, hi AS v FROM p3)"""
)


def _lab(r: str, g: str, b: str) -> tuple[str, str, str]:
    lin = lambda c: f"(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"
    f = lambda t: f"(CASE WHEN {t} > 0.008856 THEN pow({t}, 1.0::DOUBLE / 3.0) ELSE 7.787 * {t} + 16.0::DOUBLE / 116.0 END)"
    rl, gl, bl = lin(r), lin(g), lin(b)
    x, y, z = f"((0.4124564 * {rl} + 0.3575761 * {gl} + 0.1804375 * {bl}) / 0.95047)", f"(0.2126729 * {rl} + 0.7151522 * {gl} + 0.0721750 * {bl})", f"((0.0193339 * {rl} + 0.1191920 * {gl} + 0.9503041 * {bl}) / 1.08883)"
    return f"(116 * {f(y)} - 16)", f"(500 * ({f(x)} - {f(y)}))", f"(200 * ({f(y)} - {f(z)}))"


def _points(table: list[tuple], col: str) -> list[str]:
    esc = lambda s: s.replace("'", "''")
    return [" + ".join([f"CASE WHEN contains({col}, '{esc(p)}') THEN 6 ELSE 0 END" for p in t[5]] + [f"CASE WHEN contains({col}, '{esc(x)}') THEN 1 ELSE 0 END" for x in t[6]]) for t in table]


def _profile(table: list[tuple], key: str, source: str) -> str:
    pts = _points(table, "norm")
    cases = " ".join(f"WHEN s{k} = best THEN '{t[0]}'" for k, t in enumerate(table))
    cols = ", ".join(f"{p} AS s{k}" for k, p in enumerate(pts))
    most = ", ".join(f"s{k}" for k in range(len(table)))
    return f"SELECT {key}, CASE WHEN best >= 4 THEN CASE {cases} END END AS profile, CAST(best AS INT) AS strength FROM (SELECT *, greatest({most}) AS best FROM (SELECT *, {cols} FROM ({source})))"


_PART = f"SELECT p_partkey, p_brand, {NORM.format(v='concat_ws(chr(32), p_name, p_type)')} AS norm FROM part"
_CELLS = "c AS (SELECT s_suppkey AS ord, (CASE WHEN s_suppkey % 3 = 0 THEN '2G' ELSE '3G' END) AS tech, 'SITE' || (s_suppkey % 40) AS site, 'CELL' || s_suppkey AS cell, CAST(s_suppkey % 3 * 120 AS INT) AS azimuth, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 900 ELSE 10000 + s_suppkey % 100 END AS freq FROM supplier)"
_PAIRS = "n AS (SELECT 'CELL' || s_suppkey AS src, 'CELL' || (s_suppkey * 7 % 100 + 1) AS tgt, 'GSM' AS layer FROM supplier UNION ALL SELECT 'CELL' || s_suppkey, 'CELL' || (s_suppkey * 11 % 100 + 1), 'DCS' FROM supplier WHERE s_suppkey % 4 > 0)"
_TARGETS = "t AS (SELECT DISTINCT n.src, b.site, b.azimuth FROM n JOIN c a ON a.cell = n.src JOIN c b ON b.cell = n.tgt WHERE a.site <> b.site OR a.azimuth <> b.azimuth)"
_EMB = "e AS (SELECT label, vec_id AS id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(20 + vec_id % 7 AS DOUBLE) AS area FROM embeddings)"
_NN = "nn AS (SELECT label, a, b, distance, row_number() OVER (PARTITION BY label, a ORDER BY distance, b) AS rank FROM (SELECT p.label, p.id AS a, q.id AS b, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS distance FROM e p JOIN e q ON p.label = q.label AND p.id <> q.id))"
_SITE = "s AS (SELECT 'SITE' || (s_suppkey % 9) AS base, s_suppkey AS ord, 30 + s_suppkey * 0.0003::DOUBLE AS lat, -7 - (s_suppkey % 7) * 0.0002::DOUBLE AS lng FROM supplier)"
_HAV = "2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a))"
_GRID = "gr AS (SELECT CAST(c_custkey % 100 AS INT) AS x, CAST(c_custkey // 100 AS INT) AS y, CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END AS m FROM customer)"
_BOX = _GRID + ", bx AS (SELECT a.x, a.y, a.m, CAST(sum(b.m) AS BIGINT) AS density FROM gr a JOIN gr b ON b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 GROUP BY a.x, a.y, a.m)"
_ANCHOR = "an AS (SELECT s_nationkey % 5 AS sheet, s_suppkey AS anchor_no, CAST(s_suppkey * 7 % 60 AS INT) AS row, CAST(s_suppkey * 3 % 23 AS INT) AS col FROM supplier)"
_CUST = "cu AS (SELECT c_custkey, c_nationkey % 5 AS sheet, CAST(c_custkey % 60 AS INT) AS row, CAST(c_custkey % 23 AS INT) AS col, c_name AS value, CAST(c_custkey % 4 AS INT) AS strength FROM customer)"
_ANALYSES = """k AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 OR o_custkey % 5 = 0 THEN 'cross' ELSE 'degradation' END AS kind FROM orders),
an AS (SELECT o_custkey AS workbook, o_orderkey AS ord, kind, CASE WHEN kind = 'cross' THEN ['Best Server', 'Serving PCI', 'Serving Cell ID'][o_orderkey % 3 + 1] ELSE ['Débit DL', 'Débit UL', 'Quality (SINR)', 'Coverage (RSRP)'][o_orderkey % 4 + 1] END AS label,
'L' || (o_orderkey % 4 * 100) AS sheet, CASE WHEN kind = 'degradation' THEN ['throughput', 'throughput', 'quality', 'coverage'][o_orderkey % 4 + 1] END AS metric_group, CASE WHEN kind = 'degradation' THEN ['DL Throughput', 'UL Throughput', 'SINR', 'RSRP'][o_orderkey % 4 + 1] END AS metric,
CASE WHEN kind = 'cross' THEN CASE WHEN o_orderstatus = 'F' THEN 'Cross detected' ELSE 'No cross detected' END ELSE CASE WHEN o_orderstatus = 'F' THEN 'SSV NOK' ELSE 'SSV OK' END END AS verdict, o_orderstatus = 'F' AS failed, CASE WHEN o_orderkey % 7 = 0 THEN 'w' || o_orderkey END AS warning FROM k)"""
_KEY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper({v}), '\s+', '', 'g'), '_+', '_', 'g'), '^[234]G_', ''), '_[0-9]+$', '')"


def _dest(lat: str, lng: str, bearing: str, meters: str) -> tuple[str, str]:
    d, t, p = f"({meters} / 6371000.0::DOUBLE)", f"radians({bearing})", f"radians({lat})"
    q = f"asin(sin({p}) * cos({d}) + cos({p}) * sin({d}) * cos({t}))"
    return f"degrees({q})", f"{lng} + degrees(atan2(sin({t}) * sin({d}) * cos({p}), cos({d}) - sin({p}) * sin({q})))"


def _proto() -> str:
    import colorsys

    ps = [(37, 72, 235), (240, 224, 40), (234, 52, 45)]
    hue = [colorsys.rgb_to_hsv(*(c / 255 for c in p))[0] for p in ps]
    turn = lambda a, b: min(abs(a - b) % 1, 1 - abs(a - b) % 1) * 360
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5
    rows = []
    for k, p in enumerate(ps):
        rgb_cap = min(80.0, max(45.0, 0.42 * min(apart(p, q) for j, q in enumerate(ps) if j != k)))
        hue_cap = min(18.0, max(8.0, 0.42 * min(turn(hue[k], hue[j]) for j in range(3) if j != k)))
        rows.append(f"({k}, {p[0]}, {p[1]}, {p[2]}, {hue[k]!r}::DOUBLE, {rgb_cap!r}::DOUBLE, {hue_cap!r}::DOUBLE)")
    return ", ".join(rows)


def _lab_of(rgb: tuple[int, int, int]) -> tuple[float, float, float]:
    lin = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in rgb]
    x, y, z = (sum(m * c for m, c in zip(row, lin, strict=True)) for row in ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041)))
    f = [t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116 for t in (x / 0.95047, y, z / 1.08883)]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def _nearest_swatches() -> str:
    """Lab step by step, once for each colour."""
    lin = ", ".join(f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS l{c}" for c in "rgb")
    root = ", ".join(f"CASE WHEN {t} > 0.008856 THEN pow({t}, 1.0::DOUBLE / 3.0) ELSE 7.787 * {t} + 16.0::DOUBLE / 116.0 END AS f{t}" for t in "xyz")
    d = [f"{{'d': sqrt(pow(116 * fy - 16 - {a!r}::DOUBLE, 2) + pow(500 * (fx - fy) - {b!r}::DOUBLE, 2) + pow(200 * (fy - fz) - {c!r}::DOUBLE, 2)), 'k': {k}}}" for k, (a, b, c) in enumerate(map(_lab_of, [(234, 52, 45), (240, 224, 40), (60, 180, 75), (37, 72, 235)]))]
    return f"""WITH {PIX}, c1 AS MATERIALIZED (SELECT DISTINCT r, g, b FROM px), c2 AS MATERIALIZED (SELECT r, g, b, {lin} FROM c1),
c3 AS MATERIALIZED (SELECT r, g, b, (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047 AS x, 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb AS y, (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883 AS z FROM c2),
c4 AS MATERIALIZED (SELECT r, g, b, {root} FROM c3), c5 AS MATERIALIZED (SELECT r, g, b, list_sort([{', '.join(d)}]) AS near FROM c4)
SELECT l_orderkey, l_linenumber, CAST(near[1].k AS INT) AS swatch, round(near[1].d, 3) AS distance, round(near[1].d / near[2].d, 3) AS margin FROM px JOIN c5 USING (r, g, b)"""


def _peaks() -> str:
    apart = lambda a, b: f"least(abs({a} - {b}), 36 - abs({a} - {b})) > 2"
    first = lambda k: f"arg_max(bin, n * 100 + bin) AS p{k}"
    return f"""WITH {HSV}, h AS (SELECT l_orderkey % 5 AS image, CAST(floor(h * 36) AS BIGINT) % 36 AS bin, count(*) AS n FROM hsv WHERE s >= 0.5 AND v >= 0.35 GROUP BY 1, 2),
a AS (SELECT image, {first(1)} FROM h GROUP BY image),
b AS (SELECT image, {first(2)} FROM h JOIN a USING (image) WHERE {apart('bin', 'p1')} GROUP BY image),
c AS (SELECT image, {first(3)} FROM h JOIN a USING (image) JOIN b USING (image) WHERE {apart('bin', 'p1')} AND {apart('bin', 'p2')} GROUP BY image)
SELECT image, concat_ws(',', p1, p2, p3) AS peaks FROM a LEFT JOIN b USING (image) LEFT JOIN c USING (image)"""


def _levels(n: int) -> str:
    return f"(SELECT unnest(range({n})) AS i)"


_LAB = _lab("r", "g", "b")
_WEDGE = _dest("lat", "lng", "(fmod(ord * 37, 360) - 30.0 + (i - 1) * 5.0)", "80.0")
_DESTP = _dest("lat", "lng", "CAST(ord * 37 % 360 AS DOUBLE)", "150.0")
_STRONG = " AND ".join(f"sqrt(pow(r - {a}, 2) + pow(g - {b}, 2) + pow(b - {c}, 2)) > 60" for a, b, c in [(37, 72, 235), (240, 224, 40), (234, 52, 45), (120, 120, 120)])

SQL = {
    "normalize_text": f"SELECT doc_id, {NORM.format(v='text')} AS norm FROM documents",
    "profile_match_top1": _profile(PART_PROFILES, "p_partkey", _PART),
    "caption_profiles": _profile(PROFILES, "doc_id", f"SELECT doc_id, {NORM.format(v='text')} AS norm FROM documents"),
    "target_strength_topk": f"SELECT p_brand, p_partkey, CAST(best AS INT) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY best DESC, p_partkey) AS k FROM (SELECT *, greatest({', '.join(_points(PART_PROFILES, 'norm'))}) AS best FROM ({_PART}))) WHERE k = 1",
    "sheet_rank_score": f"SELECT p_partkey, 24 * CAST(contains(t, '800') AS INT) + 18 * CAST(contains(t, 'dt') AS INT) + 18 * CAST(contains(t, 'mobilite') OR contains(t, 'mobile') OR contains(t, 'mobility') AS INT) + 8 * CAST(starts_with(t, '3 ') AS INT) AS score FROM (SELECT p_partkey, {NORM.format(v=chr(39).join(['p_size || ', ' L', ' || (p_partkey % 30 * 100) || ', ' DT en Mobilité', '']))} AS t FROM part)",
    "band_infer_threshold": """WITH a AS (SELECT s_suppkey, 'l' || (s_suppkey % 30 * 100) AS t, s_suppkey % 2 = 0 AS l26, CAST(s_suppkey * 7 % 80 AS DOUBLE) AS dl, CAST(s_suppkey * 3 % 30 AS DOUBLE) AS ul FROM supplier),
b AS (SELECT *, CASE WHEN contains(t, '800') THEN 'L800' WHEN contains(t, '2100') THEN 'L2100' WHEN contains(t, '2600') OR l26 THEN 'L2600' END AS band FROM a),
c AS (SELECT *, CASE band WHEN 'L800' THEN 15.0::DOUBLE WHEN 'L2100' THEN 25.0 WHEN 'L2600' THEN 50.0 END AS min_dl, CASE band WHEN 'L800' THEN 10.0::DOUBLE WHEN 'L2100' THEN 15.0 WHEN 'L2600' THEN 20.0 END AS min_ul FROM b),
d AS (SELECT *, list_filter([CASE WHEN dl < min_dl THEN printf('Avg DL Throughput %.2f Mbps is below the %s minimum of %.0f Mbps.', dl, band, min_dl) END, CASE WHEN ul < min_ul THEN printf('Avg UL Throughput %.2f Mbps is below the %s minimum of %.0f Mbps.', ul, band, min_ul) END, CASE WHEN min_dl IS NULL THEN 'Unknown LTE band for throughput thresholds.' END], lambda x: x IS NOT NULL) AS w FROM c)
SELECT s_suppkey, band, min_dl, min_ul, CAST(len(w) AS INT) AS n_warnings, array_to_string(w, '; ') AS warnings, CASE WHEN len(w) > 0 THEN 'SSV NOK' ELSE 'SSV OK' END AS verdict FROM d""",
    "first_number": "SELECT page_id, TRY_CAST(nullif(regexp_extract(replace(url, ',', '.'), '(-?[0-9]+(?:[.][0-9]+)?)', 1), '') AS DOUBLE) AS number FROM pages",
    "levenshtein_cost": "SELECT c_custkey, CAST(levenshtein(c_name, 'Customer#' || lpad(CAST(c_custkey * 7 % 1000 AS VARCHAR), 9, '0')) AS INT) AS cost FROM customer",
    "ocr_cost": """WITH a AS (SELECT c_custkey, regexp_extract_all(c_name || ' ' || c_nationkey, '[0-9]+') AS g, CAST(c_custkey % 97 + 10 AS VARCHAR) AS own FROM customer),
b AS (SELECT *, array_to_string(g, '') AS st FROM a),
c AS (SELECT *, list_concat(g, CASE WHEN len(st) >= len(own) THEN list_transform(range(1, len(st) - len(own) + 2), lambda i: substr(st, i, len(own))) ELSE [] END) AS w FROM b)
SELECT c_custkey, CAST(CASE WHEN len(g) = 0 THEN len(own) + 10 WHEN contains(st, own) THEN 0 ELSE list_min(list_transform(w, lambda x: levenshtein(x, own))) END AS INT) AS cost FROM c""",
    "cell_references": "SELECT o_orderkey, (CASE WHEN c >= 702 THEN chr(CAST(65 + (c - 702) // 676 % 26 AS INT)) ELSE '' END) || (CASE WHEN c >= 26 THEN chr(CAST(65 + (c - 26) // 26 % 26 AS INT)) ELSE '' END) || chr(CAST(65 + c % 26 AS INT)) || (o_orderkey % 5000 + 1) AS ref, CAST(c AS INT) AS col FROM (SELECT o_orderkey, o_custkey % 18000 AS c FROM orders)",
    "rgb_to_hsv": f"WITH {HSV} SELECT l_orderkey, l_linenumber, round(h, 6) AS h, round(s, 6) AS s, round(v, 6) AS v FROM hsv",
    "rgb_to_lab": f"WITH {PIX} SELECT l_orderkey, l_linenumber, round({_LAB[0]}, 3) AS lab_l, round({_LAB[1]}, 3) AS lab_a, round({_LAB[2]}, 3) AS lab_b FROM px",
    "rgb_hex": f"WITH {PIX} SELECT l_orderkey, l_linenumber, printf('#%02x%02x%02x', r, g, b) AS hex FROM px",
    "color_name": f"WITH {HSV} SELECT CASE WHEN v < 0.20 OR s < 0.20 THEN 'Neutral' WHEN h * 360 < 20 OR h * 360 >= 340 THEN 'Red' WHEN h * 360 < 50 THEN 'Orange' WHEN h * 360 < 75 THEN 'Yellow' WHEN h * 360 < 165 THEN 'Green' WHEN h * 360 < 205 THEN 'Cyan' WHEN h * 360 < 280 THEN 'Blue' ELSE 'Purple' END AS name, count(*) AS n FROM hsv GROUP BY 1",
    "colorful_mask": f"WITH {HSV} SELECT l_orderkey, l_linenumber, s >= 0.5 AND v >= 0.35 AS colorful, s >= 0.35 AND v >= 0.30 AND r >= 1.05::DOUBLE * g AND r >= 1.15::DOUBLE * b AS reddish, (round(h * 180) <= 8 OR round(h * 180) >= 172) AND round(s * 255) >= 150 AND round(v * 255) >= 150 AS cluster FROM hsv",
    "mean_rgb": f"WITH {PIX} SELECT l_orderkey % 50 AS sector, CAST(sum(r) // count(*) AS BIGINT) AS r, CAST(sum(g) // count(*) AS BIGINT) AS g, CAST(sum(b) // count(*) AS BIGINT) AS b, count(*) AS n FROM px GROUP BY 1",
    "hue_histogram": f"WITH {HSV} SELECT l_orderkey % 5 AS image, CAST(floor(h * 36) AS BIGINT) % 36 AS bin, count(*) AS n FROM hsv WHERE s >= 0.5 AND v >= 0.35 GROUP BY 1, 2",
    "sector_prototype_assign": f"""WITH {HSV}, proto(k, pr, pg, pb, ph, rc, hc) AS (VALUES {_proto()}),
c AS (SELECT rid, l_orderkey, l_linenumber, k, sqrt(pow(r - pr, 2) + pow(g - pg, 2) + pow(b - pb, 2)) AS d, least(abs(h - ph), 1 - abs(h - ph)) * 360 AS t, rc, hc FROM hsv, proto),
x AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, t, k) AS rn FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN d <= rc AND t <= hc THEN CAST(k AS INT) ELSE -1 END AS sector, round(d, 6) AS rgb_distance FROM x WHERE rn = 1""",
    "legend_two_nearest": _nearest_swatches(),
    "swatch_anti": f"WITH {PIX} SELECT DISTINCT r, g, b FROM px WHERE {_STRONG}",
    "box_sum": f"WITH {_BOX} SELECT x, y, m, density FROM bx",
    "weighted_centroid": f"""WITH {_BOX}, a AS (SELECT *, x % 4 AS part, max(density) OVER (PARTITION BY x % 4) AS best FROM bx), b AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY density DESC, y, x) AS k FROM a WHERE density >= 0.82 * best)
SELECT part, round(sum(greatest(density, 1.0) * x) / sum(greatest(density, 1.0)), 4) AS cx, round(sum(greatest(density, 1.0) * y) / sum(greatest(density, 1.0)), 4) AS cy, count(*) AS n FROM b WHERE k <= 90 GROUP BY part""".replace("greatest(density, 1.0)", "greatest(CAST(density AS DOUBLE), 1.0::DOUBLE)"),
    "nearest_anchor": f"WITH {_ANCHOR}, {_CUST} SELECT c_custkey, anchor_no, CAST(distance AS INT) AS distance FROM (SELECT c_custkey, anchor_no, abs(an.row - cu.row) + abs(an.col - cu.col) AS distance, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(an.row - cu.row) + abs(an.col - cu.col), anchor_no) AS k FROM cu JOIN an USING (sheet)) WHERE k = 1",
    "nearby_score": f"""WITH {_ANCHOR}, {_CUST}, x AS (SELECT sheet, anchor_no, sum(12.0::DOUBLE * strength / (1 + abs(an.row - cu.row) + abs(an.col - cu.col))) AS score, list_sort(list(chr(65 + cu.col) || (cu.row + 1) || ': ' || value))[1:6] AS texts FROM an JOIN cu USING (sheet) WHERE strength > 0 AND abs(an.row - cu.row) + abs(an.col - cu.col) <= 10 GROUP BY sheet, anchor_no)
SELECT sheet, anchor_no, round(coalesce(score, 0.0), 4) AS score, coalesce(array_to_string(texts, '|'), '') AS texts FROM an LEFT JOIN x USING (sheet, anchor_no)""",
    "offset_probe": """WITH c AS (SELECT CAST(c_custkey // 40 AS INT) AS row, CAST(c_custkey % 40 AS INT) AS col, CASE WHEN c_custkey % 3 = 0 THEN CAST(replace(CAST(c_custkey % 70 AS VARCHAR) || ',5', ',', '.') AS DOUBLE) END AS number FROM customer),
l AS (SELECT row, col FROM c WHERE number IS NULL AND col % 5 = 1), o(prio, dr, dc) AS (VALUES (0, 0, 1), (1, 0, 2), (2, 1, 0), (3, 1, 1), (4, 1, 2), (5, -1, 1)),
f AS (SELECT l.row, l.col, arg_min(c.number, prio) AS number FROM l, o, c WHERE c.row = l.row + dr AND c.col = l.col + dc AND c.number IS NOT NULL GROUP BY l.row, l.col)
SELECT l.row, l.col, f.number FROM l LEFT JOIN f USING (row, col)""",
    "dedup_best": "SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1",
    "best_sheet": "SELECT o_custkey, o_orderkey, round(s, 2) AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, o_orderkey) AS k FROM (SELECT *, o_totalprice + CASE WHEN o_orderstatus = 'F' THEN 50000.0::DOUBLE ELSE 0 END AS s FROM orders)) WHERE k = 1",
    "stable_rank": "SELECT o_custkey, o_orderkey, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE m >= 300000",
    "nn_median_link_distance": f"WITH {_EMB}, {_NN} SELECT label, round(median(distance), 6) AS median_nearest, round(least(96.0, greatest(18.0, 1.6 * median(distance))), 6) AS link FROM nn WHERE rank = 1 GROUP BY label",
    "pairwise_extent": f"WITH {_EMB} SELECT p.label, count(DISTINCT p.id) AS n, round(max(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))), 6) AS extent FROM e p JOIN e q USING (label) GROUP BY p.label",
    "top10_median": "SELECT o_custkey, round(median(o_totalprice), 4) AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 10 GROUP BY o_custkey",
    "top40_nearest": f"WITH {_EMB} SELECT label, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY x * x + y * y, id) AS k FROM e) WHERE k <= 40 GROUP BY label",
    "knn_reciprocal": f"WITH {_EMB}, {_NN} SELECT a.label, a.a, a.b FROM nn a JOIN nn b ON a.label = b.label AND a.a = b.b AND a.b = b.a WHERE a.rank <= 3 AND b.rank <= 3 AND a.a < a.b",
    "cluster_quality": f"WITH {_EMB}, {_NN} SELECT label, n, round(width, 4) AS width, round(height, 4) AS height, round(mean_y, 4) AS mean_y, round(cv_area, 4) AS cv_area, round(cv_nearest, 4) AS cv_nearest FROM (SELECT label, count(*) AS n, max(x) - min(x) AS width, max(y) - min(y) AS height, avg(y) AS mean_y, stddev_pop(area) / avg(area) AS cv_area FROM e GROUP BY label) LEFT JOIN (SELECT label, stddev_pop(distance) / avg(distance) AS cv_nearest FROM nn WHERE rank = 1 GROUP BY label) USING (label)",
    "distance_links": f"WITH {_EMB} SELECT p.label, p.id AS a, q.id AS b, round(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), 6) AS distance FROM e p JOIN e q ON p.label = q.label AND p.id < q.id WHERE sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 4.0",
    "connected_components": f"""WITH RECURSIVE {_EMB}, l AS (SELECT p.id AS a, q.id AS b FROM e p JOIN e q ON p.id <> q.id WHERE sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 1.0),
r AS (SELECT id, id AS c FROM e UNION SELECT l.b AS id, r.c FROM r JOIN l ON l.a = r.id)
SELECT id, min(c) AS component FROM r GROUP BY id""",
    "haversine_pairs": f"WITH {_SITE}, h AS (SELECT p.base, p.ord AS a1, q.ord AS b1, pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lng - p.lng) / 2), 2) AS a FROM s p JOIN s q ON p.base = q.base AND p.ord < q.ord) SELECT base, a1 AS a, b1 AS b, round({_HAV}, 3) AS meters FROM h WHERE {_HAV} < 500",
    "destination_point": f"WITH {_SITE} SELECT ord, round({_DESTP[0]}, 7) AS lat, round({_DESTP[1]}, 7) AS lng FROM s",
    "wedge_polygon": f"WITH {_SITE} SELECT ord, CAST(i AS INT) AS i, round(CASE WHEN i IN (0, 14) THEN lat ELSE {_WEDGE[0]} END, 7) AS lat, round(CASE WHEN i IN (0, 14) THEN lng ELSE {_WEDGE[1]} END, 7) AS lng FROM s, {_levels(15)}",
    "sites_by_tech": f"WITH {_CELLS}, p AS (SELECT site, bool_or(tech = '2G') AS g2, bool_or(tech = '3G') AS g3 FROM c GROUP BY site) SELECT count(*) FILTER (g2 AND NOT g3) AS only_2g, count(*) FILTER (g3 AND NOT g2) AS only_3g, count(*) FILTER (g2 AND g3) AS both FROM p",
    "layer_sets": f"WITH {_CELLS}, l AS (SELECT *, CASE WHEN tech = '2G' THEN CASE WHEN freq < 500 THEN '900' ELSE '1800' END ELSE CAST(freq AS VARCHAR) END AS layer FROM c) SELECT site, azimuth, coalesce(string_agg(DISTINCT layer, ',' ORDER BY layer) FILTER (tech = '2G'), '') AS layers_2g, coalesce(string_agg(DISTINCT layer, ',' ORDER BY layer) FILTER (tech = '3G'), '') AS layers_3g FROM l GROUP BY site, azimuth",
    "phase_rows_union": f"WITH {_PAIRS} SELECT src, tgt, layer FROM n",
    "neighbour_targets": f"WITH {_CELLS}, {_PAIRS}, {_TARGETS} SELECT src, site, azimuth FROM t",
    "highlight_semi": f"WITH {_CELLS}, {_PAIRS}, {_TARGETS} SELECT cell, site, azimuth FROM c WHERE cell = 'CELL5' OR (site, azimuth) IN (SELECT (site, azimuth) FROM t WHERE src = 'CELL5')",
    "fuzzy_key_join": f"""WITH k AS (SELECT n_nationkey AS ord, n_name AS site, {_KEY.format(v='n_name')} AS kk FROM nation),
w AS (SELECT c_custkey, {_KEY.format(v="'3g_' || substr(n_name, 1, 3 + c_custkey % 7) || '__' || (c_custkey % 4)")} AS key FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, arg_min(site, ord) AS site FROM w LEFT JOIN k ON contains(key, kk) OR contains(kk, key) GROUP BY c_custkey""",
    "cell_lookup": """WITH c AS (SELECT s_suppkey AS ord, 'N' || (s_suppkey % 20) AS site, 'N' || (s_suppkey % 10) || ['A', 'B', 'C'][s_suppkey % 3 + 1] AS id, CAST(s_suppkey * 7 % 360 AS INT) AS azimuth FROM supplier),
s AS (SELECT site, min(ord) AS ord FROM c GROUP BY site), w AS (SELECT c_custkey, 'N' || (c_custkey % 12) || ['A', 'B', 'C', 'D'][c_custkey % 4 + 1] AS id FROM customer),
p AS (SELECT id, arg_min(site, ord) AS site FROM (SELECT DISTINCT id, substr(id, 1, len(id) - 1) AS parent FROM w) JOIN s ON contains(parent, site) OR contains(site, parent) GROUP BY id),
f AS (SELECT id, c.site, arg_min(azimuth, c.ord) AS azimuth, any_value(s.ord) AS first FROM c JOIN s USING (site) GROUP BY id, c.site),
b AS (SELECT f.id, arg_min({'site': f.site, 'azimuth': f.azimuth}, (CASE WHEN f.site = p.site THEN 0 ELSE 1000000 END) + first) AS best FROM f LEFT JOIN p ON p.id = f.id GROUP BY f.id)
SELECT c_custkey, best.site AS site, best.azimuth AS azimuth FROM w LEFT JOIN b USING (id)""",
    "slice_cells": f"WITH {_CELLS}, l AS (SELECT *, CASE WHEN tech = '2G' THEN CASE WHEN freq < 500 THEN '900' ELSE '1800' END ELSE CAST(freq AS VARCHAR) END AS layer FROM c) SELECT site, azimuth, tech, layer, arg_min(cell, ord) AS cell FROM l GROUP BY site, azimuth, tech, layer",
    "gap_pairs": """WITH b AS (SELECT s_suppkey % 4 AS image, s_suppkey AS id, s_suppkey * 37 % 500 AS x0, s_suppkey * 37 % 500 + 3 + s_suppkey % 30 AS x1, s_suppkey * 53 % 400 AS y0, s_suppkey * 53 % 400 + 2 + s_suppkey % 20 AS y1 FROM supplier),
p AS (SELECT a.image, a.id AS a, c.id AS b, sqrt(pow(greatest(0, c.x0 - a.x1, a.x0 - c.x1), 2) + pow(greatest(0, c.y0 - a.y1, a.y0 - c.y1), 2)) AS gap FROM b a JOIN b c ON a.image = c.image AND a.id < c.id)
SELECT image, a, b, round(gap, 6) AS gap FROM p WHERE gap <= 25""",
    "track_offsets": """WITH e AS (SELECT o_custkey, o_orderkey, CAST(o_orderkey % 700 + 100 AS DOUBLE) AS length FROM orders),
t AS (SELECT o_custkey, row_number() OVER w - 1 AS i, sum(length) OVER w - length / 2 AS middle, count(*) OVER (PARTITION BY o_custkey) AS n, sum(length) OVER (PARTITION BY o_custkey) AS around FROM e WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT c_custkey AS o_custkey, CAST(c_custkey * 37 % 360 AS DOUBLE) AS angle FROM customer),
q AS (SELECT v.o_custkey, angle / 360 * n AS pos, n, around FROM v JOIN (SELECT DISTINCT o_custkey, n, around FROM t) USING (o_custkey))
SELECT q.o_custkey, round(a.middle + (pos - floor(pos)) * (CASE WHEN floor(pos) + 1 < q.n THEN b.middle ELSE q.around + b.middle END - a.middle), 4) AS offset, round(q.around, 2) AS around
FROM q JOIN t a ON a.o_custkey = q.o_custkey AND a.i = floor(pos) JOIN t b ON b.o_custkey = q.o_custkey AND b.i = CAST(floor(pos) + 1 AS BIGINT) % q.n""",
    "panorama_drag": """WITH e AS (SELECT event_id, value, fmod(value * 7, 360.0) AS a FROM events), f AS (SELECT *, cos(radians(-a)) AS c, sin(radians(-a)) AS s, a - value * 9 / 2400.0 * 360 AS t FROM e)
SELECT event_id, round(t - 360 * floor(t / 360), 4) AS angle, round(value - (value * c - 40.0 * s), 4) AS dx, round(40.0 - (value * s + 40.0 * c), 4) AS dy, CAST((event_id % 5 + 2) % 5 AS INT) AS image FROM f""",
    "best_strategy": """WITH c AS (SELECT o_custkey AS image, o_orderstatus AS strategy, o_orderkey % 11 AS n, CAST(o_orderkey % 97 AS DOUBLE) AS extent FROM orders),
s AS (SELECT image, strategy, coalesce(max(n) FILTER (n >= 6), 0) AS most, count(*) FILTER (n >= 6) AS count, coalesce(sum(extent) FILTER (n >= 6), 0.0) AS extent FROM c GROUP BY image, strategy)
SELECT image, strategy, most, count, extent FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY most DESC, count DESC, extent DESC, strategy) AS k FROM s) WHERE k = 1""",
    "hue_peaks": _peaks(),
    "leader_merge": f"""WITH RECURSIVE {_SITE}, g AS (SELECT base, list({{'ord': ord, 'lat': lat, 'lng': lng}} ORDER BY ord) AS rest FROM s GROUP BY base),
t AS (SELECT base, rest, rest[1] AS head, CAST(-1 AS INT) AS cluster, CAST([] AS BIGINT[]) AS gone FROM g UNION ALL
  SELECT base, list_filter(rest, lambda x: NOT list_contains(near, x.ord)), head, cluster + 1, near FROM (
    SELECT base, rest, rest[1] AS head, cluster, list_transform(list_filter(rest, lambda x: x.ord = rest[1].ord OR 2 * 6371000.0 * asin(sqrt(pow(sin(radians(x.lat - rest[1].lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(rest[1].lat)) * pow(sin(radians(x.lng - rest[1].lng) / 2), 2))) < 50), lambda x: x.ord) AS near FROM t WHERE len(rest) > 0))
SELECT base, unnest(gone) AS ord, head.ord AS leader FROM t WHERE cluster >= 0""",
    "min_cost_assignment": """WITH c AS (SELECT a.n_regionkey AS legend, CAST(a.n_nationkey AS BIGINT) AS row, b.n_name AS name, CAST((a.n_nationkey * 7 + b.n_nationkey * 13) % 11 AS DOUBLE) AS cost, dense_rank() OVER (PARTITION BY a.n_regionkey ORDER BY a.n_nationkey) AS i FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey),
p AS (SELECT a.legend, a.name AS n1, b.name AS n2, d.name AS n3, e.name AS n4, f.name AS n5, a.cost + b.cost + d.cost + e.cost + f.cost AS total FROM c a JOIN c b ON a.legend = b.legend AND b.i = 2 AND b.name <> a.name JOIN c d ON a.legend = d.legend AND d.i = 3 AND d.name NOT IN (a.name, b.name)
  JOIN c e ON a.legend = e.legend AND e.i = 4 AND e.name NOT IN (a.name, b.name, d.name) JOIN c f ON a.legend = f.legend AND f.i = 5 AND f.name NOT IN (a.name, b.name, d.name, e.name) WHERE a.i = 1),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY legend ORDER BY total, n1, n2, n3, n4, n5) AS k FROM p) WHERE k = 1),
u AS (SELECT legend, unnest([n1, n2, n3, n4, n5]) AS name, unnest([1, 2, 3, 4, 5]) AS i FROM o)
SELECT c.legend, c.row, c.name, c.cost FROM c JOIN u ON u.legend = c.legend AND u.i = c.i AND u.name = c.name""",
    "mask_components": f"""WITH RECURSIVE {_GRID}, on_ AS (SELECT x, y, y * 100 + x AS id FROM gr WHERE m = 1),
l AS (SELECT a.id AS a, b.id AS b FROM on_ a JOIN on_ b ON a.id <> b.id AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1),
r AS (SELECT id, id AS c FROM on_ UNION SELECT l.b AS id, r.c FROM r JOIN l ON l.a = r.id WHERE r.c < l.b),
q AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT x, y, dense_rank() OVER (ORDER BY c) - 1 AS comp FROM q JOIN on_ USING (id))
SELECT comp, count(*) AS area, CAST(min(x) AS BIGINT) AS min_x, CAST(max(x) AS BIGINT) AS max_x, CAST(min(y) AS BIGINT) AS min_y, CAST(max(y) AS BIGINT) AS max_y, round(count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1)), 6) AS fill_ratio FROM n GROUP BY comp""",
    "label_interval_join": "WITH l AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user')) SELECT c.conv_id, c.turn AS col, 'L' || l.turn AS label FROM conversations c LEFT JOIN l ON l.conv_id = c.conv_id AND l.turn <= c.turn AND (l.nxt IS NULL OR c.turn < l.nxt)",
    "section_fill": "SELECT conv_id, turn, role, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS section FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)",
    "blank_row_scan": """WITH a AS (SELECT *, turn % 4 >= 2 AS blank FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)),
b AS (SELECT *, sum(CAST(blank AS INT)) OVER w2 >= 2 AND count(*) OVER w2 >= 2 AS run FROM a WINDOW w2 AS (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, max(CAST(run AS INT)) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM b)
SELECT conv_id, turn, role FROM c WHERE stop = 0 AND NOT blank""",
    "positional_zip": "WITH c AS (SELECT DISTINCT conv_id, turn, role FROM conversations), a AS (SELECT conv_id, turn AS asked, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM c WHERE role = 'user'), b AS (SELECT conv_id, turn AS answered, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM c WHERE role = 'assistant') SELECT conv_id, CAST(position AS INT) AS position, asked, answered FROM a JOIN b USING (conv_id, position)",
    "track_prefix": "SELECT o_custkey, o_orderkey, round(s - o_totalprice, 2) AS start, round(s, 2) AS stop FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM orders)",
    "identifier_last_wins": "SELECT 'ID' || (doc_id % 97) AS identifier, arg_max(source, doc_id) AS value FROM documents GROUP BY 1",
    "rollup_verdict": f"WITH {_ANALYSES} SELECT workbook, count(*) AS analyses, count(*) FILTER (failed) AS failures, count(*) FILTER (verdict = 'Cross detected') AS crosses, count(*) FILTER (kind <> 'cross') AS checks, CASE WHEN count(*) FILTER (failed AND kind <> 'cross') > 0 THEN 'SSV NOK' WHEN count(*) FILTER (verdict = 'Cross detected') > 0 THEN 'Cross detected' WHEN count(*) FILTER (kind <> 'cross') > 0 THEN 'SSV OK' ELSE 'No cross detected' END AS verdict, coalesce(string_agg(warning, '; ' ORDER BY ord), '') AS warnings FROM an GROUP BY workbook",
    "failure_summary": f"WITH {_ANALYSES}, f AS (SELECT workbook, list(coalesce(CASE metric WHEN 'DL Throughput' THEN 'Throughput DL' WHEN 'UL Throughput' THEN 'Throughput UL' ELSE metric END, label) || ' of ' || sheet || ' is DEGRADED' ORDER BY ord) AS l FROM an WHERE failed GROUP BY workbook) SELECT workbook, 'SSV NOK : ' || array_to_string(l[1:4], ' | ') || CASE WHEN len(l) > 4 THEN ' | +' || (len(l) - 4) || CASE WHEN len(l) > 5 THEN ' more issues' ELSE ' more issue' END ELSE '' END AS summary FROM f",
    "ordered_analyses": f"""WITH {_ANALYSES}, o AS (SELECT *, min(ord) OVER (PARTITION BY workbook, sheet) AS first, CASE WHEN kind = 'cross' AND label = 'Serving PCI' THEN 0 WHEN kind = 'cross' AND label = 'Serving Cell ID' THEN 1 WHEN kind = 'cross' AND label = 'Best Server' THEN 2 WHEN metric_group = 'coverage' THEN 3 WHEN metric_group = 'quality' THEN 4 WHEN label = 'Débit UL' THEN 6 ELSE 5 END AS category FROM an)
SELECT workbook, ord, CAST(row_number() OVER (PARTITION BY workbook ORDER BY first, category, ord) AS INT) AS position FROM o""",
    "display_texts": f"""WITH {_ANALYSES}, r AS (SELECT *, contains(lower(label), 'dl') AS down, CAST(ord % 60 AS DOUBLE) AS dl, CASE WHEN ord % 5 > 0 THEN 25.0 END AS least_dl FROM an),
t AS (SELECT *, CASE WHEN down THEN dl ELSE dl / 2 END AS rate, CASE WHEN down THEN least_dl ELSE 15.0 END AS least, CASE WHEN down THEN 'DL' ELSE 'UL' END AS side FROM r)
SELECT ord, CASE WHEN metric_group = 'coverage' THEN 'Coverage' WHEN metric_group = 'quality' THEN 'Quality' ELSE label END AS title, CASE WHEN kind = 'cross' THEN verdict WHEN failed THEN 'NOK' ELSE 'OK' END AS text, CASE WHEN kind = 'cross' THEN verdict ELSE metric || CASE WHEN failed THEN ' NOK' ELSE ' OK' END END AS badge,
'Throughput ' || side || CASE WHEN coalesce(rate >= least, false) THEN ' OK' ELSE ' NOK' END || ' : average ' || side || ' ' || printf('%.2f Mbps', rate) || ' (minimum is ' || coalesce(CASE WHEN least IS NOT NULL THEN printf('%.2f Mbps', CAST(least AS DOUBLE)) END, '--') || ')' AS details FROM t""",
    "visible_analyses": f"WITH {_ANALYSES} SELECT workbook, ord, verdict FROM (SELECT *, bool_or(failed) OVER (PARTITION BY workbook) AS bad FROM an) WHERE NOT bad OR failed",
    "svg_payload": """SELECT n_regionkey AS image, 'data:image/svg+xml;base64,' || to_base64(encode('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 640 360">' || string_agg('<circle cx="' || n_nationkey * 11 || '" cy="' || n_nationkey * 7 || '" r="6" fill="#ea342d"/>', '' ORDER BY n_nationkey) || '</svg>')) AS svg FROM nation GROUP BY n_regionkey""",
    "throughput_preview": """WITH t AS (SELECT s_suppkey, s_suppkey % 2 = 0 AS ok, s_suppkey % 3 > 0 AS known, CAST(s_suppkey * 3 AS DOUBLE) AS dl, CAST(s_suppkey * 2 AS DOUBLE) AS ul FROM supplier)
SELECT s_suppkey, 'data:image/svg+xml;base64,' || to_base64(encode('<svg xmlns="http://www.w3.org/2000/svg" width="900" height="420" viewBox="0 0 900 420"><rect width="900" height="420" rx="32" fill="#101a29" /><rect x="38" y="34" width="200" height="62" rx="16" fill="'
|| CASE WHEN ok THEN '#00FF37' ELSE '#FF2900' END || '" /><text x="62" y="74" fill="' || CASE WHEN ok THEN '#001f08' ELSE '#fff5f2' END || '" font-size="30" font-weight="700" font-family="Inter, sans-serif">' || CASE WHEN ok THEN 'SSV OK' ELSE 'SSV NOK' END || '</text>'
|| '<text x="40" y="150" fill="#dbe8ff" font-size="34" font-family="Inter, sans-serif">Throughput summary</text><text x="40" y="196" fill="#9fc3f6" font-size="24" font-family="Inter, sans-serif">Band: ' || CASE WHEN known THEN 'L800' ELSE 'Unknown' END || '</text>'
|| '<text x="40" y="266" fill="#dbe8ff" font-size="28" font-family="Inter, sans-serif">Avg DL Throughput: ' || printf('%.2f', dl) || ' Mbps</text><text x="40" y="306" fill="#9fc3f6" font-size="22" font-family="Inter, sans-serif">Minimum: ' || CASE WHEN known THEN '15 Mbps' ELSE 'n/a' END || '</text>'
|| '<text x="40" y="366" fill="#dbe8ff" font-size="28" font-family="Inter, sans-serif">Avg UL Throughput: ' || printf('%.2f', ul) || ' Mbps</text><text x="40" y="406" fill="#9fc3f6" font-size="22" font-family="Inter, sans-serif">Minimum: ' || CASE WHEN known THEN '10 Mbps' ELSE 'n/a' END || '</text></svg>')) AS svg FROM t""",
    "kpi_preview": """SELECT n_regionkey AS image, 'data:image/svg+xml;base64,' || to_base64(encode('<svg xmlns="http://www.w3.org/2000/svg" width="2100" height="900" viewBox="0 0 2100 900"><image href="data:," width="2100" height="900" />' || string_agg(
replace('<circle @ fill="#ff7c87" fill-opacity="0.16" stroke="#fff4f4" stroke-width="4.50" /><circle @ fill="none" stroke="#ff7684" stroke-width="9.00" stroke-dasharray="10 7" />', '@', printf('cx="%.2f" cy="%.2f" r="%.2f"', n_nationkey * 11.0::DOUBLE, n_nationkey * 7.0::DOUBLE, n_nationkey + 25.0::DOUBLE)), '' ORDER BY n_nationkey) || '</svg>')) AS svg FROM nation GROUP BY n_regionkey""",
    "kml_payload": """SELECT n_regionkey AS site, '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>' || string_agg('<Placemark><name>' || n_name || '</name><Point><coordinates>' || printf('%.6f,%.6f,0', CAST(-7 - n_nationkey * 0.25 AS DOUBLE), CAST(30 + n_nationkey * 0.5 AS DOUBLE)) || '</coordinates></Point></Placemark>', '' ORDER BY n_nationkey) || '</Document></kml>' AS kml FROM nation GROUP BY n_regionkey""",
    "json_payload": """SELECT n_nationkey, '{"id":' || n_nationkey || ',"name":"' || n_name || '","region":{"key":' || n_regionkey || '}}' AS body FROM nation""",
}
