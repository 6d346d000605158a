"""Points and grids: neighbours, densities, clusters, assignments."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import color, geo
from fieldlens.storage import stored, stored_with

from .graphs import star_components


def box_sum(cells: DataFrame, key: list[str], radius: int) -> DataFrame:
    """cells (x, y, m) with density: the sum of m in the square of that radius around each.

    Two range windows, one along each axis; a column sum at a place where no cell stands is not needed,
    because only rows of cells are summed along x first and looked up along y through their own column.
    """
    near = range(-radius, radius + 1)
    shifted = cells.select(*key, "x", "m", F.explode(F.array(*[F.lit(d) for d in near])).alias("d"), "y").withColumn("y", F.col("y") + F.col("d")).drop("d")
    columns = shifted.groupBy(*key, "y", "x").agg(F.sum("m").alias("m"))
    along = Window.partitionBy(*key, "y").orderBy("x").rangeBetween(-radius, radius)
    sums = columns.withColumn("density", F.sum("m").over(along)).drop("m")
    return cells.join(sums, [*key, "x", "y"])


def distance_pairs(points: DataFrame, key: list[str], reach: float) -> DataFrame:
    """(key, a, b, distance) of points at most reach apart, a < b; points meet within squares of the grid and those beside."""
    cell = lambda c: F.floor(F.col(c) / reach)
    left = points.select(*key, F.col("id").alias("a"), "x", "y", cell("x").alias("gx"), cell("y").alias("gy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    right = points.select(*key, F.col("id").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), cell("x").alias("cx"), cell("y").alias("cy"), around.alias("o"))
    right = right.select(*key, "b", "x2", "y2", (F.col("cx") + F.col("o.i")).alias("gx"), (F.col("cy") + F.col("o.j")).alias("gy"))
    d = F.sqrt((F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")))
    return left.join(right, [*key, "gx", "gy"]).where("a < b").withColumn("distance", d).where(F.col("distance") <= reach).select(*key, "a", "b", "distance")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable by edges (a, b); a node without an edge is its own component."""
    found = star_components(edges.select("a", "b"))
    return nodes.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("component"))


def nearest_distances(points: DataFrame, key: list[str], k: int = 1) -> DataFrame:
    """(key, a, b, distance, rank): each point's k nearest others; the lower id of equals.

    Points meet in squares of the grid, each with the eight around it. A square holds some 2 k points on
    average at first; a point whose k nearest aren't all within its square's width goes on to squares four
    times as wide, until a square is as wide as the group. Rounds grow with how uneven a group is, not
    with its points.
    """
    box = points.groupBy(*key).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("wide"))
    box = box.where("n > 1").withColumn("side", F.greatest(F.col("wide") / F.greatest(F.floor(F.sqrt(F.col("n") / (2 * k))), F.lit(1)), F.lit(1e-9)))
    all_ = stored(points.select(*key, "id", "x", "y").join(box, key), "points")
    left, found, times = all_, None, 1
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    while True:
        side = F.col("side") * times
        square = lambda c, o: F.floor((F.col(c) - F.col(o)) / side)
        a = left.select(*key, F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "n", "wide", side.alias("reach"), square("x", "x0").alias("gx"), square("y", "y0").alias("gy"))
        b = all_.select(*key, F.col("id").alias("b"), "x", "y", square("x", "x0").alias("cx"), square("y", "y0").alias("cy"), around.alias("o"))
        b = b.select(*key, "b", "x", "y", (F.col("cx") + F.col("o.i")).alias("gx"), (F.col("cy") + F.col("o.j")).alias("gy"))
        d = F.sqrt((F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("ay") - F.col("y")) * (F.col("ay") - F.col("y")))
        mine = Window.partitionBy(*key, "a")
        near = a.join(b, [*key, "gx", "gy"]).where("a <> b").withColumn("distance", d).withColumn("rank", F.row_number().over(mine.orderBy("distance", "b"))).where(F.col("rank") <= k)
        enough = (F.count("*").over(mine) == F.least(F.lit(k), F.col("n") - 1)) & (F.max("distance").over(mine) <= F.col("reach"))
        sure = stored(near.withColumn("sure", enough | (F.col("reach") >= F.col("wide"))).where("sure").select(*key, "a", "b", "distance", "rank"), "nearest")
        found = sure if found is None else found.unionByName(sure)
        settled = sure.select(*key, F.col("a").alias("id")).distinct()
        left, open_ = stored_with(left.join(settled, [*key, "id"], "left_anti"), "open", n=F.count("*"))
        if not open_["n"]:
            return found
        times *= 4


def mutual_neighbours(points: DataFrame, key: list[str], k: int = 3) -> DataFrame:
    """(key, a, b), a < b: points among each other's k nearest."""
    near = nearest_distances(points, key, k)
    back = near.select(*key, F.col("b").alias("a"), F.col("a").alias("b"))
    return near.where("a < b").join(back, [*key, "a", "b"], "left_semi").select(*key, "a", "b")


def link_distance(points: DataFrame, key: list[str], factor: float = 1.6, least: float = 18.0, most: float = 96.0) -> DataFrame:
    """(key, median_nearest, link): the median distance to the nearest point, scaled and clamped."""
    m = nearest_distances(points, key).groupBy(*key).agg(F.median("distance").alias("median_nearest"))
    return m.withColumn("link", F.least(F.lit(most), F.greatest(F.lit(least), factor * F.col("median_nearest"))))


def hull(p: np.ndarray) -> np.ndarray:
    """The corners of the points' convex hull: of each stretch of its border the two ends."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p
    out: list[np.ndarray] = []
    for side in (p, p[::-1]):
        part: list[np.ndarray] = []
        for q in side:
            while len(part) > 1 and (part[-1][0] - part[-2][0]) * (q[1] - part[-2][1]) - (part[-1][1] - part[-2][1]) * (q[0] - part[-2][0]) <= 0:
                part.pop()
            part.append(q)
        out += part[:-1]
    return np.array(out)


def extent(points: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, extent): the largest distance between two points of a group.

    Those two are corners of the convex hull: each task leaves the corners of the points at hand, and
    a group's few corners come together.
    """
    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*key).schema)

    def corners(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for own, part in pdf.groupby(key, dropna=False):
                c = hull(part[["x", "y"]].to_numpy(dtype=float))
                yield pd.DataFrame(c, columns=["x", "y"]).assign(**dict(zip(key, own, strict=True)))[[*key, "x", "y"]].astype({k: part[k].dtype for k in key})

    def widest(pdf: pd.DataFrame) -> pd.DataFrame:
        c = hull(pdf[["x", "y"]].to_numpy(dtype=float))
        far = max(float(np.sqrt(((c - q) ** 2).sum(axis=1)).max()) for q in c)
        return pdf[key].head(1).assign(extent=far)

    few = points.select(*key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInPandas(corners, f"{spec}, x double, y double")
    far = few.groupBy(*key).applyInPandas(widest, f"{spec}, extent double")
    return points.groupBy(*key).agg(F.count("*").alias("n")).join(far, key)


def gap_pairs(boxes: DataFrame, key: list[str], reach: float) -> DataFrame:
    """(key, a, b, gap) of boxes (id, min_x, max_x, min_y, max_y) at most reach apart, a < b.

    A box stands in every square of the grid that it touches when it is made reach wider, so that near
    boxes share a square; each pair is kept once.
    """
    touched = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - reach) / (4 * reach)), F.floor((F.col(hi) + reach) / (4 * reach))))
    dealt = boxes.select(*key, "id", "min_x", "max_x", "min_y", "max_y", touched("min_x", "max_x").alias("gx")).withColumn("gy", touched("min_y", "max_y"))
    left = dealt.withColumnRenamed("id", "a")
    right = dealt.select(*key, "gx", "gy", F.col("id").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("min_x", "max_x", "min_y", "max_y")])
    between = lambda lo, hi: F.greatest(F.lit(0.0), F.col(f"{lo}2") - F.col(hi), F.col(lo) - F.col(f"{hi}2"))
    gap = F.sqrt(F.pow(between("min_x", "max_x"), F.lit(2)) + F.pow(between("min_y", "max_y"), F.lit(2)))
    return left.join(right, [*key, "gx", "gy"]).where("a < b").withColumn("gap", gap).where(F.col("gap") <= reach).select(*key, "a", "b", "gap").distinct()


def shifted(points: DataFrame, dx: Column | float, dy: Column | float) -> DataFrame:
    """points (x, y) of a cut-out at their places in the whole image."""
    return points.withColumn("x", F.col("x") + dx).withColumn("y", F.col("y") + dy)


def cluster_quality(points: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, width, height, mean_y, cv_area, cv_nearest): evenness of a cluster's dots (x, y, area)."""
    near = nearest_distances(points, key).groupBy(*key).agg((F.stddev_pop("distance") / F.avg("distance")).alias("cv_nearest"))
    own = points.groupBy(*key).agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height"), F.avg("y").alias("mean_y"), (F.stddev_pop("area") / F.avg("area")).alias("cv_area"))
    return own.join(near, key, "left")


def median_of_largest(rows: DataFrame, key: list[str], value: str, order: list[Column], most: int = 10) -> DataFrame:
    """(key, dominant): the median of the most largest values."""
    top = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_k") <= most)
    return top.groupBy(*key).agg(F.median(value).alias("dominant"))


def weighted_centroid(rows: DataFrame, key: list[str], score: str, share: float, most: int, order: list[Column]) -> DataFrame:
    """(key, cx, cy, n): mean of the most best places within share of the best score, weighted by the score."""
    best = F.max(score).over(Window.partitionBy(*key))
    top = rows.withColumn("_best", best).where(F.col(score) >= share * F.col("_best"))
    top = top.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_k") <= most)
    w = F.greatest(F.col(score).cast("double"), F.lit(1.0))
    return top.groupBy(*key).agg((F.sum(w * F.col("x")) / F.sum(w)).alias("cx"), (F.sum(w * F.col("y")) / F.sum(w)).alias("cy"), F.count("*").alias("n"))


def nearest_prototype(pixels: DataFrame, prototypes: list[tuple[int, tuple[int, int, int]]]) -> DataFrame:
    """pixels with sector (that of the nearest prototype by colour, then hue; null beyond the caps) and rgb_distance.

    The caps adapt to how far the prototypes are from one another. A few prototypes: one expression.
    """

    def hue(rgb: tuple[int, int, int]) -> float:
        import colorsys

        return colorsys.rgb_to_hsv(*(c / 255 for c in rgb))[0]

    def apart(a: tuple[int, int, int], b: tuple[int, int, int]) -> float:
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5

    def turn(a: float, b: float) -> float:
        d = abs(a - b) % 1
        return min(d, 1 - d) * 360

    h, _, _ = color.hsv(F.col("r"), F.col("g"), F.col("b"))
    options = []
    for k, rgb in prototypes:
        others = [p for j, p in prototypes if j != k]
        rgb_cap = min(80.0, max(45.0, 0.42 * min((apart(rgb, o) for o in others), default=1e9)))
        hue_cap = min(18.0, max(8.0, 0.42 * min((turn(hue(rgb), hue(o)) for o in others), default=1e9)))
        d = color.distance((F.col("r"), F.col("g"), F.col("b")), tuple(F.lit(c) for c in rgb))
        t = color.circular_distance(F.col("_h"), F.lit(hue(rgb)), 1.0) * 360
        options.append(F.struct(d.alias("rgb"), t.alias("hue"), F.lit(k).alias("sector"), ((d <= rgb_cap) & (t <= hue_cap)).alias("ok")))
    rows = pixels.withColumn("_h", h).withColumn("_best", F.least(*options))
    return rows.withColumn("sector", F.when(F.col("_best.ok"), F.col("_best.sector"))).withColumn("rgb_distance", F.col("_best.rgb")).drop("_h", "_best")


def hue_histogram(pixels: DataFrame, key: list[str], bins: int = 36) -> DataFrame:
    """(key, bin, n) of the colourful pixels."""
    h, _, _ = color.hsv(F.col("r"), F.col("g"), F.col("b"))
    return pixels.where(color.is_colorful(F.col("r"), F.col("g"), F.col("b"))).groupBy(*key, (F.floor(h * bins) % bins).alias("bin")).agg(F.count("*").alias("n"))


def hue_peaks(histogram: DataFrame, key: list[str], most: int = 3, least: int = 180, apart: int = 2, bins: int = 36) -> DataFrame:
    """(key, peaks): up to most bins by count, higher bin first of equals, none within apart bins of one taken."""
    ranked = histogram.where(F.col("n") >= least).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("n", "bin")), asc=False).alias("all"))

    def take(kept: Column, s: Column) -> Column:
        near = F.exists(kept, lambda b: F.least(F.pmod(F.abs(b - s["bin"]), F.lit(bins)), bins - F.pmod(F.abs(b - s["bin"]), F.lit(bins))) <= apart)
        return F.when((F.size(kept) >= most) | near, kept).otherwise(F.array_append(kept, s["bin"]))

    return ranked.select(*key, F.aggregate("all", F.array().cast("array<bigint>"), take).alias("peaks"))


def merge_co_located(sites: DataFrame, base: str = "base", reach: float = 50.0) -> DataFrame:
    """sites (base, ord, lat, lng) with leader: the earliest site of the same base name that is under reach meters
    away and leads itself; cluster counts a base name's leaders from 0. A site joins the first leader near it;
    leaders don't chain. Base names have few sites.
    """

    def absorb(pdf: pd.DataFrame) -> pd.DataFrame:
        import math

        pdf = pdf.sort_values("ord").reset_index(drop=True)
        leads = [-1] * len(pdf)
        at = [(math.radians(a), math.radians(o)) for a, o in zip(pdf.lat, pdf.lng, strict=True)]
        for i in range(len(pdf)):
            if leads[i] >= 0:
                continue
            leads[i] = i
            for j in range(i + 1, len(pdf)):
                if leads[j] < 0:
                    (p, o), (q, u) = at[i], at[j]
                    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((u - o) / 2) ** 2
                    if 2 * geo.EARTH_M * math.atan2(math.sqrt(a), math.sqrt(1 - a)) < reach:
                        leads[j] = i
        number = {k: n for n, k in enumerate(sorted(set(leads)))}
        return pdf.assign(leader=[int(pdf.ord[k]) for k in leads], cluster=[number[k] for k in leads])

    return sites.select(base, "ord", "lat", "lng").groupBy(base).applyInPandas(absorb, f"{base} string, ord long, lat double, lng double, leader long, cluster int")


def cheapest(costs: list[list[Fraction]]) -> list[int]:
    """The column of each row that makes the least total, by shortest augmenting paths; there are as many columns as rows at least."""
    n, m = len(costs), len(costs[0])
    u, v, match = [Fraction(0)] * (n + 1), [Fraction(0)] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j = i, 0
        best: list[Fraction | None] = [None] * (m + 1)
        way, used = [0] * (m + 1), [False] * (m + 1)
        while match[j]:
            used[j] = True
            row, step, to = match[j], None, 0
            for k in range(1, m + 1):
                if not used[k]:
                    reduced = costs[row - 1][k - 1] - u[row] - v[k]
                    if best[k] is None or reduced < best[k]:
                        best[k], way[k] = reduced, j
                    if step is None or best[k] < step:
                        step, to = best[k], k
            for k in range(m + 1):
                if used[k]:
                    u[match[k]] += step
                    v[k] -= step
                elif best[k] is not None:
                    best[k] -= step
            j = to
        while j:
            match[j], j = match[way[j]], way[j]
    out = [0] * n
    for k in range(1, m + 1):
        if match[k]:
            out[match[k] - 1] = k - 1
    return out


def assign_rows(costs: DataFrame, key: list[str]) -> DataFrame:
    """(key, row, name, cost): the assignment of rows to names with the least total cost, the first of equals by names.

    costs has (key, row, name, cost) for pairs of a key; a missing pair costs as much as all others
    together. With fewer names than rows the first rows get one.
    """
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in costs.select(*key).schema)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, names = sorted(pdf.row.unique()), sorted(pdf.name.unique())
        rows = rows[: min(len(rows), len(names))]
        price = {(r, n): Fraction(float(c)) for r, n, c in zip(pdf.row, pdf.name, pdf.cost, strict=True)}
        missing = sum(map(abs, price.values())) + 1
        # among equal totals the first names in the order of the rows win: a row's place weighs less than any difference of totals
        scale = max((p.denominator for p in price.values()), default=1)
        base = len(names) + 1
        exact = [[price.get((r, n), missing) * scale * base ** len(rows) + j * base ** (len(rows) - 1 - i) for j, n in enumerate(names)] for i, r in enumerate(rows)]
        chosen = [names[j] for j in cheapest(exact)]
        out = pd.DataFrame({"row": rows, "name": chosen})
        for k in key:
            out[k] = pdf[k].iloc[0]
        out["cost"] = [float(price.get((r, n), missing)) for r, n in zip(rows, chosen, strict=True)]
        return out[[*key, "row", "name", "cost"]]

    return costs.groupBy(*key).applyInPandas(solve, f"{types}, row long, name string, cost double")


def image_components(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """8-connected components of mask pixels (key, x, y): key, comp, x, y with comp numbered from the first pixel by rows.

    One image is one group: labels fall from pixel to neighbour in numpy until none changes.
    """

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf.x.to_numpy(), pdf.y.to_numpy()
        if not len(x):
            return pdf.assign(comp=[])[[key, "comp", "x", "y"]]
        x0, y0 = x.min() - 1, y.min() - 1
        grid = np.full((y.max() - y0 + 2, x.max() - x0 + 2), -1, dtype=np.int64)
        order = np.lexsort((x, y))
        grid[y[order] - y0, x[order] - x0] = np.arange(len(x))
        on = grid >= 0
        while True:
            before = grid.copy()
            big = np.where(on, grid, np.iinfo(np.int64).max)
            for axis in (0, 1):
                fwd = np.minimum(big, np.roll(big, 1, axis))
                big = np.where(on, np.minimum(fwd, np.roll(big, -1, axis)), np.iinfo(np.int64).max)
            for dy, dx in ((1, 1), (1, -1), (-1, 1), (-1, -1)):
                big = np.where(on, np.minimum(big, np.roll(np.where(on, big, np.iinfo(np.int64).max), (dy, dx), (0, 1))), np.iinfo(np.int64).max)
            flat = np.where(on, big, -1)
            labels = flat[y[order] - y0, x[order] - x0]
            labels = np.minimum(labels, labels[labels])  # the label of one's label
            grid[y[order] - y0, x[order] - x0] = labels
            if (grid == before).all():
                break
        found = grid[y - y0, x - x0]
        _, comp = np.unique(found, return_inverse=True)
        return pd.DataFrame({key: pdf[key], "comp": comp.astype("int64"), "x": pdf.x, "y": pdf.y})

    kind = pixels.schema[key].dataType.simpleString()
    return pixels.select(key, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).groupBy(key).applyInPandas(label, f"{key} {kind}, comp long, x long, y long")


def component_stats(parts: DataFrame, key: list[str]) -> DataFrame:
    """Area, box, centre, span and fill of each component of pixels (key, comp, x, y)."""
    s = parts.groupBy(*key, "comp").agg(F.count("*").alias("area"), *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")], F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    s = s.withColumn("width", F.col("max_x") - F.col("min_x") + 1).withColumn("height", F.col("max_y") - F.col("min_y") + 1)
    return s.withColumn("fill_ratio", F.col("area") / (F.col("width") * F.col("height")))


def is_point_like() -> Column:
    return F.col("area").between(5, 90) & (F.col("width") <= 14) & (F.col("height") <= 14) & (F.col("fill_ratio") >= 0.2)


def is_branch_like() -> Column:
    return (F.col("area") >= 70) & (F.greatest("width", "height") >= 18) & (F.col("fill_ratio") <= 0.45)


def is_measurement_dot() -> Column:
    aspect = F.col("width") / F.col("height")
    return F.col("area").between(20, 2200) & F.col("width").between(5, 48) & F.col("height").between(5, 48) & (F.col("fill_ratio") >= 0.28) & aspect.between(0.45, 2.2)


def linked(p: np.ndarray, reach: float) -> np.ndarray:
    """For each point, the first point that it hangs together with by steps of at most reach; points meet in squares of the grid."""
    squares: dict[tuple[int, int], list[int]] = {}
    for i, at in enumerate(map(tuple, np.floor(p / reach).astype(int).tolist())):
        squares.setdefault(at, []).append(i)
    up = list(range(len(p)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for (x, y), own in squares.items():
        for other in (squares.get((x + i, y + j)) for i, j in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))):
            if other:
                near = ((p[own][:, None] - p[other][None]) ** 2).sum(axis=2) <= reach * reach
                for a, b in zip(*np.nonzero(near), strict=True):
                    i, j = top(own[a]), top(other[b])
                    up[max(i, j)] = min(i, j)
    return np.array([top(i) for i in range(len(p))], dtype=np.int64)


def linked_points(points: DataFrame, key: list[str]) -> DataFrame:
    """(key, id, cluster): points (id, x, y, reach) of a group that fits a task, in clusters named by their smallest id."""
    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*key).schema)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        found = linked(pdf[["x", "y"]].to_numpy(dtype=float), float(pdf.reach.iloc[0]))
        return pdf[[*key, "id"]].assign(cluster=pdf.id.to_numpy()[found])

    return points.select(*key, "id", "x", "y", "reach").groupBy(*key).applyInPandas(link, f"{spec}, id long, cluster long")


def red_clusters(dots: DataFrame, key: list[str], width: str = "width_px", height: str = "height_px", share: float = 0.08, least: int = 5, least_extent: float = 12.0) -> DataFrame:
    """Red clusters of an image's dots (key, id, x, y, image size): groups linked within share of the image's longer side.

    (key, component, n, extent, total_area, min_x, mid_y, cx, cy, radius) of groups with least dots and
    a box whose longer side is least_extent.
    """
    reach = share * F.greatest(F.col(width), F.col(height))
    full = dots.join(linked_points(dots.withColumn("reach", reach), key).withColumnRenamed("cluster", "component"), [*key, "id"])
    wide, high = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    mid = lambda c: (F.min(c) + F.max(c)) / 2
    box = full.groupBy(*key, "component").agg(F.count("*").alias("n"), F.greatest(wide, high).alias("extent"), F.floor(wide * high).alias("total_area"), F.min("x").alias("min_x"), mid("y").alias("mid_y"), F.floor(mid("x")).cast("int").alias("cx"), F.floor(mid("y")).cast("int").alias("cy"))
    return box.where((F.col("n") >= least) & (F.col("extent") >= least_extent)).withColumn("radius", F.floor(F.col("extent") / 2).cast("int") + 25)
