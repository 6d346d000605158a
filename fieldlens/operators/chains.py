"""Dots of one image as a graph: chains along a route, loops, dense cores, rows of text.

Each image (or cluster) is a group that fits a task; what a group gives is a long table again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _distances(pdf: pd.DataFrame) -> np.ndarray:
    p = pdf[["x", "y"]].to_numpy(dtype=float)
    return np.linalg.norm(p[:, None] - p[None], axis=2)


def _per_group(rows: DataFrame, key: list[str], extra: str, f: Callable[[pd.DataFrame], pd.DataFrame], more: tuple[str, ...] = ()) -> DataFrame:
    kinds = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in rows.select(*key).schema)
    names = [c.split()[0] for c in extra.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf.sort_values("id").reset_index(drop=True))
        for k in key:
            out[k] = pdf[k].iloc[0]
        return out[[*key, *names]]

    return rows.select(*key, "id", "x", "y", *more).groupBy(*key).applyInPandas(run, f"{kinds}, {extra}")


def mutual_graph(d: np.ndarray, reach: float, k: int = 3) -> list[set[int]]:
    """Neighbours within reach that are among each other's k nearest."""
    n = len(d)
    near = []
    for i in range(n):
        order = sorted((j for j in range(n) if j != i and d[i, j] <= reach), key=lambda j: (d[i, j], j))
        near.append(set(order[:k]))
    return [{j for j in near[i] if i in near[j]} for i in range(n)]


def _bend(p: np.ndarray, a: int, at: int, b: int) -> float:
    """Angle at a point between two others, in degrees."""
    u, v = p[a] - p[at], p[b] - p[at]
    lu, lv = np.linalg.norm(u), np.linalg.norm(v)
    return 0.0 if lu == 0 or lv == 0 else math.degrees(math.acos(max(-1.0, min(1.0, float(u @ v) / (lu * lv)))))


def two_neighbours(p: np.ndarray, graph: list[set[int]], least_angle: float = 140.0) -> list[set[int]]:
    """A graph where no dot has more than two neighbours: the straightest pair of least_angle, else the nearest one."""
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    want = []
    for i, near in enumerate(graph):
        if len(near) <= 1:
            want.append(set(near))
            continue
        pairs = [(a, b) for a in sorted(near) for b in sorted(near) if a < b and _bend(p, a, i, b) >= least_angle]
        want.append(set(max(pairs, key=lambda ab: (_bend(p, ab[0], i, ab[1]), -d[i, ab[0]] - d[i, ab[1]]))) if pairs else {min(near, key=lambda j: (d[i, j], j))})
    return [{j for j in want[i] if i in want[j]} for i in range(len(graph))]


def ordered(p: np.ndarray, graph: list[set[int]]) -> list[list[int]]:
    """The paths of a graph of degree two at most, each from its end with the smaller x, then y; rings from their first dot."""
    left, out = set(range(len(graph))), []
    starts = sorted((i for i in left if len(graph[i]) <= 1), key=lambda i: (p[i][0], p[i][1], i)) + sorted(left)
    for s in starts:
        if s not in left:
            continue
        path = [s]
        left.discard(s)
        while True:
            ahead = sorted(j for j in graph[path[-1]] if j in left)
            if not ahead:
                break
            path.append(ahead[0])
            left.discard(ahead[0])
        out.append(path)
    return out


def _outward(p: np.ndarray, chain: list[int]) -> np.ndarray:
    """Direction in which a chain leaves its last dot."""
    if len(chain) < 2:
        return np.zeros(2)
    v = p[chain[-1]] - p[chain[-2]]
    n = np.linalg.norm(v)
    return v / n if n else v


def merged(p: np.ndarray, chains: list[list[int]], link: float) -> list[list[int]]:
    """Chains joined end to end, the best fit first, while ends are near and point at each other."""
    most = min(210.0, max(1.75 * link, link + 32))
    chains = [list(c) for c in chains]
    while True:
        best = None
        for i in range(len(chains)):
            for j in range(i + 1, len(chains)):
                for a in (chains[i], chains[i][::-1]):
                    for b in (chains[j], chains[j][::-1]):
                        gap = p[b[0]] - p[a[-1]]
                        bridge = float(np.linalg.norm(gap))
                        if bridge > most or bridge == 0:
                            continue
                        unit = gap / bridge
                        fit_a = float(_outward(p, a) @ unit) if len(a) > 1 else 1.0
                        fit_b = float(_outward(p, b[::-1]) @ -unit) if len(b) > 1 else 1.0
                        low = min(fit_a, fit_b)
                        if low < 0.3 or (bridge > 0.7 * most and low < 0.6):
                            continue
                        score = 10 * low + min(fit_a, 1) + min(fit_b, 1) + (len(a) + len(b)) / 100 - bridge / most
                        if best is None or score > best[0]:
                            best = (score, i, j, a + b)
        if best is None:
            return chains
        chains = [c for k, c in enumerate(chains) if k not in best[1:3]] + [best[3]]


def dot_chains(dots: DataFrame, key: list[str], factor: float = 1.85, least: float = 18.0, most: float = 120.0) -> DataFrame:
    """(key, id, chain, pos): dots (key, id, x, y) ordered along their routes; chains count from the longest."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y"]].to_numpy(dtype=float)
        if len(p) == 1:
            return pd.DataFrame({"id": pdf.id, "chain": [0], "pos": [0]})
        d = _distances(pdf)
        link = min(most, max(least, factor * float(np.median((d + np.eye(len(d)) * 1e18).min(1)))))
        chains = merged(p, ordered(p, two_neighbours(p, mutual_graph(d, link))), link)
        chains.sort(key=lambda c: (-len(c), c[0]))
        return pd.DataFrame([(pdf.id[i], k, n) for k, c in enumerate(chains) for n, i in enumerate(c)], columns=["id", "chain", "pos"])

    return _per_group(dots, key, "id long, chain int, pos int", build)


def flagged_runs(dots: DataFrame, key: list[str], least: int = 6, factor: float = 1.85, nearest: float = 18.0, most: float = 120.0) -> DataFrame:
    """(key, run, id, pos): runs of flagged dots (key, id, x, y, flag) along the chains of all dots.

    Runs whose ends meet are joined end to end like chains; those of fewer than least dots go. Runs count
    from the longest.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y"]].to_numpy(dtype=float)
        link = nearest
        whole: list[list[int]] = [[0]]
        if len(p) > 1:
            d = _distances(pdf)
            link = min(most, max(nearest, factor * float(np.median((d + np.eye(len(d)) * 1e18).min(1)))))
            whole = merged(p, ordered(p, two_neighbours(p, mutual_graph(d, link))), link)
        flag = pdf.flag.to_numpy()
        runs: list[list[int]] = []
        for chain in whole:
            run: list[int] = []
            for i in [*chain, -1]:
                if i >= 0 and flag[i]:
                    run.append(i)
                elif run:
                    runs.append(run)
                    run = []
        long = sorted((r for r in merged(p, runs, link) if len(r) >= least), key=lambda r: (-len(r), r[0]))
        return pd.DataFrame([(k, pdf.id[i], n) for k, r in enumerate(long) for n, i in enumerate(r)], columns=["run", "id", "pos"]).astype({"run": "int32", "id": "int64", "pos": "int32"})

    return _per_group(dots, key, "run int, id long, pos int", build, ("flag",))


def loop_core(dots: DataFrame, key: list[str], reach: float, least: int = 6) -> DataFrame:
    """(key, id): a route without its loose ends: dots with fewer than two neighbours within reach go, again and again, while
    least are left. Clusters with fewer than two dots more than that stay whole.
    """

    def prune(pdf: pd.DataFrame) -> pd.DataFrame:
        live = np.ones(len(pdf), dtype=bool)
        if len(pdf) >= least + 2:
            near = (_distances(pdf) <= reach) & ~np.eye(len(pdf), dtype=bool)
            while (spare := int(live.sum()) - least) > 0:
                ends = np.flatnonzero(live & ((near & live).sum(1) < 2))[:spare]
                if not len(ends):
                    break
                live[ends] = False
        return pd.DataFrame({"id": pdf.id[live]})

    return _per_group(dots, key, "id long", prune)


def dense_core(dots: DataFrame, key: list[str], k: int = 3, spread: float = 1.22, least: int = 6) -> DataFrame:
    """(key, id): a cluster without its loose dots: those whose mean distance to the k nearest is over spread times the
    median, the loosest first, a sixth of all at most (but one) and three. Clusters with fewer than three dots
    more than least stay whole.
    """

    def trim(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        if n < least + 3:
            return pdf[["id"]]
        d = np.sort(_distances(pdf) + np.eye(n) * 1e18, axis=1)[:, :k].mean(1)
        loose = [i for i in np.lexsort((-np.arange(n), -d)) if d[i] > spread * np.median(d)][: min(3, max(1, n // 6))]
        return pdf[["id"]].drop(index=loose)

    return _per_group(dots, key, "id long", trim)


def annotation_circle(dots: DataFrame, key: list[str]) -> DataFrame:
    """(key, cx, cy, radius): the circle about the mean of a cluster's dots (x, y, width, height) that holds them, with a margin."""
    middle = dots.groupBy(*key).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    reach = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))) + F.greatest("width", "height") * 0.6
    return dots.join(middle, key).groupBy(*key, "cx", "cy").agg(F.greatest(F.lit(18.0), F.max(reach) + 14).alias("radius"))


def row_groups(dots: DataFrame, key: list[str], tolerance: float = 5.0) -> DataFrame:
    """(key, id, row): rows of dots from top to bottom; a dot joins the first row whose mean height is within tolerance."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.y.to_numpy(dtype=float)
        rows: list[list[int]] = []
        for i in np.argsort(y, kind="stable").tolist():
            home = next((r for r in rows if abs(y[i] - y[r].mean()) <= tolerance), None)
            if home is None:
                rows.append([i])
            else:
                home.append(i)
        return pd.DataFrame([(pdf.id[i], k) for k, r in enumerate(rows) for i in r], columns=["id", "row"])

    return _per_group(dots, key, "id long, row int", group)


def text_like(dots: DataFrame, key: list[str]) -> DataFrame:
    """(key, text_like): clusters that look like a label: two flat rows of dots, close above one another.

    The height of a cluster is that of its dots' pixels (min_y, max_y) where they are told, else of their centres.
    """
    rows = dots.join(row_groups(dots, key), [*key, "id"])
    off = F.greatest(F.max("y") - F.avg("y"), F.avg("y") - F.min("y"))
    per = rows.groupBy(*key, "row").agg(F.count("*").alias("n"), F.avg("y").alias("y"), off.alias("spread"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    agg = per.groupBy(*key).agg(F.sum("n").alias("dots"), F.count("*").alias("rows"), F.min("n").alias("least"), F.max("spread").alias("spread"), (F.max("y") - F.min("y")).alias("gap"), (F.min("x1") - F.max("x0")).alias("overlap"), F.min(F.col("x1") - F.col("x0")).alias("narrow"))
    height = F.max("max_y") - F.min("min_y") + 1 if {"min_y", "max_y"} <= set(dots.columns) else F.max("y") - F.min("y")
    tall = dots.groupBy(*key).agg(height.alias("height"))
    ok = (F.col("dots") >= 6) & (F.col("height") <= 32) & (F.col("rows") == 2) & (F.col("least") >= 2) & F.col("gap").between(8, 24) & (F.col("spread") <= 4) & (F.col("narrow") > 0) & (F.col("overlap") >= 0.45 * F.col("narrow"))
    return agg.join(tall, key).select(*key, ok.alias("text_like"))


def hotspots(dots: DataFrame, key: list[str], padding: float = 18.0) -> DataFrame:
    """(key, cx, cy, radius): the circle about the middle of a cluster's box that holds it, with padding."""
    box = dots.groupBy(*key).agg(((F.min("x") + F.max("x")) / 2).alias("cx"), ((F.min("y") + F.max("y")) / 2).alias("cy"))
    far = F.max(F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))))
    return dots.join(box, key).groupBy(*key, "cx", "cy").agg(far.alias("far")).select(*key, "cx", "cy", F.greatest(F.lit(padding), F.col("far") + padding).alias("radius"))


def route_score(quality: DataFrame, width: Column, height: Column, hue: Column, symbols: Column) -> DataFrame:
    """Clusters of shapes.cluster_quality with the score of a route laid over the map; null where it can't be one."""
    score = 8 * F.col("n") + F.least("width", "height") / 25 - 1.8 * hue - 2 * F.col("cv_area") - 2 * F.col("cv_nearest") - 10 * symbols
    no = (F.col("cv_area") > 2) | (F.col("cv_nearest") > 1.1) | (symbols > 0.2) | (F.col("width") < 120) | (F.col("height") < 80) | (F.col("mean_y") < 0.45 * height) | (hue > 30) | (width <= 0)
    return quality.withColumn("route_score", F.when(~no, score))
