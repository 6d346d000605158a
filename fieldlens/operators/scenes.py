"""Coverage maps: from an image's pixels to sector points, measurement dots and red clusters.

An image is one row and is read by one numpy kernel; what comes out are long tables of points and dots,
and everything after them (directions, wedges, ratios, rules, verdicts) is relational.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import color
from fieldlens.sources.images import decode
from fieldlens.storage import stored

from . import angles

#: Windows and thresholds of the map analyses.
SITE_WINDOWS = ((0.45, 0.75, 0.10, 0.55), (0.05, 0.92, 0.05, 0.92))
COLOR_WINDOWS = ((0.35, 0.82, 0.10, 0.60), (0.05, 0.92, 0.05, 0.92))
SITE_PRIOR = (0.60, 0.32)
#: The largest map whose dots are judged where the dense analysis fails.
LOW_RES = (900, 450)
LEAST_POINTS, LEAST_PER_SECTOR, LEAST_DOTS = 300, 80, 6


def hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue, saturation and value planes, each from 0 to 1."""
    f = rgb.astype(np.float64) / 255
    high, low = f.max(2), f.min(2)
    span = high - low
    safe = np.where(span == 0, 1, span)
    r, g, b = f[..., 0], f[..., 1], f[..., 2]
    turn = np.where(high == r, ((g - b) / safe) % 6, np.where(high == g, (b - r) / safe + 2, (r - g) / safe + 4))
    return np.where(span == 0, 0, turn / 6 % 1), np.divide(span, high, out=np.zeros_like(span), where=high > 0), high


def lab(rgb: np.ndarray) -> dict[str, float]:
    """CIE Lab of one colour, by name; as color.lab has it for columns."""
    u = np.asarray(rgb, dtype=np.float64) / 255
    linear = np.where(u <= 0.04045, u / 12.92, ((u + 0.055) / 1.055) ** 2.4)
    # fixed values: the sRGB matrix and the D65 white point
    xyz = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]]) @ linear / (0.95047, 1.0, 1.08883)
    x, y, z = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116).tolist()
    return {"lab_l": 116 * y - 16, "lab_a": 500 * (x - y), "lab_b": 200 * (y - z)}


def density(mask: np.ndarray, radius: int) -> np.ndarray:
    """Pixels of the mask in the square around each pixel, cut at the borders."""
    h, w = mask.shape
    total = np.zeros((h + 1, w + 1), dtype=np.int64)
    total[1:, 1:] = mask.cumsum(0).cumsum(1)
    y0, y1 = np.clip(np.arange(h) - radius, 0, h), np.clip(np.arange(h) + radius + 1, 0, h)
    x0, x1 = np.clip(np.arange(w) - radius, 0, w), np.clip(np.arange(w) + radius + 1, 0, w)
    return total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]


def label(mask: np.ndarray) -> np.ndarray:
    """Numbers of the 8-connected components from 1, by rows; runs of a row are joined to those of the row before."""
    h, w = mask.shape
    out = np.zeros((h, w), dtype=np.int64)
    root = [0]

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    before: list[tuple[int, int, int]] = []
    for y in range(h):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        now = []
        k = 0
        for a, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            mine = 0
            while k < len(before) and before[k][1] < a:
                k += 1
            j = k
            while j < len(before) and before[j][0] <= e:
                other = find(before[j][2])
                if not mine:
                    mine = other
                elif other != mine:
                    mine, other = min(mine, other), max(mine, other)
                    root[other] = mine
                j += 1
            if not mine:
                mine = len(root)
                root.append(mine)
            now.append((a, e, mine))
            out[y, a:e] = mine
        before = now
    final = np.array([find(a) for a in range(len(root))])
    _, number = np.unique(final, return_inverse=True)
    return number[out]


def boxes(parts: np.ndarray) -> pd.DataFrame:
    """Area, box, span, fill and centre of each component."""
    ys, xs = np.nonzero(parts)
    df = pd.DataFrame({"comp": parts[ys, xs], "x": xs, "y": ys})
    g = df.groupby("comp").agg(area=("x", "size"), min_x=("x", "min"), max_x=("x", "max"), min_y=("y", "min"), max_y=("y", "max"), cx=("x", "mean"), cy=("y", "mean")).reset_index()
    g["width"], g["height"] = g.max_x - g.min_x + 1, g.max_y - g.min_y + 1
    g["fill"] = g.area / (g.width * g.height)
    return g


def colorful(rgb: np.ndarray, share_x: float = 0.22, share_y: float = 0.25) -> np.ndarray:
    _, s, v = hsv(rgb)
    mask = (s >= 0.50) & (v >= 0.35)
    mask[: int(rgb.shape[0] * share_y), : int(rgb.shape[1] * share_x)] = False
    return mask


def _turn(a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray:
    d = np.abs(a - b) % 1
    return np.minimum(d, 1 - d)


def _mean_angle(a: np.ndarray) -> float:
    t = np.radians(a)
    return math.degrees(math.atan2(np.sin(t).sum(), np.cos(t).sum())) % 360


def _angle(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    return np.degrees(np.arctan2(-dy, dx)) % 360


def _window(w: int, h: int, shares: tuple[float, float, float, float], xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    x0, x1, y0, y1 = shares
    return (xs >= int(w * x0)) & (xs < int(w * x1)) & (ys >= int(h * y0)) & (ys < int(h * y1))


def site_center(mask: np.ndarray) -> tuple[float, float] | None:
    """Where colour is densest, drawn towards where sites usually stand: the weighted mean of the best places."""
    h, w = mask.shape
    d = density(mask, 16)
    for window in SITE_WINDOWS:
        ys, xs = np.nonzero(mask & (d >= 35))
        inside = _window(w, h, window, xs, ys)
        ys, xs = ys[inside], xs[inside]
        if len(xs):
            away = np.hypot(xs - w * SITE_PRIOR[0], ys - h * SITE_PRIOR[1])
            score = d[ys, xs] - 2.5 * away
            order = np.lexsort((away, -score))
            order = order[score[order] >= 0.82 * score[order[0]]][:90]
            if not len(order):  # a score below zero has no share above it
                return None
            weight = np.maximum(score[order], 1)
            return float((weight * xs[order]).sum() / weight.sum()), float((weight * ys[order]).sum() / weight.sum())
    return None


def sector_hues(hue: np.ndarray, mask: np.ndarray, site: tuple[float, float], scale: float) -> list[float]:
    """Three hues that stand out, none within two bins of 36 of a stronger one; the higher bin of equals.

    First in the fan around the site, by density and nearness to its middle; if three aren't found, by
    count in the window where sites usually stand.
    """
    h, w = mask.shape
    ys, xs = np.nonzero(mask)
    grow = lambda v: max(v, round(v * scale))
    away = np.hypot(xs - site[0], ys - site[1])
    dense = density(mask, grow(5))[ys, xs]
    fan = (away >= grow(6)) & (away <= grow(36)) & (dense >= 22)
    window = _window(w, h, SITE_WINDOWS[0], xs, ys) & (density(mask, 7)[ys, xs] >= 15)
    for where, weight, least in ((fan, dense * np.maximum(0.2, 1 - np.abs(away - grow(18)) / grow(36)), 180), (window, np.ones(len(xs)), 30)):
        bins = (hue[ys, xs][where] * 36).astype(int) % 36
        total = np.bincount(bins, weights=weight[where], minlength=36)
        kept: list[int] = []
        for b in sorted(range(36), key=lambda b: (-total[b], -b)):
            if len(kept) < 3 and total[b] >= least and all(min((b - k) % 36, (k - b) % 36) > 2 for k in kept):
                kept.append(b)
        if len(kept) == 3:
            return [(b + 0.5) / 36 for b in kept]
    return []


def _site_by_color(hue: np.ndarray, mask: np.ndarray, hues: list[float], hint: tuple[float, float], outer: int) -> tuple[float, float]:
    """The mean of the three places where each hue comes nearest to the hint, if all three do."""
    h, w = mask.shape
    ys, xs = np.nonzero(mask)
    near = density(mask, 7)[ys, xs] >= 14
    away = (xs - hint[0]) ** 2 + (ys - hint[1]) ** 2
    for window in COLOR_WINDOWS:
        centers = []
        for t in hues:
            own = np.flatnonzero(near & _window(w, h, window, xs, ys) & (_turn(hue[ys, xs], t) < 0.06) & (away <= 2.25 * outer**2))
            own = own[np.argsort(away[own], kind="stable")][:40]
            if len(own):
                centers.append((xs[own].mean(), ys[own].mean()))
        if len(centers) == 3:
            return float(np.mean([c[0] for c in centers])), float(np.mean([c[1] for c in centers]))
    return hint


def point_like(shape: pd.DataFrame) -> pd.Series:
    return shape.area.between(5, 90) & (shape.width <= 14) & (shape.height <= 14) & (shape.fill >= 0.2)


def branch_like(shape: pd.DataFrame) -> pd.Series:
    return (shape.area >= 70) & (shape[["width", "height"]].max(axis=1) >= 18) & (shape.fill <= 0.45)


def near_site_ratio(shape: pd.DataFrame, radius: float = 60.0) -> float:
    """The share of components' area that comes within the radius of the site (nearest: each one's least distance)."""
    return float(shape.area[shape.nearest <= radius].sum() / shape.area.sum()) if len(shape) else 0.0


def _around(parts: np.ndarray, site: tuple[float, float]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shapes of the components with least distance and mean direction from the site; and y, x, component, direction of their pixels."""
    py, px = np.nonzero(parts > 0)
    comp, direction = parts[py, px], _angle(px - site[0], py - site[1])
    shape = boxes(parts).set_index("comp")
    pix = pd.DataFrame({"comp": comp, "d": np.hypot(px - site[0], py - site[1]), "s": np.sin(np.radians(direction)), "c": np.cos(np.radians(direction))})
    g = pix.groupby("comp")
    shape["nearest"] = g.d.min()
    shape["toward"] = np.degrees(np.arctan2(g.s.sum(), g.c.sum())) % 360
    return shape, py, px, comp, direction


def _degrees_apart(a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray:
    return _turn(np.asarray(a) / 360, np.asarray(b) / 360) * 360


class Unreadable(ValueError):
    """Why a map gives no sectors; the code is what other programs go by."""

    def __init__(self, code: str, reason: str) -> None:
        super().__init__(reason)
        self.code = code


def dense_sectors(rgb: np.ndarray) -> tuple[tuple[float, float], list[dict]]:
    """(site, sectors) of a map whose site is a dense fan of three colours.

    A sector has the angles of its points, its mean colour, the direction it is judged by, and that of
    its fan. Where a colour has too few dots, or its dots are far from its fan while a branch of it
    reaches the site, the parts that hang on the site stand in for them, and the fan's direction counts.
    """
    h, w = rgb.shape[:2]
    hue, _, _ = hsv(rgb)
    mask = colorful(rgb)
    scale = max(1.0, math.hypot(w, h) / 1000)
    grow = lambda v, least=1: max(least, round(v * scale))
    hint = site_center(mask)
    if hint is None:
        raise Unreadable("insufficient_site_center_density", "The serving-site center could not be estimated from the extracted image.")
    hues = sector_hues(hue, mask, hint, scale)
    if len(hues) < 3:
        raise Unreadable("insufficient_sector_colors", "The serving-sector colors could not be identified from the extracted image.")
    inner, outer = grow(6, 6), grow(36, 36)
    site = _site_by_color(hue, mask, hues, hint, outer)
    ys, xs = np.nonzero(mask)
    away, direction = np.hypot(xs - site[0], ys - site[1]), _angle(xs - site[0], ys - site[1])
    fan = (away >= inner) & (away <= max(inner + 1, outer - 6)) & (density(mask, grow(5, 5))[ys, xs] >= 22)
    prototypes, fans = [], []
    for t in hues:
        own = fan & (_turn(hue[ys, xs], t) * 360 <= 10)
        if not own.any():
            raise Unreadable("insufficient_sector_samples", "The serving-sector colors could not be sampled reliably from the site fan.")
        prototypes.append(np.floor(rgb[ys[own], xs[own]].astype(float).mean(0)))
        fans.append(_mean_angle(direction[own]))
    colors = np.array(prototypes)
    apart = np.linalg.norm(colors[:, None] - colors[None], axis=2) + np.eye(3) * 1e9
    turns = np.array([[_turn(a, b) * 360 for b in hues] for a in hues]) + np.eye(3) * 1e9
    rgb_cap, hue_cap = np.clip(0.42 * apart.min(1), 45, 80), np.clip(0.42 * turns.min(1), 8, 18)
    band = density(mask, 3)[ys, xs]
    use = np.flatnonzero((band >= 13) & (band <= 45) & (away >= 22))
    to_rgb = np.linalg.norm(rgb[ys[use], xs[use]][:, None].astype(float) - colors[None], axis=2)
    to_hue = np.stack([_turn(hue[ys[use], xs[use]], t) * 360 for t in hues], axis=1)
    best = np.argmin(to_rgb + to_hue * 1e-9, axis=1)
    row = np.arange(len(use))
    fits = (to_rgb[row, best] <= rgb_cap[best]) & (to_hue[row, best] <= hue_cap[best])
    out = []
    for k in range(3):
        plane = np.zeros((h, w), dtype=bool)
        own = use[fits & (best == k)]
        plane[ys[own], xs[own]] = True
        shape, py, px, comp, toward = _around(label(plane), site)
        dot = point_like(shape)
        keep = np.isin(comp, shape.index[dot])
        off = _degrees_apart(shape.toward, fans[k])
        attached = branch_like(shape) & (shape.nearest <= 40) & (off <= 60)
        few = keep.sum() < LEAST_PER_SECTOR
        if few or (_degrees_apart(_mean_angle(toward[keep]), fans[k]) > 50 and near_site_ratio(shape[dot]) <= 0.35 and attached.any()):
            close = dot & ((off <= 45) | ((shape.nearest <= 40) & (shape.area <= 40)))
            keep = np.isin(comp, shape.index[close | (attached & ~dot)])
            judged = fans[k]
        else:
            judged = _mean_angle(toward[keep])
        if keep.sum() < LEAST_PER_SECTOR:
            raise Unreadable("insufficient_sector_points", "The extracted image does not contain enough separated serving points for each sector.")
        mean = np.floor(rgb[py[keep], px[keep]].astype(float).mean(0)).astype(int)
        out.append({"angles": toward[keep], "rgb": mean, "direction": judged, "site_angle": fans[k], "counted": True, "shown": True})
    if sum(len(s["angles"]) for s in out) < LEAST_POINTS:
        raise Unreadable("insufficient_total_points", "The extracted image does not contain enough detected serving points to evaluate crossing.")
    return site, out


def low_res_site(mask: np.ndarray) -> tuple[float, float] | None:
    """The weighted mean of the 18 densest places within a tenth of the densest."""
    d = density(mask, 16)
    ys, xs = np.nonzero(mask & (d >= 35))
    if not len(xs):
        return None
    order = np.argsort(-d[ys, xs], kind="stable")
    order = order[d[ys, xs][order] >= 0.9 * d[ys, xs][order[0]]][:18]
    weight = d[ys, xs][order].astype(float)
    return float((weight * xs[order]).sum() / weight.sum()), float((weight * ys[order]).sum() / weight.sum())


def inner_bright(rgb: np.ndarray, b) -> float:
    """The share of bright pixels in the inner part of a component's box."""
    if b.width < 4 or b.height < 4:
        return 0.0
    dx, dy = max(1, b.width // 4), max(1, b.height // 4)
    inner = rgb[b.min_y + dy : b.max_y - dy + 1, b.min_x + dx : b.max_x - dx + 1]
    return float((inner >= 225).all(axis=2).mean()) if inner.size else 0.0


def largest_cluster(angles_: np.ndarray, gap: float = 40.0, least: int = 3) -> np.ndarray:
    """Which of the angles are in the largest cluster without a gap, around the circle; the widest of equals, then the first."""
    if len(angles_) <= least:
        return np.ones(len(angles_), dtype=bool)
    order = np.argsort(angles_, kind="stable")
    a = angles_[order]
    group = np.concatenate([[0], np.cumsum(_degrees_apart(a[1:], a[:-1]) > gap)])
    if group[-1] and a[0] + 360 - a[-1] <= gap:
        group[group == group[-1]] = 0
    best = max(np.unique(group), key=lambda g: ((group == g).sum(), a[group == g].max() - a[group == g].min(), -g))
    out = np.zeros(len(a), dtype=bool)
    out[order[group == best]] = True
    return out


def low_res_dots(rgb: np.ndarray, site: tuple[float, float], mask: np.ndarray) -> pd.DataFrame:
    """Round dots without a bright middle, away from the site: direction, colour and one of 12 bins of hue; yellows left out."""
    parts = label(mask)
    shape, *_ = _around(parts, site)
    shape = shape[point_like(shape) & (shape.fill >= 0.35) & ((shape.width - shape.height).abs() <= 4) & (shape.nearest > 25)]
    rows = []
    for b in shape.reset_index().itertuples():
        if inner_bright(rgb, b) > 0.22:
            continue
        box = parts[b.min_y : b.max_y + 1, b.min_x : b.max_x + 1] == b.comp
        mean = np.floor(rgb[b.min_y : b.max_y + 1, b.min_x : b.max_x + 1][box].astype(float).mean(0)).astype(np.uint8)
        t, s, v = (float(c[0, 0]) for c in hsv(mean.reshape(1, 1, 3)))
        if s < 0.50 or v < 0.35 or 20 <= t * 360 < 80:
            continue
        toward = float(_angle((b.min_x + b.max_x) / 2 - site[0], (b.min_y + b.max_y) / 2 - site[1]))
        rows.append((toward, *mean.tolist(), int((t * 360 + 15) % 360 // 30)))
    return pd.DataFrame(rows, columns=["angle", "r", "g", "b", "bin"])


def cross_swatches(rgb: np.ndarray) -> list[np.ndarray]:
    """Colours of the blocks in the legend's corner, each once."""
    h, w = rgb.shape[:2]
    corner = rgb[: int(h * 0.25), : int(w * 0.22)]
    _, s, v = hsv(corner)
    parts = label((s >= 0.50) & (v >= 0.35))
    kept: list[np.ndarray] = []
    for b in boxes(parts).itertuples():
        if 18 <= b.area <= 200 and b.width >= 4 and b.height >= 4 and b.fill >= 0.6:
            mean = np.floor(corner[parts == b.comp].astype(float).mean(0))
            if all(np.linalg.norm(mean - k) >= 35 for k in kept):
                kept.append(mean)
    return kept


def low_res_sectors(rgb: np.ndarray) -> tuple[tuple[float, float], list[dict]] | None:
    """(site, sectors) of a small map by its dots: up to three groups of like hue that lie together around the site.

    With two groups, the most counted other one is shown too, with the legend's colour that neither of
    the two explains, but is not judged.
    """
    h, w = rgb.shape[:2]
    mask = colorful(rgb)
    site = low_res_site(mask) if w <= LOW_RES[0] and h <= LOW_RES[1] else None
    if site is None:
        return None
    dots = low_res_dots(rgb, site, mask)
    groups = []
    for b, own in dots.groupby("bin", sort=False):
        part = own[largest_cluster(own.angle.to_numpy())]
        groups.append({"bin": b, "n": len(part), "all": len(own), "angles": part.angle.to_numpy(), "rgb": np.floor(part[["r", "g", "b"]].to_numpy(float).mean(0)).astype(int), "direction": _mean_angle(part.angle.to_numpy())})
    strong = sorted((g for g in groups if g["all"] >= 3 and g["n"] >= 3), key=lambda g: (-g["n"], g["direction"]))[:3]
    if len(strong) < 2:
        return None
    out = [{**g, "site_angle": g["direction"], "counted": True, "shown": True} for g in strong]
    if len(strong) < 3:
        rest = [g for g in groups if all(g["bin"] != s["bin"] for s in strong) and all(_degrees_apart(g["direction"], s["direction"]) >= 20 for s in strong)]
        if rest:
            g = max(rest, key=lambda g: g["n"])
            free = [c for c in cross_swatches(rgb) if all(np.linalg.norm(c - s["rgb"]) >= 60 for s in strong)]
            color = min(free, key=lambda c: np.linalg.norm(c - g["rgb"])).astype(int) if free else g["rgb"]
            out.append({**g, "rgb": color, "site_angle": g["direction"], "counted": False, "shown": True})
    return site, out


SECTORS = "image string, status string, reason string, mode string, width_px int, height_px int, site_x double, site_y double, sector int, direction double, site_angle double, r int, g int, b int, n int, counted boolean, angles array<double>"


def map_sectors(rgb: np.ndarray) -> list[dict]:
    """A row for each sector of a map, in the order of their directions; one row without a sector where the map gives none."""
    h, w = rgb.shape[:2]
    base = {"width_px": w, "height_px": h}
    try:
        (site, found), mode, status, reason = dense_sectors(rgb), "dense", "ok", None
    except Unreadable as e:
        low = low_res_sectors(rgb)
        if low is None:
            return [{**base, "status": e.code, "reason": str(e)}]
        (site, found), mode, status, reason = low, "low_res", "ok", e.code
    found = sorted(found, key=lambda s: s["direction"])
    return [{**base, "status": status, "reason": reason, "mode": mode, "site_x": site[0], "site_y": site[1], "sector": k, "direction": float(s["direction"]), "site_angle": float(s["site_angle"]), "r": int(s["rgb"][0]), "g": int(s["rgb"][1]), "b": int(s["rgb"][2]), "n": len(s["angles"]), "counted": s["counted"], "angles": [float(a) for a in s["angles"]]} for k, s in enumerate(found)]


def _kernel(schema: str, rows: Callable[[np.ndarray], list[dict]], broken: Callable[[str], list[dict]] | None = None):
    """Runs rows on each image; one that can't be read gives the rows that broken makes of the reason, or none."""
    names = [c.split()[0] for c in schema.split(", ")]
    whole = {"int": "Int32", "long": "Int64", "boolean": "boolean"}
    kinds = {c.split()[0]: whole[c.split()[1]] for c in schema.split(", ") if c.split()[1] in whole}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for image, content in zip(pdf.image, pdf.content, strict=True):
                try:
                    pixels = decode(content or b"")
                except ValueError as e:
                    got = broken(str(e)) if broken else []
                else:
                    got = rows(pixels)
                if got:
                    yield pd.DataFrame([{**dict.fromkeys(names), **r, "image": image} for r in got], columns=names).astype(kinds)

    return run


def sector_table(images: DataFrame) -> DataFrame:
    """A row for each sector of images (image, content), kept in the shared folder so that each image is read once.

    Images that can't be read, or that show no sectors, have one row with a status and no sector. Sectors
    count from 0 by direction; those that aren't counted are shown but not judged.
    """
    kernel = _kernel(SECTORS, map_sectors, lambda reason: [{"status": "unreadable_image", "reason": reason}])
    return stored(images.select("image", "content").mapInPandas(kernel, SECTORS), "sectors")


def sector_points(sectors: DataFrame) -> DataFrame:
    """(image, sector, angle, mode) of the points that are judged."""
    return sectors.where("counted").select("image", "sector", "mode", F.explode("angles").alias("angle"))


#: Share of misassigned points, of mixed bins and of intruding points from which a map is crossed.
LIMITS = {"dense": (angles.MISASSIGNED, angles.MIXED, angles.INTRUSION), "low_res": (0.35, 0.35, 0.35)}


def judged_sectors(sectors: DataFrame) -> DataFrame:
    """A row for each image of sector_table: status, mode, the ratios and the verdict; a warning of late handover takes a cross back.

    Small maps that only their dots could tell have limits of their own, no warnings, and count a dot as
    twelve points of confidence.
    """
    own = sectors.where("counted")
    directions = own.select("image", "sector", F.col("n").cast("long").alias("n"), "direction")
    points = sector_points(sectors)
    read = points.select("image", "sector", "angle")
    ratios = angles.cross_ratios(read, directions)
    dense = directions.join(own.where("mode = 'dense'").select("image").distinct(), "image", "left_semi")
    of_dense = read.join(dense.select("image").distinct(), "image", "left_semi")
    warned = angles.handover_warnings(angles.zone_matrix(of_dense, dense), dense, ratios.select("image", "misassigned", "mixed"), angles.intrusion_ratio(of_dense, dense))
    colors = own.select("image", "sector", color.sector_color_name(F.col("r"), F.col("g"), F.col("b")).alias("name"))
    named = warned.join(colors.withColumnsRenamed({"sector": "source", "name": "from_name"}), ["image", "source"], "left").join(colors.withColumnsRenamed({"sector": "target", "name": "to_name"}), ["image", "target"], "left")
    said = F.struct("source", "target", F.format_string("Possible late HO from %s sector to %s sector", "from_name", "to_name").alias("message"), "kind")
    kinds = named.groupBy("image").agg(F.sort_array(F.collect_list(said)).alias("details"))
    one = F.first(F.struct("status", "reason", "mode", "width_px", "height_px", "site_x", "site_y")).alias("s")
    full = sectors.groupBy("image").agg(one).select("image", "s.*").join(ratios, "image", "left").join(kinds, "image", "left")
    limit = lambda k: F.when(F.col("mode") == "low_res", LIMITS["low_res"][k]).otherwise(LIMITS["dense"][k])
    over = (F.col("misassigned") >= limit(0)) | (F.col("mixed") >= limit(1)) | (F.col("intrusion") >= limit(2))
    weight = F.when(F.col("mode") == "low_res", 12).otherwise(1)
    cross = over & F.col("details").isNull()
    full = full.withColumn("confidence", angles.confidence(F.col("points") * weight, F.col("least"), F.col("misassigned"), F.col("mixed"), F.col("intrusion"))).withColumn("cross", cross)
    empty = F.array().cast("array<struct<source:int,target:int,message:string,kind:string>>")
    return full.withColumn("details", F.coalesce("details", empty)).withColumn("warnings", F.transform("details", lambda d: d["message"])).withColumn("verdict", F.when(F.col("cross"), "Cross detected").when(F.col("cross").isNotNull(), "No cross detected"))


def cross_analysis(images: DataFrame) -> DataFrame:
    """The judged sectors of images (image, content): a row for each, with a status and no verdict where it can't be judged."""
    return judged_sectors(sector_table(images))


#: An ellipse of 5 x 5, as rows of a mask.
ELLIPSE = np.array([[0, 0, 1, 0, 0], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [0, 0, 1, 0, 0]], dtype=bool)


def _shifted(mask: np.ndarray, fill: bool) -> Iterator[np.ndarray]:
    h, w = mask.shape
    wide = np.full((h + 4, w + 4), fill)
    wide[2:-2, 2:-2] = mask
    return (wide[dy : dy + h, dx : dx + w] for dy, dx in zip(*np.nonzero(ELLIPSE), strict=True))


def opened(mask: np.ndarray) -> np.ndarray:
    """Erosion and dilation by the ellipse; what lies beyond the border counts for the erosion as on."""
    return np.logical_or.reduce(list(_shifted(np.logical_and.reduce(list(_shifted(mask, True))), False)))


#: Steps around a pixel, clockwise from the left.
AROUND = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]


def outline(part: np.ndarray) -> np.ndarray:
    """(y, x) along the outer border of one component, once around, clockwise."""
    wide = np.pad(part, 1)
    start = tuple(map(int, np.argwhere(wide)[0]))
    path, at, look = [start], start, 0
    first = None
    while True:
        for k in range(8):
            d = (look + k) % 8
            n = (at[0] + AROUND[d][0], at[1] + AROUND[d][1])
            if wide[n]:
                break
        else:
            return np.array(path) - 1
        if at == start and first == d:  # the first step comes again
            return np.array(path[:-1]) - 1
        if first is None:
            first = d
        look = (d + 6) % 8 if d % 2 == 0 else (d + 5) % 8
        at = n
        path.append(at)


def polygon(points: np.ndarray) -> tuple[float, float, float, float]:
    """(area, perimeter, centre x, centre y) of a closed outline."""
    y, x = points[:, 0].astype(float), points[:, 1].astype(float)
    x1, y1 = np.roll(x, -1), np.roll(y, -1)
    cross = x * y1 - x1 * y
    area = cross.sum() / 2
    length = float(np.hypot(x1 - x, y1 - y).sum())
    if area == 0:
        return 0.0, length, float(x.mean()), float(y.mean())
    return abs(area), length, float(((x + x1) * cross).sum() / (6 * area)), float(((y + y1) * cross).sum() / (6 * area))


def red_dots(rgb: np.ndarray) -> list[dict]:
    """Centres of red dots; a blot counts as one dot for each 300 of its area."""
    hue, s, v = hsv(rgb)
    half = np.rint(hue * 180)
    mask = ((half <= 8) | (half >= 172)) & (np.rint(s * 255) >= 150) & (np.rint(v * 255) >= 150)
    mask[: int(rgb.shape[0] * 0.30), : int(rgb.shape[1] * 0.22)] = False
    parts = label(opened(mask))
    out = []
    for b in boxes(parts).itertuples():
        area, length, cx, cy = polygon(outline(parts[b.min_y : b.max_y + 1, b.min_x : b.max_x + 1] == b.comp))
        if area < 20 or length == 0:
            continue
        if (4 * math.pi * area / length**2 < 0.3) if area <= 2000 else (area / (b.width * b.height) < 0.15):
            continue
        out += [{"x": int(cx + b.min_x), "y": int(cy + b.min_y)}] * max(1, int(area / 300))
    return out


COMPONENTS = "image string, status string, reason string, width_px int, height_px int, layer string, comp long, area long, min_x int, max_x int, min_y int, max_y int, width int, height int, cx double, cy double, fill_ratio double, r double, g double, b double, lab_l double, lab_a double, lab_b double, inner_bright double, solid_ratio double, white_gap double, inner_white long"


def components(rgb: np.ndarray) -> list[dict]:
    """A row for each component of the colourful mask, of the reddish one, and for each red dot, with what its pixels tell.

    solid_ratio and white_gap are shares of a disc in the middle of the box that the component fills, and
    that is white; inner_white counts the white pixels of a smaller disc.
    """
    h, w = rgb.shape[:2]
    base = {"status": "ok", "width_px": w, "height_px": h}
    _, s, v = hsv(rgb)
    f = rgb.astype(float)
    reddish = (s >= 0.35) & (v >= 0.30) & (f[..., 0] >= 1.05 * f[..., 1]) & (f[..., 0] >= 1.15 * f[..., 2])
    reddish[: int(h * 0.25), : int(w * 0.22)] = False
    out = [{**base, "layer": "image"}]
    for layer, mask in (("colorful", colorful(rgb)), ("reddish", reddish)):
        parts = label(mask)
        for b in boxes(parts).itertuples():
            if b.area < 18:
                continue
            own = parts[b.min_y : b.max_y + 1, b.min_x : b.max_x + 1] == b.comp
            px = f[b.min_y : b.max_y + 1, b.min_x : b.max_x + 1]
            mean = px[own].mean(0)
            yy, xx = np.indices(own.shape)
            away = np.hypot(xx + b.min_x - b.cx, yy + b.min_y - b.cy)
            disc = away <= max(2.5, min(b.width, b.height) * 0.24)
            core = away <= max(2.5, min(b.width, b.height) * 0.18)
            n = max(1, int(disc.sum()))
            out.append({
                **base, "layer": layer, "comp": int(b.comp), "area": int(b.area), "min_x": int(b.min_x), "max_x": int(b.max_x), "min_y": int(b.min_y), "max_y": int(b.max_y), "width": int(b.width), "height": int(b.height),
                "cx": b.cx, "cy": b.cy, "fill_ratio": b.fill, "r": mean[0], "g": mean[1], "b": mean[2], **lab(mean), "inner_bright": inner_bright(rgb, b), "solid_ratio": float((disc & own).sum() / n),
                "white_gap": float((disc & ~own & (px >= 220).all(axis=2)).sum() / n), "inner_white": int((core & ~own & (px >= 225).all(axis=2)).sum()),
            })
    out += [{**base, "layer": "red", "comp": k, "cx": float(d["x"]), "cy": float(d["y"])} for k, d in enumerate(red_dots(rgb))]
    return out


def component_table(images: DataFrame) -> DataFrame:
    """Components and red dots of images (image, content), kept in the shared folder so that each image is read once.

    Each image has one row of layer image, with its size and status; what can't be read has that row only.
    """
    kernel = _kernel(COMPONENTS, components, lambda reason: [{"status": "unreadable_image", "reason": reason, "layer": "image"}])
    return stored(images.select("image", "content").mapInPandas(kernel, COMPONENTS), "components")


def legend_swatches(rgb: np.ndarray) -> list[dict]:
    """Blocks of colour in the legend's corner from top to bottom; none unless there are three blocks."""
    h, w = rgb.shape[:2]
    corner = rgb[: int(h * 0.25), : min(int(w * 0.22), max(24, int(w * 0.08)))]
    hue, s, v = hsv(corner)
    parts = label((s >= 0.50) & (v >= 0.35))
    shape = boxes(parts)
    shape = shape[shape.area.between(20, 200) & shape.width.between(4, 16) & shape.height.between(4, 16)]
    if len(shape) < 3:
        return []
    out = []
    for b in shape.itertuples():
        whole = corner[parts == b.comp].astype(float).mean(0)
        mean = np.floor(whole).astype(np.uint8)
        mh, ms, mv = (float(p[0, 0]) for p in hsv(mean.reshape(1, 1, 3)))
        if ms >= 0.5 and mv >= 0.5:
            out.append({"center_y": (b.min_y + b.max_y) / 2, "r": int(mean[0]), "g": int(mean[1]), "b": int(mean[2]), "hue": mh * 360, **lab(whole)})
    return sorted(out, key=lambda x: x["center_y"])


SWATCHES = "image string, center_y double, r int, g int, b int, hue double, lab_l double, lab_a double, lab_b double, degraded boolean"


def read_legends(images: DataFrame) -> DataFrame:
    """The legend's swatches of each image; the lowest one is that of degraded values."""

    def rows(rgb: np.ndarray) -> list[dict]:
        found = legend_swatches(rgb)
        return [{**s, "degraded": k == len(found) - 1} for k, s in enumerate(found)]

    return images.select("image", "content").mapInPandas(_kernel(SWATCHES, rows), SWATCHES)


ROW_COLORS = "image string, row long, r int, g int, b int"


def row_colors(images: DataFrame, rows: DataFrame) -> DataFrame:
    """(image, row, r, g, b): the mean colour of the saturated pixels at the left of each legend row (image, row, y_center).

    y_center is a share of the legend's crop from its lower end. Rows without such pixels have no row here.
    """
    listed = images.join(rows.groupBy("image").agg(F.collect_list(F.struct("row", "y_center")).alias("rows")), "image").select("image", "content", "rows")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for image, content, wanted in zip(pdf.image, pdf.content, pdf.rows, strict=True):
                try:
                    rgb = decode(content or b"")
                except ValueError:
                    continue
                wide, high = max(1, int(rgb.shape[1] * 0.22)), max(1, int(rgb.shape[0] * 0.28))
                left = rgb[:high, : max(1, int(wide * 0.22))]
                _, s, v = hsv(left)
                out = []
                for row in wanted:
                    middle = int((1 - row["y_center"]) * high)
                    lines = slice(max(0, middle - 8), min(high, middle + 9))
                    px = left[lines][(s[lines] >= 0.50) & (v[lines] >= 0.35)]
                    if len(px):
                        out.append((image, int(row["row"]), *(px.astype(np.int64).sum(axis=0) // len(px)).tolist()))
                if out:
                    yield pd.DataFrame(out, columns=["image", "row", "r", "g", "b"]).astype({"row": "int64", "r": "int32", "g": "int32", "b": "int32"})

    return listed.mapInPandas(run, ROW_COLORS)
