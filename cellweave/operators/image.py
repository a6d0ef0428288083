"""Raster operators whose result depends on order or needs a convolution; sequential ones run per tile."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import expand_labels, offsets, spread

#: Overlap below which a later object is added, and its least size in pixels.
OVERLAP, LEAST = 0.15, 15
#: Optical density per channel (red, green, blue) of the two stains, and their residual: fixed values.
STAINS = ((0.6500286, 0.7041680, 0.2860126), (0.0728940, 0.9904310, 0.1155140), (0.2688350, 0.5706770, 0.7768750))


class Segmenter(Protocol):
    """A pretrained network that labels an image tile; models plug in here."""

    def segment(self, tile: np.ndarray) -> np.ndarray:
        """Integer labels, 0 for background."""


def shift_rings(polygons: DataFrame, dx: float | Column, dy: float | Column) -> DataFrame:
    """Rings moved by numbers, or by columns of the polygon's row: a local ring to its cell's place, one sum a coordinate."""
    return polygons.withColumn("ring", F.transform("ring", lambda p: F.array(F.get(p, F.lit(0)) + dx, F.get(p, F.lit(1)) + dy)))


def owned_by_tile(points: DataFrame, size: float) -> DataFrame:
    """Points with the nominal half-open tile that owns them."""
    return points.withColumns({"tx": F.floor(F.col("x") / size), "ty": F.floor(F.col("y") / size)})


def fill_polygons(polygons: DataFrame) -> DataFrame:
    """``row, col, cell_id`` of the pixels inside the rings of ``polygons(cell_id, ord, ring)``, vertices rounded; a later polygon overwrites."""

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for cell, order, ring in zip(f["cell_id"], f["ord"], f["ring"], strict=True):
                v = np.rint(np.array([np.asarray(p, float) for p in ring])).astype(int)
                x, y = v[:, 0], v[:, 1]
                nx, ny = np.roll(x, -1), np.roll(y, -1)
                rows, cols = np.mgrid[y.min() : y.max() + 1, x.min() : x.max() + 1]
                inside, edge = np.zeros(rows.shape, bool), np.zeros(rows.shape, bool)
                for a, b, c, d in zip(x, y, nx, ny, strict=True):
                    if b != d:
                        cross = ((b > rows) != (d > rows)) & (cols < (c - a) * (rows - b) / (d - b) + a)
                        inside ^= cross
                    n = max(abs(c - a), abs(d - b), 1)  # the outline belongs to the polygon
                    edge[np.rint(np.linspace(b, d, n + 1)).astype(int) - y.min(), np.rint(np.linspace(a, c, n + 1)).astype(int) - x.min()] = True
                inside |= edge
                out.append(pd.DataFrame({"row": rows[inside], "col": cols[inside], "cell_id": cell, "ord": order}))
            if out:
                yield pd.concat(out)

    px = polygons.select("cell_id", "ord", "ring").mapInPandas(fill, "row int, col int, cell_id long, ord long")
    return px.groupBy("row", "col").agg(F.max_by("cell_id", F.struct("ord", "cell_id")).alias("cell_id"))


def merge_masks(labels: DataFrame) -> DataFrame:
    """``tile, row, col, cell_id``: masks of several runs ``(tile, row, col, cell_id, run)`` merged, first come first kept.

    An object of a later run is added if less than OVERLAP of it is taken and LEAST pixels of it are free; it gets the
    free pixels.  The order is run, then label; tiles are independent.
    """

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        taken: dict[tuple[int, int], int] = {}
        n = 0
        for (run, _), g in f.sort_values(["run", "cell_id", "row", "col"]).groupby(["run", "cell_id"], sort=True):
            px = list(zip(g["row"].tolist(), g["col"].tolist(), strict=True))
            free = [p for p in px if p not in taken]
            if run == f["run"].min() or ((len(px) - len(free)) / len(px) < OVERLAP and len(free) >= LEAST):
                n += 1
                taken.update(dict.fromkeys(free, n))
        return pd.DataFrame([(f["tile"].iloc[0], r, c, k) for (r, c), k in taken.items()], columns=["tile", "row", "col", "cell_id"])

    return labels.groupBy("tile").applyInPandas(merge, "tile int, row int, col int, cell_id long")


def stitch(tiles: DataFrame) -> DataFrame:
    """``row, col, cell_id`` with ids that are one across seams, from ``(trow, tcol, row, col, cell_id)``.

    Labels of a tile are first made distinct between tiles.  A label of a tile takes the id of the label above its
    first row that it touches, else left of its first column; the first touching pixel decides.
    """
    t = tiles.withColumn("own", F.struct("trow", "tcol", "cell_id"))
    there = t.select((F.col("row") + 1).alias("row"), "col", F.col("own").alias("up"), F.col("trow").alias("utr"))
    left = t.select("row", (F.col("col") + 1).alias("col"), F.col("own").alias("lf"), F.col("tcol").alias("ltc"))
    above = t.join(there, ["row", "col"]).where("utr < trow").groupBy("own").agg(F.min_by("up", F.struct("row", "col")).alias("to"))
    beside = t.join(left, ["row", "col"]).where("ltc < tcol").groupBy("own").agg(F.min_by("lf", F.struct("row", "col")).alias("to2"))
    labels = t.select("own").distinct().join(above, "own", "left").join(beside, "own", "left").select("own", F.coalesce("to", "to2").alias("to"))
    step = labels
    while True:  # follow links to their ends; each goes to a tile above or left, so they end
        nxt = step.join(labels.select(F.col("own").alias("to"), F.col("to").alias("further")), "to", "left").select("own", F.coalesce("further", "to").alias("to"))
        nxt = nxt.checkpoint() if nxt.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else nxt.cache()
        if nxt.exceptAll(step).isEmpty():
            break
        step = nxt
    name = step.select("own", F.coalesce("to", "own").alias("root"))
    return t.join(name, "own").select("row", "col", (F.col("root.trow") * 100_000_000 + F.col("root.tcol") * 100_000 + F.col("root.cell_id")).cast("long").alias("cell_id"))


def smooth(counts: DataFrame, sigma: float) -> DataFrame:
    """``row, col, density``: Gaussian convolution of pixel counts ``(row, col, n)``, by shifts out to 3 sigma, axis by axis."""
    reach = int(3 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()
    out = counts.withColumn("density", F.col("n").cast("double"))
    for axis in ("row", "col"):
        shifts = F.explode(F.array(*[F.struct(F.lit(i - reach).alias("d"), F.lit(float(x)).alias("w")) for i, x in enumerate(w)]))
        moved = out.withColumn("_s", shifts).withColumns({axis: F.col(axis) + F.col("_s.d"), "density": F.col("density") * F.col("_s.w")})
        out = moved.groupBy("row", "col").agg(F.sum("density").alias("density"))
    return out


def density_seeds(points: DataFrame, sigma: float = 5.0, window: int = 15, least: float = 2.0, existing: DataFrame | None = None, apart: int = 11) -> DataFrame:
    """``row, col, density``: pixels whose smoothed point density is the largest of their window and above ``least``, not near an existing pixel."""
    n = points.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    d = smooth(n, sigma).where(F.col("density") > least * 1e-3 if least < 1e-3 else F.col("density") > least)
    near = spread(d.select("row", "col", "density"), [(a, b) for a, b in offsets(window // 2) if (a, b) != (0, 0)])
    higher = near.join(d.select(F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("density").alias("other")), ["nrow", "ncol"]).where((F.col("other") > F.col("density")) | ((F.col("other") == F.col("density")) & (F.struct("nrow", "ncol") < F.struct("row", "col"))))
    seeds = d.join(higher.select("row", "col").distinct(), ["row", "col"], "left_anti")
    if existing is not None:
        taken = spread(existing.select("row", "col"), offsets(apart // 2)).select(F.col("nrow").alias("row"), F.col("ncol").alias("col")).distinct()
        seeds = seeds.join(taken, ["row", "col"], "left_anti")
    return seeds.select("row", "col", F.round("density", 6).alias("density"))


def adaptive_expand(raster: DataFrame, empty: DataFrame, base: int) -> DataFrame:
    """Label expansion whose reach shrinks with density: base * (1.5 - 0.9 * share of labelled pixels around)."""
    around = spread(empty.select("row", "col"), offsets(2)).join(raster.select(F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.lit(1).alias("_h")), ["nrow", "ncol"], "left")
    reach = around.groupBy("row", "col").agg((base * (1.5 - 0.9 * F.count("_h") / F.lit(25))).alias("_r"))
    near = expand_labels(raster, empty, int(np.ceil(1.5 * base)))
    return near.join(reach, ["row", "col"]).where(F.col("d2") <= F.col("_r") * F.col("_r")).select("row", "col", "cell_id", "d2")


def stains(pixels: DataFrame) -> DataFrame:
    """Hematoxylin (0 at least) and eosin amounts of ``(r, g, b)`` pixels: natural optical densities against the rows of
    the inverse of the matrix of unit stains; column algebra only."""
    m = np.array(STAINS)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    inv = np.linalg.inv(m)
    od = [-F.log((F.col(c) + 1) / F.lit(256.0)) for c in ("r", "g", "b")]
    amount = lambda k: sum((od[i] * float(inv[k, i]) for i in range(1, 3)), od[0] * float(inv[k, 0]))
    return pixels.withColumns({"hematoxylin": F.greatest(amount(0), F.lit(0.0)), "eosin": amount(1)})


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic structuring element of odd ``size``."""
    r = size // 2
    return [(dy, dx) for dy in range(-r, r + 1) for reach in [round(r * ((r * r - dy * dy) / (r * r)) ** 0.5)] for dx in range(-reach, reach + 1)]


def dilate(pixels: DataFrame, shape: list[tuple[int, int]], box: tuple[int, int]) -> DataFrame:
    """``row, col`` of all pixels of a box of (rows, columns) that ``shape`` reaches from a pixel."""
    near = spread(pixels.select("row", "col"), shape).select(F.col("nrow").alias("row"), F.col("ncol").alias("col")).distinct()
    return near.where((F.col("row") >= 0) & (F.col("row") < box[0]) & (F.col("col") >= 0) & (F.col("col") < box[1]))


def tissue_mask(pixels: DataFrame, box: tuple[int, int], limit: int = 220) -> DataFrame:
    """``row, col`` of the tissue in ``pixels(row, col, r, g, b)``: grey below ``limit``, closed by an 11 ellipse, dilated twice by a 5 one.

    A pixel stays in the closing unless the shape around it holds a pixel of the box that the dilation left out.
    """
    grey = F.round(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))
    grown = dilate(pixels.where(grey < limit), ellipse(11), box)
    left = pixels.select("row", "col").join(grown, ["row", "col"], "left_anti")
    closed = grown.join(dilate(left, ellipse(11), box), ["row", "col"], "left_anti")
    return dilate(dilate(closed, ellipse(5), box), ellipse(5), box)


def stain_vectors(pixels: DataFrame, light: float = 240.0, beta: float = 0.15, least: int = 100) -> np.ndarray | None:
    """Unit optical densities of the two stains in ``pixels(r, g, b)``, hematoxylin first; None with too few stained pixels.

    The plane of the two largest axes of the covariance holds the stains; they lie at the 1st and 99th percentile of the
    angle in it.  Moments and percentiles are aggregates; only a 3 x 3 matrix and two angles reach the driver.
    """
    for floor in (beta, 0.05):
        od = pixels.select(*[(-F.log((F.col(c) + 1) / (light + 1))).alias(c) for c in ("r", "g", "b")])
        od = od.where((F.col("r") >= floor) & (F.col("g") >= floor) & (F.col("b") >= floor))
        pairs = [(x, y) for x in "rgb" for y in "rgb"]
        m = od.agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(x, y).alias(x + y) for x, y in pairs]).first()
        if m.n >= least:
            break
    else:
        return None
    axes = np.linalg.eigh(np.array([m[x + y] for x, y in pairs]).reshape(3, 3))[1][:, [2, 1]]
    at = lambda k: sum((F.col(c) * float(axes[i, k]) for i, c in enumerate("gb", 1)), F.col("r") * float(axes[0, k]))
    lo, hi = od.agg(F.percentile(F.atan2(at(1), at(0)), F.array(F.lit(0.01), F.lit(0.99)))).first()[0]
    ends = np.stack([axes @ [math.cos(a), math.sin(a)] for a in (lo, hi)])
    ends = ends if ends[0, 0] > ends[1, 0] else ends[::-1]
    return ends / np.linalg.norm(ends, axis=1, keepdims=True)


#: Sides of a pixel, clockwise.
SIDES = ((-1, 0), (0, 1), (1, 0), (0, -1))


def outlines(pixels: set[tuple[int, int]]) -> list[list[tuple[float, float]]]:
    """Closed rings ``(row, col)`` at half height around a set of pixels: points halfway to each neighbour outside.

    From a side of a pixel the ring goes on, clockwise around the pixels, at the same pixel if the next neighbour is
    outside, else at the neighbour, or at the one beyond it.  Pixels that touch at corners only stay apart.
    """
    left = {(p, k) for p in pixels for k, (dr, dc) in enumerate(SIDES) if (p[0] + dr, p[1] + dc) not in pixels}
    rings = []
    while left:
        first = at = min(left)
        ring = []
        while True:
            left.discard(at)
            (r, c), k = at
            (dr, dc), (er, ec) = SIDES[k], SIDES[(k + 1) % 4]
            ring.append((r + dr / 2, c + dc / 2))
            if (r + er, c + ec) not in pixels:
                at = ((r, c), (k + 1) % 4)
            elif (r + er + dr, c + ec + dc) not in pixels:
                at = ((r + er, c + ec), k)
            else:
                at = ((r + er + dr, c + ec + dc), (k + 3) % 4)
            if at == first:
                break
        rings.append([*ring, ring[0]])
    return rings


def contours(raster: DataFrame, scale: float = 1.0, least: int = 1) -> DataFrame:
    """``cell_id, ring``: the outline with the most points of each cell of ``least`` pixels, as scaled (x, y) of pixel centres; a cell in one task."""

    def trace(f: pd.DataFrame) -> pd.DataFrame:
        px = set(zip(f["row"].tolist(), f["col"].tolist(), strict=True))
        if len(px) < least:
            return pd.DataFrame({"cell_id": pd.Series(dtype="int64"), "ring": pd.Series(dtype="object")})
        ring = max(outlines(px), key=len)  # the first among equals
        return pd.DataFrame({"cell_id": [f["cell_id"].iloc[0]], "ring": [[[c * scale, r * scale] for r, c in ring]]})

    return raster.groupBy("cell_id").applyInPandas(trace, "cell_id long, ring array<array<double>>")
