"""Coordinates and regions of point tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import num


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; there are {df.columns}")
    return df


def inside(x: Column, y: Column, box: tuple[float, float, float, float], inclusive: bool = False) -> Column:
    """Whether a point lies in (x0, y0, x1, y1), half-open unless ``inclusive``."""
    x0, y0, x1, y1 = box
    if inclusive:
        return x.between(x0, x1) & y.between(y0, y1)
    return (x >= x0) & (x < x1) & (y >= y0) & (y < y1)


def in_box(df: DataFrame, box: tuple[float, float, float, float], x: str = "x", y: str = "y", inclusive: bool = False) -> DataFrame:
    """Rows in the box; the range reaches the Parquet scan."""
    return require_columns(df, [x, y]).where(inside(F.col(x), F.col(y), box, inclusive))


def in_regions(df: DataFrame, regions: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Rows with each region ``(roi, x0, y0, x1, y1)`` that holds them, half-open.

    Rows and regions meet in grid cells as large as the largest region's side, of which a region covers four at most.
    """
    side = regions.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0
    cell = lambda c: F.floor(c / num(float(side))).cast("long")
    over = lambda a, b: F.explode(F.sequence(cell(F.col(a)), F.greatest(cell(F.col(a)), cell(F.col(b)))))
    r = regions.withColumn("_gx", over("x0", "x1")).withColumn("_gy", over("y0", "y1"))
    p = df.withColumns({"_gx": cell(F.col(x)), "_gy": cell(F.col(y))})
    within = (p[x] >= r["x0"]) & (p[x] < r["x1"]) & (p[y] >= r["y0"]) & (p[y] < r["y1"])
    return p.join(r, (p["_gx"] == r["_gx"]) & (p["_gy"] == r["_gy"]) & within).drop("_gx", "_gy")


def pixels_to_um(df: DataFrame, columns: list[str], scale: float) -> DataFrame:
    return df.withColumns({f"{c}_um": F.col(c) * num(scale) for c in columns})


def um_to_pixels(df: DataFrame, columns: list[str], scale: float) -> DataFrame:
    """Rounded to the nearest pixel, halves to even."""
    return df.withColumns({f"{c.removesuffix('_um')}_px": F.bround(F.col(c) / num(scale), 0).cast("long") for c in columns})


def areas_to_um2(df: DataFrame, column: str, scale: float) -> DataFrame:
    return df.withColumn(f"{column}_um2", F.col(column) * num(scale * scale))


def project(x: Column, y: Column, m) -> tuple[Column, Column]:
    """Projective transform by a 3 x 3 matrix."""
    m = np.asarray(m, float)
    d = num(m[2, 0]) * x + num(m[2, 1]) * y + num(m[2, 2])
    return (num(m[0, 0]) * x + num(m[0, 1]) * y + num(m[0, 2])) / d, (num(m[1, 0]) * x + num(m[1, 1]) * y + num(m[1, 2])) / d


def project_back(x: Column, y: Column, m) -> tuple[Column, Column]:
    return project(x, y, np.linalg.inv(np.asarray(m, float)))


def project_box(df: DataFrame, m) -> DataFrame:
    """The upright box around the transformed corners of (x0, y0, x1, y1)."""
    corners = [project(F.col(a), F.col(b), m) for a in ("x0", "x1") for b in ("y0", "y1")]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return df.withColumns({"px0": F.least(*xs), "py0": F.least(*ys), "px1": F.greatest(*xs), "py1": F.greatest(*ys)})


def local_pixels(df: DataFrame, x0: float, y0: float, x: str = "x", y: str = "y", mode: str = "round") -> DataFrame:
    """``row`` and ``col`` relative to an origin, rounded (halves to even) or truncated."""
    if mode not in ("round", "trunc"):
        raise ValueError(mode)
    to = (lambda c: F.bround(c, 0).cast("int")) if mode == "round" else (lambda c: c.cast("int"))
    return df.withColumns({"row": to(F.col(y) - num(y0)), "col": to(F.col(x) - num(x0))})


def offset(df: DataFrame, origins: DataFrame, key: str, sign: int = 1) -> DataFrame:
    """Adds (or, with sign -1, subtracts) the origin ``(key, x0, y0)`` of each row's region."""
    joined = df.join(origins.select(key, "x0", "y0"), key)
    return joined.withColumns({"x": F.col("x") + sign * F.col("x0"), "y": F.col("y") + sign * F.col("y0")}).drop("x0", "y0")


def rescale(df: DataFrame, from_scale: float, to_scale: float, columns: list[str]) -> DataFrame:
    """Coordinates of one pixel size in another."""
    return df.withColumns({c: F.col(c) * num(from_scale / to_scale) for c in columns})


def strided(df: DataFrame, step: int) -> DataFrame:
    return df.where((F.col("row") % step == 0) & (F.col("col") % step == 0))


def tile_box(df: DataFrame, width: int, height: int, size: int, overlap: int, levels: int) -> DataFrame:
    """Full-resolution box of deep-zoom tiles ``(level, tx, ty)``, clipped to the image."""
    scale = F.pow(F.lit(2.0), F.lit(levels) - F.col("level"))
    out = {}
    for t, a, b, most in (("tx", "x0", "x1", width), ("ty", "y0", "y1", height)):
        start = F.greatest(F.col(t) * size - F.when(F.col(t) > 0, F.lit(overlap)).otherwise(0), F.lit(0))
        end = (F.col(t) + 1) * size + overlap
        out[a] = F.least(F.floor(start * scale), F.lit(most)).cast("long")
        out[b] = F.least(F.ceil(end * scale), F.lit(most)).cast("long")
    return df.withColumns(out)


def coverage(windows: DataFrame, bins: DataFrame, step: int) -> DataFrame:
    """Share of the coarse cells of each window ``(window, x0, y0, x1, y1)`` (integers) that hold a bin ``(x, y)``."""
    taken = bins.select(F.floor(F.col("y") / step).alias("r"), F.floor(F.col("x") / step).alias("c")).distinct()
    def span(a, b):
        return F.sequence(F.expr(f"{a} div {step}").cast("long"), F.expr(f"({b} - 1) div {step}").cast("long"))
    grid = windows.select("window", F.explode(span("y0", "y1")).alias("r"), F.col("x0"), F.col("x1")).select("window", "r", F.explode(span("x0", "x1")).alias("c"))
    hits = grid.join(taken, ["r", "c"], "left_semi").groupBy("window").agg(F.count(F.lit(1)).alias("hits"))
    total = grid.groupBy("window").agg(F.count(F.lit(1)).alias("cells"))
    return total.join(hits, "window", "left").select("window", "cells", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) / F.col("cells")).alias("coverage"))


def sample_windows(scored: DataFrame, wanted: int = 4, tries: int = 50, strict: float = 0.6, loose: float = 0.4, loosen_at: int = 40, enough: int = 2) -> DataFrame:
    """Accepted windows of an ordered candidate list ``(window, try_no, coverage)``.

    Candidates need the strict coverage; from try ``loosen_at`` on the loose one suffices if fewer than ``enough`` were
    accepted before it.  The first ``wanted`` of the first ``tries`` are taken.  The list is bounded by ``tries``.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(F.lit(0)).orderBy("try_no")
    rows = scored.where(F.col("try_no") < tries)
    early = F.sum(F.when((F.col("try_no") < loosen_at) & (F.col("coverage") >= strict), 1).otherwise(0)).over(Window.partitionBy(F.lit(0)))
    limit = F.when((F.col("try_no") >= loosen_at) & (early < enough), num(loose)).otherwise(num(strict))
    rows = rows.withColumn("limit", limit).where(F.col("coverage") >= F.col("limit")).withColumn("nth", F.row_number().over(w))
    return rows.where(F.col("nth") <= wanted).drop("limit")


def polygon_measures(df: DataFrame, xs: str = "xs", ys: str = "ys") -> DataFrame:
    """Area and centroid of closed rings given as arrays of coordinates, by the shoelace sums."""
    n = F.size(xs)
    nxt = lambda a, i: F.get(F.col(a), (i + 1) % n)
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col(xs), i) * nxt(ys, i) - nxt(xs, i) * F.get(F.col(ys), i))
    total = lambda a: F.aggregate(a, num(0), lambda s, x: s + x)
    df = df.withColumn("_cross", cross)
    mom = lambda a: F.aggregate(F.sequence(F.lit(0), n - 1), num(0), lambda s, i: s + (F.get(F.col(a), i) + nxt(a, i)) * F.get(F.col("_cross"), i))
    df = df.withColumn("_twice", total(F.col("_cross")))
    return df.withColumns({"area": F.abs(F.col("_twice")) / 2, "centroid_x": F.try_divide(mom(xs), 3 * F.col("_twice")), "centroid_y": F.try_divide(mom(ys), 3 * F.col("_twice"))}).drop("_cross", "_twice")
