"""Attribution and key joins."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def attribute(bins: DataFrame, raster: DataFrame) -> DataFrame:
    """``bins(row, col, ...)`` with the cell of their pixel in ``raster(row, col, cell_id)``, 0 where there is none."""
    return bins.join(raster.select("row", "col", "cell_id"), ["row", "col"], "left").withColumn("cell_id", F.coalesce("cell_id", F.lit(0)))


def offsets(reach: int, disc: bool = False) -> list[tuple[int, int]]:
    """Pixel offsets of a square, or of a disc, around a pixel."""
    r = range(-reach, reach + 1)
    return [(a, b) for a, b in product(r, r) if not disc or a * a + b * b <= reach * reach]


def spread(df: DataFrame, shifts: list[tuple[int, int]], row: str = "nrow", col: str = "ncol") -> DataFrame:
    """Each row once per shift, with the shifted pixel: turns a range join on pixels into an equi join."""
    at = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in shifts]))
    return df.withColumn("_s", at).withColumns({row: F.col("row") + F.col("_s.dr"), col: F.col("col") + F.col("_s.dc"), "d2": F.col("_s.dr") * F.col("_s.dr") + F.col("_s.dc") * F.col("_s.dc")}).drop("_s")


def weighted_attribution(bins: DataFrame, raster: DataFrame, reach: int, key: str = "bin_id") -> DataFrame:
    """``key, cell_id, weight``: the share of each cell among the foreground pixels of the bin's square."""
    hits = spread(bins.select(key, "row", "col"), offsets(reach)).join(raster.select(F.col("row").alias("nrow"), F.col("col").alias("ncol"), "cell_id"), ["nrow", "ncol"])
    n = hits.groupBy(key, "cell_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select(key, "cell_id", (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("weight"))


def expand_labels(raster: DataFrame, empty: DataFrame, reach: int) -> DataFrame:
    """The nearest labelled pixel's cell within ``reach`` for each pixel of ``empty(row, col)``; ties go to the first row, then column."""
    near = spread(empty.select("row", "col"), offsets(reach, disc=True)).join(raster.select(F.col("row").alias("nrow"), F.col("col").alias("ncol"), "cell_id"), ["nrow", "ncol"])
    return near.groupBy("row", "col").agg(F.min_by("cell_id", F.struct("d2", "nrow", "ncol")).alias("cell_id"), F.min("d2").alias("d2"))


def _largest_neighbour(raster: DataFrame) -> DataFrame:
    around = [(a, b) for a, b in offsets(1) if (a, b) != (0, 0)]
    there = raster.select(F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("cell_id").alias("near"))
    return spread(raster, around).join(there, ["nrow", "ncol"]).groupBy("row", "col", "cell_id").agg(F.max("near").alias("near"))


def touching(raster: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of touching cells; each pixel sees the largest label among its 3 x 3 neighbours only."""
    seen = _largest_neighbour(raster).withColumn("near", F.greatest("near", "cell_id")).where("near <> cell_id")
    return seen.select(F.least("cell_id", "near").alias("a"), F.greatest("cell_id", "near").alias("b")).distinct()


def larger_neighbours(raster: DataFrame, most: int = 3) -> DataFrame:
    """Up to ``most`` larger neighbours of each cell, by id."""
    pairs = touching(raster)
    nth = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    return pairs.withColumn("nth", nth).where(F.col("nth") <= most).select("a", "b")


def boundary_pixels(raster: DataFrame) -> DataFrame:
    """Pixels one of whose four neighbours has another label or none."""
    there = raster.select(F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("cell_id").alias("near"))
    four = spread(raster, [(-1, 0), (1, 0), (0, -1), (0, 1)]).join(there, ["nrow", "ncol"], "left")
    return four.where(F.col("near").isNull() | (F.col("near") != F.col("cell_id"))).select("row", "col", "cell_id").distinct()


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a_id, b_id, shared, a_area, b_area, iou`` of the labels of two rasters that share pixels."""
    x, y = a.select("row", "col", F.col("cell_id").alias("a_id")), b.select("row", "col", F.col("cell_id").alias("b_id"))
    shared = x.join(y, ["row", "col"]).groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("shared"))
    areas = [t.groupBy(k).agg(F.count(F.lit(1)).alias(n)) for t, k, n in ((x, "a_id", "a_area"), (y, "b_id", "b_area"))]
    return shared.join(areas[0], "a_id").join(areas[1], "b_id").withColumn("iou", F.col("shared") / (F.col("a_area") + F.col("b_area") - F.col("shared")))


def label_chain(points: DataFrame, raster: DataFrame, labels: DataFrame, missing: str = "unmatched") -> DataFrame:
    """Truth points to the predicted cell under them to its label; cell 0 is the background."""
    return attribute(points, raster).join(labels.where("cell_id <> 0").select("cell_id", "label"), "cell_id", "left").withColumn("label", F.coalesce("label", F.lit(missing)))


def dense_ids(df: DataFrame, key: str, name: str = "dense", chunk: int = 1 << 20) -> DataFrame:
    """0-based dense ids in the order of the distinct ``key``.

    Numbering runs within hash-free ranges of keys: ranks inside each range of ``chunk`` values, plus the number of keys
    in the ranges before.  Only one row per range goes through a global window.
    """
    return _numbered(df.withColumn("_part", F.floor(F.col(key) / chunk)), key, name)


def _numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """0-based numbers in the order of ``key``, whose ``_part`` grows with it."""
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return rows.join(starts, "_part").withColumn(name, (nth + F.col("_before")).cast("long")).drop("_part", "_before")


def category_codes(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """0-based codes of the distinct values in their order; the window runs over the distinct values only."""
    codes = df.select(column).distinct().withColumn(name, (F.dense_rank().over(Window.orderBy(column)) - 1).cast("int"))
    return df.join(codes, column)


def assign_barcodes(ids: DataFrame, pool: DataFrame) -> DataFrame:
    """The n-th id with the n-th barcode of a pool, in order; raises if the pool is too short.

    ``ids(cell_id)`` and ``pool(barcode)`` hold distinct values.  The reference draws with replacement instead, which
    repeats barcodes.
    """
    if pool.count() < ids.count():
        raise ValueError("fewer barcodes than cells")
    a = dense_ids(ids.select("cell_id"), "cell_id", "n")
    b = _numbered(pool.select("barcode", F.substring("barcode", 1, 6).alias("_part")), "barcode", "n")
    return a.join(b, "n").select("cell_id", "barcode")


def unique_names(df: DataFrame, column: str, order: str) -> DataFrame:
    """Later occurrences of a name get the suffix -1, -2, ..."""
    nth = F.row_number().over(Window.partitionBy(column).orderBy(order)) - 1
    return df.withColumn("_k", nth).withColumn("unique_name", F.when(F.col("_k") == 0, F.col(column)).otherwise(F.concat_ws("-", column, F.col("_k").cast("string")))).drop("_k")


def pairs_of(df: DataFrame, column: str) -> DataFrame:
    """Unordered pairs of the distinct values of a small column."""
    x = df.select(F.col(column).alias("a")).distinct()
    return x.join(x.select(F.col("a").alias("b")), F.col("a") < F.col("b"))


def boxes_meet(a: DataFrame, b: DataFrame) -> Column:
    """Condition that two half-open boxes overlap."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def concat(frames: dict[str, DataFrame], key: str = "cell_id", genes: str = "outer") -> DataFrame:
    """Long count tables of several regions in one, ids prefixed by the region.

    With implicit zeros an outer join of the genes is a plain union; an inner one keeps the genes found in every region.
    """
    out = None
    for roi, df in frames.items():
        one = df.withColumn("roi", F.lit(roi)).withColumn(key, F.concat_ws("__", F.lit(roi), F.col(key).cast("string")))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if genes == "inner":
        everywhere = out.groupBy("gene_id").agg(F.countDistinct("roi").alias("n")).where(F.col("n") == len(frames))
        out = out.join(everywhere, "gene_id", "left_semi")
    return out


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` in place of those of ``base`` with the same key."""
    return base.join(new, key, "left_anti").unionByName(new)
