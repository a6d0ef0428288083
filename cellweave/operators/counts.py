"""Sparse counts ``(cell_id, gene_id, value)``: aggregation, quality control and filters.

Zeros are implicit.  Every mean, variance or share over cells divides by the number of all cells, which is an
argument or comes from a cell table; no dense matrix is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bin_of, complexity, num, ratio


def cell_counts(bins: DataFrame, weight: str | None = None) -> DataFrame:
    """Sums of bins per cell and gene, optionally weighted; partial sums are taken before the shuffle."""
    value = F.col("value") * F.col(weight) if weight else F.col("value")
    return bins.groupBy("cell_id", "gene_id").agg(F.sum(value).alias("value"))


def area_centroid(raster: DataFrame) -> DataFrame:
    return raster.groupBy("cell_id").agg(F.count(F.lit(1)).alias("area"), F.avg("row").alias("centroid_row"), F.avg("col").alias("centroid_col"))


def area_filter(raster: DataFrame, least: int, most: int) -> DataFrame:
    """Pixels of the cells whose area lies in [least, most]."""
    fit = raster.groupBy("cell_id").count().where(F.col("count").between(least, most))
    return raster.join(fit, "cell_id", "left_semi")


def prefix_flag(name: Column, prefix: str) -> Column:
    return F.lower(name).startswith(prefix.lower())


def chosen_prefix(genes: DataFrame, first: str, other: str) -> DataFrame:
    """One row: ``first`` if any name starts with it, else ``other``."""
    return genes.agg(F.when(F.max(F.col("name").startswith(first)), F.lit(first)).otherwise(F.lit(other)).alias("prefix"))


def qc_metrics(counts: DataFrame, flagged: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """``cell_id, total, n_genes, flagged_total, pct_flagged, complexity``.

    ``flagged(gene_id, mito)`` marks the genes of the percentage.  With ``cells`` the result has every cell of it, empty
    ones with zeros; without, those that have counts.
    """
    c = counts.join(flagged.where("mito").select("gene_id", F.lit(True).alias("_f")), "gene_id", "left")
    m = c.groupBy("cell_id").agg(F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("n_genes"), F.coalesce(F.sum(F.when(F.col("_f"), F.col("value"))), num(0)).alias("flagged_total"))
    if cells is not None:
        m = cells.select("cell_id").distinct().join(m, "cell_id", "left").na.fill(0)
    return m.withColumns({"pct_flagged": 100 * ratio(F.col("flagged_total"), F.col("total")), "complexity": complexity(F.col("n_genes"), F.col("total"))})


def qc_pass(min_genes: int | None = None, max_genes: int | None = None, min_counts: float | None = None, max_pct: float | None = None, min_complexity: float | None = None) -> Column:
    """Conjunction of the limits that are given; a complexity limit of 0 is none."""
    out = F.lit(True)
    for limit, cond in ((min_genes, lambda x: F.col("n_genes") >= x), (min_counts, lambda x: F.col("total") >= x), (max_genes, lambda x: F.col("n_genes") <= x), (max_pct, lambda x: F.col("pct_flagged") <= x), (min_complexity or None, lambda x: F.col("complexity") >= x)):
        if limit is not None:
            out = out & cond(limit)
    return out


def filter_genes(counts: DataFrame, min_cells: int) -> DataFrame:
    """Counts of the genes found in ``min_cells`` or more of the remaining cells."""
    found = counts.where("value > 0").groupBy("gene_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cells)
    return counts.join(found, "gene_id", "left_semi")


def sparsity(counts: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    n, m = cells.agg(F.countDistinct("cell_id").alias("n_cells")), genes.agg(F.countDistinct("gene_id").alias("n_genes"))
    nnz = counts.where("value <> 0").agg(F.count(F.lit(1)).alias("nnz"))
    return nnz.crossJoin(n).crossJoin(m).withColumn("sparsity", 1 - F.col("nnz") / (F.col("n_cells") * F.col("n_genes")))  # one row each


def describe(per_cell: DataFrame, by: str) -> DataFrame:
    """Number of cells, total, means, medians and quartiles of a QC table per group."""
    q = lambda c, p: F.percentile(c, p)
    return per_cell.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("total").alias("total"), F.avg("total").alias("mean_counts"), q("total", 0.5).alias("median_counts"),
        F.avg("n_genes").alias("mean_genes"), q("n_genes", 0.5).alias("median_genes"), q("total", 0.25).alias("q1_counts"), q("total", 0.75).alias("q3_counts"),
    )


def histogram(df: DataFrame, column: str, bins: int = 60, by: list[str] | None = None) -> DataFrame:
    """Counts of equal bins of the finite non-negative values per group; the last bin is closed on the right."""
    by = by or []
    x = F.col(column)
    ok = df.where(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < F.lit(float("inf"))))
    ends = ok.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    rows = ok.join(ends, by) if by else ok.crossJoin(F.broadcast(ends))  # one row
    return rows.groupBy(*by, bin_of(x, F.col("_lo"), F.col("_hi"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def percentiles(df: DataFrame, column: str, by: list[str], ps: tuple[float, ...] = (0.05, 0.5, 0.95, 0.99)) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(column).alias("mean"), *[F.percentile(column, p).alias(f"p{round(100 * p):02d}") for p in ps])


def mad_bounds(df: DataFrame, column: str, by: list[str], width: float = 3.0) -> DataFrame:
    """expm1(median -+ width * MAD) of log1p values per group; the lower bound is 0 at least."""
    logged = df.select(*by, F.log1p(column).alias("_l"))
    med = logged.groupBy(*by).agg(F.median("_l").alias("_m"))
    off = logged.join(med, by).groupBy(*by, "_m").agg(F.median(F.abs(F.col("_l") - F.col("_m"))).alias("_d"))
    return off.select(*by, F.greatest(F.expm1(F.col("_m") - width * F.col("_d")), num(0)).alias("low"), F.expm1(F.col("_m") + width * F.col("_d")).alias("high"))


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Counts and shares of the values within each group."""
    from pyspark.sql.window import Window

    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def sampled(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by the order of a seeded hash of their keys: a sampling operator, the same on every run."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)
