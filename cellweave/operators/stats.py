"""Ranks, tests and scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import clip, num


def average_rank(value: str, by: list[str]) -> Column:
    """Rank within the group, ties sharing their mean rank."""
    w = Window.partitionBy(*[F.col(c) for c in by]) if by else Window.partitionBy(F.lit(0))
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(w.partitionBy(*[F.col(c) for c in by], F.col(value)) if by else Window.partitionBy(value)) - 1) / 2


def adjusted_simple(p: str, n: Column, rank: Column) -> Column:
    """min(p * n / rank, 1) by average ranks, without the monotone step."""
    return F.least(F.col(p) * n / rank, num(1))


def benjamini_hochberg(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Adds ``q``: the step-up adjusted p values, monotone in p."""
    w = Window.partitionBy(*by)
    raw = F.col(p) * F.count(F.lit(1)).over(w) / F.rank().over(w.orderBy(F.col(p)))
    df = df.withColumn("_raw", raw)
    return df.withColumn("q", F.least(F.min("_raw").over(w.orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, 0)), num(1))).drop("_raw")


def normal_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))


def _two_sided(column: Column) -> Column:
    udf = F.pandas_udf(normal_tail, "double")
    return udf(column)


def mann_whitney(df: DataFrame, value: str, side: str, by: list[str] | None = None) -> DataFrame:
    """U of the rows with ``side`` true, its effect size 1 - 2U/(n1 n2), z with tie correction, and the normal two-sided p."""
    by = by or []
    r = df.withColumn("_r", average_rank(value, by))
    n1, n = F.count_if(F.col(side)).cast("double"), F.count(F.lit(1)).cast("double")
    g = r.groupBy(*by).agg(F.sum(F.when(F.col(side), F.col("_r"))).alias("_rs"), n1.alias("_n1"), n.alias("_n"))
    tie = df.groupBy(*by, value).agg(F.count(F.lit(1)).cast("double").alias("_t")).groupBy(*by).agg(F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("_ties"))
    g = g.join(tie, by) if by else g.crossJoin(tie)  # one row each
    n1, n = F.col("_n1"), F.col("_n")
    n2 = n - n1
    u = F.col("_rs") - n1 * (n1 + 1) / 2
    sd = F.sqrt(F.greatest(n1 * n2 / 12 * (n + 1 - F.col("_ties") / (n * (n - 1))), num(0)))
    g = g.where((n1 > 0) & (n2 > 0)).withColumns({"u": u, "effect": 1 - 2 * u / (n1 * n2), "z": F.when(sd > 0, (u - n1 * n2 / 2) / sd).otherwise(num(0))})
    return g.withColumn("p", _two_sided(F.col("z"))).select(*by, "u", "effect", "z", "p")


def exact_signed_rank_p(w: float, ranks: list[float]) -> float:
    """Two-sided p of the smaller signed-rank sum: the share of all sign patterns with a sum that small, doubled."""
    doubled = [int(round(2 * r)) for r in ranks]
    ways = [0] * (sum(doubled) + 1)
    ways[0] = 1
    for r in doubled:
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    return min(1.0, 2 * sum(ways[: int(round(2 * w)) + 1]) / 2 ** len(doubled))


def signed_rank(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """``by, n, w, p``: Wilcoxon signed-rank sums of paired columns, zeros dropped, exact p from the ranks of each group.

    A group is one pair of methods, whose blocks are few.
    """
    d = pairs.withColumn("_d", F.col(a) - F.col(b)).where("_d <> 0").withColumn("_a", F.abs("_d"))
    r = d.withColumn("_r", average_rank("_a", by))
    g = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.least(F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0))).alias("w"), F.collect_list("_r").alias("_ranks"))
    p = F.pandas_udf(lambda w, r: pd.Series([exact_signed_rank_p(x, list(y)) for x, y in zip(w, r, strict=True)]), "double")
    return g.withColumn("p", p("w", "_ranks")).drop("_ranks")


def bonferroni(df: DataFrame, p: str, n: int) -> DataFrame:
    return df.withColumn(f"{p}_bonferroni", F.least(F.col(p) * n, num(1)))


def chi2_tail(x: float, df: int) -> float:
    """Survival function of chi squared by the series or continued fraction of the incomplete gamma function."""
    a, y = df / 2, x / 2
    if y <= 0:
        return 1.0
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= y / n
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b, c = y + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """``chi2, blocks, treatments, p`` of complete blocks, with the tie correction."""
    r = df.withColumn("_r", average_rank(value, [block]))
    sums = r.groupBy(treatment).agg(F.sum("_r").alias("_s"))
    ties = df.groupBy(block, value).agg(F.count(F.lit(1)).cast("double").alias("_t")).agg(F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("_ties"))
    n = df.agg(F.countDistinct(block).cast("double").alias("_n"))
    g = sums.agg(F.sum(F.col("_s") * F.col("_s")).alias("_q"), F.count(F.lit(1)).cast("double").alias("_k")).crossJoin(n).crossJoin(ties)  # one row each
    raw = 12 / (F.col("_n") * F.col("_k") * (F.col("_k") + 1)) * F.col("_q") - 3 * F.col("_n") * (F.col("_k") + 1)
    correct = 1 - F.col("_ties") / (F.col("_n") * (F.col("_k") * F.col("_k") * F.col("_k") - F.col("_k")))
    g = g.select((raw / correct).alias("chi2"), F.col("_n").cast("long").alias("blocks"), F.col("_k").cast("long").alias("treatments"))

    def tail(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(p=[chi2_tail(x, int(k) - 1) for x, k in zip(f["chi2"], f["treatments"], strict=True)])

    return g.mapInPandas(tail, "chi2 double, blocks long, treatments long, p double")


def spearman(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    r = df.withColumns({"_x": average_rank(a, by), "_y": average_rank(b, by)})
    return r.groupBy(*by).agg(F.corr("_x", "_y").alias("rho"))


def min_max(df: DataFrame, columns: list[str], lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """Columns scaled to [0, 1] over all rows, a constant one unchanged; inverted where lower is better."""
    ends = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])
    rows = df.crossJoin(F.broadcast(ends))  # one row
    out = {}
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        s = F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.col(c))
        out[c] = 1 - s if c in lower_is_better else s
    return rows.withColumns(out).select(*df.columns)


def whisker_tops(df: DataFrame, value: str, by: str) -> DataFrame:
    """``by, top``: min(Q3 + 1.5 IQR, max)."""
    q = df.groupBy(by).agg(F.percentile(value, 0.25).alias("_a"), F.percentile(value, 0.75).alias("_b"), F.max(value).alias("_m"))
    return q.select(by, F.least(F.col("_b") + 1.5 * (F.col("_b") - F.col("_a")), F.col("_m")).alias("top"))


#: Reference values of the composite score, and the published table's weights of core, separation and survival.
UMI_REFERENCE, GENE_REFERENCE = 1000.0, 300.0
WEIGHTS = (0.65, 0.35, 0.0)


def composite(df: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """Composite score of metric rows: capture, purity, core and ``tas``.

    Expects a1_capture, a1_umi_density, a2_median_umi, a3_median_genes, c1_coexpr, ned, d1_silhouette and
    e1_immune_survival.  Density is divided by its maximum over all rows; without any density the capture rate stands
    for it, without any divergence purity is 1 - coexpression alone.
    """
    top = df.agg(F.max("a1_umi_density").alias("_md"), F.count("ned").alias("_nn"))
    d = df.crossJoin(F.broadcast(top))  # one row
    unit = lambda x: F.when(x.isNotNull(), clip(x, 0, 1))
    umi = F.col("a2_median_umi")
    d = d.withColumns({
        "a1_norm": unit(F.col("a1_capture")), "a1d_norm": unit(F.when(F.col("_md") > 0, F.col("a1_umi_density") / F.col("_md"))),
        "a2_norm": F.when(umi > 0, clip(F.log(F.greatest(umi, num(1))) / math.log(UMI_REFERENCE), 0, 1)).otherwise(num(0)),
        "a3_norm": unit(F.col("a3_median_genes") / GENE_REFERENCE), "c1_norm": unit(1 - F.col("c1_coexpr")), "ned_norm": unit(F.col("ned")),
        "d1_norm": unit((F.col("d1_silhouette") + 1) / 2), "e1_norm": unit(F.col("e1_immune_survival")),
    })
    capture = (2 * F.coalesce("a1d_norm", "a1_norm") + F.col("a2_norm") + F.col("a3_norm")) / 4
    purity = F.when(F.col("_nn") > 0, F.sqrt(F.col("c1_norm") * F.coalesce("ned_norm", "c1_norm"))).otherwise(F.col("c1_norm"))
    d = d.withColumns({"capture_score": capture, "purity_score": purity})
    d = d.withColumn("core_tas", F.sqrt(clip(F.col("capture_score"), 0, 1) * clip(F.col("purity_score"), 0, 1)))
    total = weights[0] * F.col("core_tas") + weights[1] * F.col("d1_norm")
    if weights[2]:
        total = total + weights[2] * F.col("e1_norm")
    return d.withColumn("tas", F.when(total.isNotNull(), clip(total, 0, 1))).drop("_md", "_nn")


def composite_v2(df: DataFrame, weights: tuple[float, float, float] = (0.65, 0.2, 0.15)) -> DataFrame:
    """Variant with the plain mean of the three capture parts; missing divergence, separation and survival count as 0.5."""
    d = composite(df, weights)
    half = lambda c: F.coalesce(c, num(0.5))
    capture = (F.coalesce("a1d_norm", "a1_norm") + F.col("a2_norm") + F.col("a3_norm")) / 3
    purity = F.sqrt(F.col("c1_norm") * half(F.col("ned_norm")))
    total = weights[0] * F.sqrt(clip(capture, 0, 1) * clip(purity, 0, 1)) + weights[1] * half(F.col("d1_norm")) + weights[2] * half(F.col("e1_norm"))
    return d.withColumns({"capture_score": capture, "purity_score": purity, "tas": clip(total, 0, 1)})
