"""Expression operators on sparse counts; zeros are implicit (see ``counts``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import log_normal, num, per_million
from .stats import benjamini_hochberg, normal_tail


def cell_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell_id").agg(F.sum("value").alias("total"))


def normalised(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """log1p of counts scaled to ``target`` per cell."""
    return counts.join(cell_totals(counts), "cell_id").withColumn("value", log_normal(F.col("value"), F.col("total"), target)).drop("total")


def cpm(counts: DataFrame) -> DataFrame:
    return counts.join(cell_totals(counts), "cell_id").withColumn("value", per_million(F.col("value"), F.col("total"))).drop("total")


def gene_moments(counts: DataFrame, n_cells: int | Column) -> DataFrame:
    """``gene_id, mean, variance`` (population) over all ``n_cells`` cells."""
    n = F.lit(n_cells) if isinstance(n_cells, int) else n_cells
    g = counts.groupBy("gene_id").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"))
    mean = F.col("_s") / n
    return g.select("gene_id", mean.alias("mean"), F.greatest(F.col("_q") / n - mean * mean, num(0)).alias("variance"))


def variable_genes(counts: DataFrame, n_cells: int, top: int) -> DataFrame:
    """The genes of the largest variance, ties by id."""
    return gene_moments(counts, n_cells).orderBy(F.desc("variance"), "gene_id").limit(top)


def drop_constant_genes(counts: DataFrame, n_cells: int) -> DataFrame:
    return counts.join(gene_moments(counts, n_cells).where("variance > 0"), "gene_id", "left_semi")


def scaled(counts: DataFrame, n_cells: int, most: float = 10.0) -> DataFrame:
    """(value - mean) / sample deviation of the stored entries, clipped at ``most``; deviation 0 counts as 1.

    An implicit zero of a gene scales to ``-mean / deviation``, which is given once per gene as ``zero``.
    """
    m = gene_moments(counts, n_cells)
    sd = F.sqrt(F.col("variance") * (n_cells / max(n_cells - 1, 1)))
    m = m.withColumn("_sd", F.when(sd > 0, sd).otherwise(num(1)))
    z = lambda x: F.least((x - F.col("mean")) / F.col("_sd"), num(most))
    return counts.join(m, "gene_id").select("cell_id", "gene_id", z(F.col("value")).alias("value"), z(num(0)).alias("zero"))


def group_means(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``grp, gene_id, mean, pct, n_cells``: means and shares of positive cells over all cells of each group of ``groups(cell_id, grp)``."""
    n = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n_cells"))
    g = counts.join(groups, "cell_id").groupBy("grp", "gene_id").agg(F.sum("value").alias("_s"), F.count_if(F.col("value") > 0).alias("_p"))
    return g.join(n, "grp").select("grp", "gene_id", (F.col("_s") / F.col("n_cells")).alias("mean"), (F.col("_p") / F.col("n_cells")).alias("pct"), "n_cells")


def merged_groups(means: DataFrame, names: DataFrame) -> DataFrame:
    """Means of groups that share a name in ``names(grp, name)``, weighted by cells; a gene absent from a group counts as 0."""
    total = means.select("grp", "n_cells").distinct().join(names, "grp").groupBy("name").agg(F.sum("n_cells").alias("_n"))
    s = means.join(names, "grp").groupBy("name", "gene_id").agg(F.sum(F.col("mean") * F.col("n_cells")).alias("_s"))
    return s.join(total, "name").select("name", "gene_id", (F.col("_s") / F.col("_n")).alias("mean"))


def z_across_groups(means: DataFrame, n_groups: int, limit: float = 2.5) -> DataFrame:
    """z score of each gene across ``n_groups`` groups (sample deviation, 0 counts as 1), clipped; missing groups are zeros.

    The result has a row for each (group, gene) present and ``zero``, the score of a group without the gene.
    """
    g = means.groupBy("gene_id").agg(F.sum("mean").alias("_s"), F.sum(F.col("mean") * F.col("mean")).alias("_q"))
    mu = F.col("_s") / n_groups
    var = F.greatest((F.col("_q") - n_groups * mu * mu) / max(n_groups - 1, 1), num(0))
    sd = F.when(var > 1e-18, F.sqrt(var)).otherwise(num(1))
    g = g.select("gene_id", mu.alias("_mu"), sd.alias("_sd"))
    z = lambda x: F.least(F.greatest((x - F.col("_mu")) / F.col("_sd"), num(-limit)), num(limit))
    return means.join(g, "gene_id").select("grp", "gene_id", z(F.col("mean")).alias("z"), z(num(0)).alias("zero"))


def top_per_group(scores: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The n best genes of each group, ties by gene."""
    nth = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(score), "gene_id"))
    return scores.withColumn("nth", nth).where(F.col("nth") <= n)


def first_group_only(tops: DataFrame) -> DataFrame:
    """Each gene in the first group that has it."""
    return tops.withColumn("_g", F.min("grp").over(Window.partitionBy("gene_id"))).where("grp = _g").drop("_g")


def fold_change_markers(counts: DataFrame, groups: DataFrame, least: float = 0.05) -> DataFrame:
    """``grp, gene_id, score``: mean in the group less mean outside, 0 where fewer than ``least`` of the group's cells are positive."""
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n_in")).withColumn("n_all", F.sum("n_in").over(Window.partitionBy(F.lit(0))))  # a row per group
    c = counts.join(groups, "cell_id")
    own = c.groupBy("grp", "gene_id").agg(F.sum("value").alias("s_in"), F.count_if(F.col("value") > 0).alias("p_in"))
    every = c.groupBy("gene_id").agg(F.sum("value").alias("s_all"))
    m = own.join(every, "gene_id").join(F.broadcast(sizes), "grp")
    rest = F.col("n_all") - F.col("n_in")
    diff = F.col("s_in") / F.col("n_in") - F.when(rest > 0, (F.col("s_all") - F.col("s_in")) / rest).otherwise(num(0))
    return m.select("grp", "gene_id", F.when(F.col("p_in") / F.col("n_in") >= least, diff).otherwise(num(0)).alias("score"))


def rank_sum_markers(counts: DataFrame, groups: DataFrame, absent: bool = False) -> DataFrame:
    """Wilcoxon rank sums of each group against the rest, by gene: ``grp, gene_id, u, z, log_fc``.

    Genes that no cell of a group has are left out of the group unless ``absent`` is set.

    Ranks run over the stored non-negative values of a gene.  Its zeros are one tie block at the bottom: n0 cells with
    the rank (n0 + 1) / 2, so stored ranks shift by n0 and nothing is densified.  z has the tie correction.
    """
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n1")).withColumn("n", F.sum("n1").over(Window.partitionBy(F.lit(0))))  # a row per group
    c = counts.where("value > 0").join(groups, "cell_id")
    # equal values of a gene share a rank: count them first, then run along the distinct values
    tie = c.groupBy("gene_id", "value").agg(F.count(F.lit(1)).alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("gene_id").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = tie.withColumn("r", before + (F.col("t") + 1) / 2)
    stored = tie.groupBy("gene_id").agg(F.sum("t").alias("nnz"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    own = c.join(ranked.select("gene_id", "value", "r"), ["gene_id", "value"]).groupBy("grp", "gene_id").agg(F.sum("r").alias("rs"), F.count(F.lit(1)).alias("k"), F.sum("value").alias("s_in"))
    total = c.groupBy("gene_id").agg(F.sum("value").alias("s_all"))
    if absent:  # groups times genes
        own = stored.select("gene_id").crossJoin(F.broadcast(sizes.select("grp"))).join(own, ["grp", "gene_id"], "left").fillna(0, ["rs", "k", "s_in"])
    m = own.join(stored, "gene_id").join(total, "gene_id").join(F.broadcast(sizes), "grp")
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    n2, n0 = n - n1, n - F.col("nnz")
    rank_sum = F.col("rs") + F.col("k") * n0 + (n1 - F.col("k")) * (n0 + 1) / 2
    u = rank_sum - n1 * (n1 + 1) / 2
    ties = F.col("ties") + n0 * n0 * n0 - n0
    sd = F.sqrt(F.greatest(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))), num(0)))
    fold = F.log2((F.col("s_in") / n1 + 1e-9) / ((F.col("s_all") - F.col("s_in")) / n2 + 1e-9))
    return m.select("grp", "gene_id", u.alias("u"), F.when(sd > 0, (u - n1 * n2 / 2) / sd).otherwise(num(0)).alias("z"), fold.alias("log_fc"))


def marker_table(counts: DataFrame, groups: DataFrame, names: DataFrame, top: int = 20) -> DataFrame:
    """``cluster, gene, score, logFC, pval_adj``: the ``top`` genes of each group by rank-sum score, ties by gene id.

    p values are two-sided normal tails, adjusted by Benjamini and Hochberg over all genes of the group; a gene that no
    cell of the group has takes part with its own score.  ``names(gene_id, name)``.
    """
    m = rank_sum_markers(counts, groups, absent=True)
    m = m.withColumn("p", F.pandas_udf(normal_tail, "double")(F.col("z")))
    nth = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("z"), "gene_id"))
    best = benjamini_hochberg(m, "p", ["grp"]).withColumn("_n", nth).where(F.col("_n") <= top)
    return best.join(names, "gene_id").select(F.col("grp").alias("cluster"), F.col("name").alias("gene"), F.col("z").alias("score"), F.col("log_fc").alias("logFC"), F.col("q").alias("pval_adj"))


def expression_value(counts: DataFrame, genes: DataFrame, n_genes: int) -> DataFrame:
    """Mean over the chosen genes of log1p of the raw counts; cells without them are absent (0)."""
    return counts.join(genes, "gene_id", "left_semi").groupBy("cell_id").agg((F.sum(F.log1p("value")) / n_genes).alias("value"))


def panel_scores(counts: DataFrame, panels: DataFrame, n_bins: int = 25, controls: int = 50, seed: int = 0) -> DataFrame:
    """``cell_id, panel, score``: mean of the panel's genes less that of control genes of the same expression bins.

    Bins hold equal numbers of genes by mean expression; the controls of a bin are the first by a seeded hash, so runs
    agree.  Genes without counts take part neither as panel nor as control genes.
    """
    mean = counts.groupBy("gene_id").agg(F.sum("value").alias("_s"))
    cut = mean.withColumn("_bin", F.floor(n_bins * F.percent_rank().over(Window.partitionBy(F.lit(0)).orderBy("_s", "gene_id"))))  # a row per gene
    own = panels.join(cut, "gene_id")
    nth = F.row_number().over(Window.partitionBy("panel", "_bin").orderBy(F.xxhash64("gene_id", F.lit(seed)), "gene_id"))
    free = own.select("panel", "_bin").distinct().join(cut, "_bin").join(panels.select("panel", "gene_id"), ["panel", "gene_id"], "left_anti")
    picked = free.withColumn("_k", nth).where(F.col("_k") <= controls).select("panel", "gene_id", F.lit(0).alias("in"))
    both = own.select("panel", "gene_id", F.lit(1).alias("in")).union(picked)
    size = both.groupBy("panel").agg(F.sum("in").alias("_a"), F.sum(1 - F.col("in")).alias("_b"))
    s = counts.join(both, "gene_id").groupBy("cell_id", "panel").agg(F.sum(F.when(F.col("in") == 1, F.col("value")).otherwise(0)).alias("_x"), F.sum(F.when(F.col("in") == 0, F.col("value")).otherwise(0)).alias("_y"))
    return s.join(size, "panel").select("cell_id", "panel", (F.col("_x") / F.greatest("_a", F.lit(1)) - F.col("_y") / F.greatest("_b", F.lit(1))).alias("score"))


def hellinger(p: Column, q: Column) -> Column:
    """Distance of two distributions given as arrays of equal length: sqrt of half the squared differences of roots."""
    return F.sqrt(hellinger_sq(p, q))


def hellinger_sq(p: Column, q: Column) -> Column:
    return 0.5 * F.aggregate(F.zip_with(p, q, lambda a, b: F.pow(F.sqrt(a) - F.sqrt(b), F.lit(2.0))), num(0), lambda s, x: s + x)


def neighbour_divergence(counts: DataFrame, pairs: DataFrame, genes: DataFrame, least: int = 5) -> DataFrame:
    """``pairs, divergence``: mean Hellinger distance of adjacent cells over ``genes``; null with fewer than ``least`` pairs.

    Rows of unit mass have distance sqrt(1 - sum sqrt(p q)), an inner join on the genes that both have; a cell without
    mass on the genes has squared distance 1/2 to one with, and 0 to another without.
    """
    c = counts.join(genes, "gene_id", "left_semi").where("value > 0")
    mass = c.groupBy("cell_id").agg(F.sum("value").alias("_m"))
    p = c.join(mass, "cell_id").select("cell_id", "gene_id", F.sqrt(F.col("value") / F.col("_m")).alias("p"))
    e = pairs.select("a", "b")
    both = e.join(p.select(F.col("cell_id").alias("a"), "gene_id", F.col("p").alias("pa")), "a").join(p.select(F.col("cell_id").alias("b"), "gene_id", F.col("p").alias("pb")), ["b", "gene_id"])
    shared = both.groupBy("a", "b").agg(F.sum(F.col("pa") * F.col("pb")).alias("s"))
    named = e.join(mass.select(F.col("cell_id").alias("a"), F.lit(1).alias("_ha")), "a", "left").join(mass.select(F.col("cell_id").alias("b"), F.lit(1).alias("_hb")), "b", "left").join(shared, ["a", "b"], "left")
    has = F.coalesce("_ha", F.lit(0)) + F.coalesce("_hb", F.lit(0))
    square = F.when(has == 2, F.greatest(1 - F.coalesce("s", num(0)), num(0))).when(has == 1, num(0.5)).otherwise(num(0))
    return named.agg(F.count(F.lit(1)).alias("pairs"), F.when(F.count(F.lit(1)) >= least, F.avg(F.sqrt(square))).alias("divergence"))


def coexpression(counts: DataFrame, gene_pairs: DataFrame, n_cells: int) -> DataFrame:
    """``a, b, rate``: share of all cells in which both genes of a pair are positive."""
    pos = counts.where("value > 0").select("cell_id", "gene_id")
    both = gene_pairs.join(pos.select(F.col("gene_id").alias("a"), "cell_id"), "a").join(pos.select(F.col("gene_id").alias("b"), "cell_id"), ["b", "cell_id"])
    n = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return gene_pairs.select("a", "b").join(n, ["a", "b"], "left").select("a", "b", (F.coalesce("n", F.lit(0)) / n_cells).alias("rate"))
