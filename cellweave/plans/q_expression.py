"""Expression (survey sections F13-F19, F22, G5-G8, J4-J5, K11-K13, L1-L6, N9)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import embed as M
from ..operators import expression as X
from .registry import query
from .views import Views, sql

r6 = lambda c: F.round(c, 6).alias(c)
_N = "(SELECT count(*) FROM cells)"
GRP = "SELECT cell_id, CAST(cell_id % 4 AS INTEGER) AS grp FROM cells"


def n_cells(v: Views) -> int:
    return v.table("supplier").count()


def groups(v: Views):
    return v.table("supplier").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_suppkey") % 4).cast("int").alias("grp"))


_NORM = "SELECT cell_id, gene_id, ln(1 + value * 10000 / total) AS value FROM counts JOIN (SELECT cell_id, sum(value) AS total FROM counts GROUP BY 1) USING (cell_id)"
_MEANS = "SELECT grp, gene_id, sum(value) / any_value(n) AS mean, count(*) FILTER (value > 0) / any_value(n) AS pct, any_value(n) AS n_cells FROM counts JOIN g USING (cell_id) JOIN (SELECT grp, count(*) AS n FROM g GROUP BY 1) USING (grp) GROUP BY 1, 2"


@query("j4_log_normalise", sql("counts", "SELECT cell_id, gene_id, round(value, 6) AS value FROM t", t=_NORM))
def _(v: Views):
    return X.normalised(v.counts()).select("cell_id", "gene_id", r6("value"))


@query("j5_counts_per_million", sql("counts", "SELECT cell_id, gene_id, round(value / greatest(total, 1) * 1000000, 4) AS value FROM counts JOIN (SELECT cell_id, sum(value) AS total FROM counts GROUP BY 1) USING (cell_id)"))
def _(v: Views):
    return X.cpm(v.counts()).select("cell_id", "gene_id", F.round("value", 4).alias("value"))


@query("f16_group_means", sql("counts cells", "SELECT grp, gene_id, round(mean, 6) AS mean FROM m", g=GRP, m=_MEANS))
def _(v: Views):
    return X.group_means(v.counts(), groups(v)).select("grp", "gene_id", r6("mean"))


@query("f17_merged_groups", sql("counts cells", "SELECT name, gene_id, round(sum(mean * n_cells) / any_value(n), 6) AS mean FROM m JOIN names USING (grp) JOIN (SELECT name, sum(n) AS n FROM (SELECT grp, count(*) AS n FROM g GROUP BY 1) JOIN names USING (grp) GROUP BY 1) USING (name) GROUP BY 1, 2", g=GRP, m=_MEANS, names="SELECT grp, CASE WHEN grp < 2 THEN 'low' ELSE 'high' END AS name FROM (SELECT DISTINCT grp FROM g)"))
def _(v: Views):
    g = groups(v)
    names = g.select("grp").distinct().withColumn("name", F.when(F.col("grp") < 2, "low").otherwise("high"))
    return X.merged_groups(X.group_means(v.counts(), g), names).select("name", "gene_id", r6("mean"))


@query("f18_dot_plot", sql("counts cells genes", "SELECT grp, name, round(pct, 6) AS pct, round(mean, 6) AS mean FROM m JOIN genes USING (gene_id) WHERE brand = 'Brand#12'", g=GRP, m=_MEANS))
def _(v: Views):
    pick = v.genes().where("brand = 'Brand#12'").select("gene_id", "name")
    return X.group_means(v.counts().join(pick, "gene_id", "left_semi"), groups(v)).join(pick, "gene_id").select("grp", "name", r6("pct"), r6("mean"))


_VAR = f"SELECT gene_id, sum(value) / {_N} AS mean, greatest(sum(value * value) / {_N} - (sum(value) / {_N}) ** 2, 0) AS variance FROM counts GROUP BY 1"


@query("f19_gene_variance", sql("counts cells", "SELECT gene_id, round(mean, 6) AS mean, round(variance, 5) AS variance FROM t", t=_VAR))
def _(v: Views):
    return X.gene_moments(v.counts(), n_cells(v)).select("gene_id", r6("mean"), F.round("variance", 5).alias("variance"))


@query("l2_variable_genes", sql("counts cells", "SELECT gene_id FROM t ORDER BY round(variance, 9) DESC, gene_id LIMIT 100", t=_VAR))
def _(v: Views):
    return X.gene_moments(v.counts(), n_cells(v)).orderBy(F.desc(F.round("variance", 9)), "gene_id").limit(100).select("gene_id")


@query("l3_scaled", sql("counts cells", f"SELECT cell_id, gene_id, round(least((value - mean) / sd, 10), 5) AS value, round(least(-mean / sd, 10), 5) AS zero FROM counts JOIN (SELECT gene_id, mean, CASE WHEN variance > 0 THEN sqrt(variance * ({_N} * 1.0 / ({_N} - 1))) ELSE 1 END AS sd FROM t) USING (gene_id)", t=_VAR))
def _(v: Views):
    return X.scaled(v.counts(), n_cells(v)).select("cell_id", "gene_id", F.round("value", 5).alias("value"), F.round("zero", 5).alias("zero"))


@query("l5_constant_genes_dropped", sql("counts cells", "SELECT count(DISTINCT gene_id) AS genes FROM t WHERE variance > 0", t=_VAR))
def _(v: Views):
    return X.drop_constant_genes(v.counts(), n_cells(v)).agg(F.countDistinct("gene_id").alias("genes"))


@query("l1_dispersion_genes")
def _(v: Views):
    return M.dispersion_genes(X.normalised(v.counts()), n_cells(v), 200)


@query("l1_regularised_genes")
def _(v: Views):
    return M.regularised_genes(v.counts(), n_cells(v), 200)


@query("g5_top_per_group", sql("counts cells", "SELECT grp, gene_id, nth FROM (SELECT grp, gene_id, CAST(row_number() OVER (PARTITION BY grp ORDER BY round(mean, 9) DESC, gene_id) AS INTEGER) AS nth FROM m) WHERE nth <= 10", g=GRP, m=_MEANS))
def _(v: Views):
    m = X.group_means(v.counts(), groups(v)).withColumn("score", F.round("mean", 9))
    return X.top_per_group(m, 10).select("grp", "gene_id", "nth")


@query("g6_first_group_markers", sql("counts cells", "SELECT grp, gene_id FROM (SELECT *, min(grp) OVER (PARTITION BY gene_id) AS f FROM (SELECT grp, gene_id, row_number() OVER (PARTITION BY grp ORDER BY round(mean, 9) DESC, gene_id) AS nth FROM m) WHERE nth <= 25) WHERE grp = f", g=GRP, m=_MEANS))
def _(v: Views):
    m = X.group_means(v.counts(), groups(v)).withColumn("score", F.round("mean", 9))
    return X.first_group_only(X.top_per_group(m, 25)).select("grp", "gene_id")


@query("g8_z_across_groups", sql("counts cells", "SELECT grp, gene_id, round(least(greatest((mean - mu) / sd, -2.5), 2.5), 5) AS z FROM m JOIN (SELECT gene_id, sum(mean) / 4 AS mu, CASE WHEN greatest((sum(mean * mean) - 4 * (sum(mean) / 4) ** 2) / 3, 0) > 1e-18 THEN sqrt(greatest((sum(mean * mean) - 4 * (sum(mean) / 4) ** 2) / 3, 0)) ELSE 1 END AS sd FROM m GROUP BY 1) USING (gene_id)", g=GRP, m=_MEANS))
def _(v: Views):
    return X.z_across_groups(X.group_means(v.counts(), groups(v)), 4).select("grp", "gene_id", F.round("z", 5).alias("z"))


@query(
    "k12_fold_change_markers",
    sql("counts cells", f"SELECT grp, gene_id, round(CASE WHEN p / n >= 0.05 THEN s / n - (t - s) / ({_N} - n) ELSE 0 END, 6) AS score FROM (SELECT grp, gene_id, sum(value) AS s, count(*) FILTER (value > 0) AS p FROM counts JOIN g USING (cell_id) GROUP BY 1, 2) JOIN (SELECT gene_id, sum(value) AS t FROM counts GROUP BY 1) USING (gene_id) JOIN (SELECT grp, count(*) AS n FROM g GROUP BY 1) USING (grp)", g=GRP),
)
def _(v: Views):
    return X.fold_change_markers(v.counts(), groups(v)).select("grp", "gene_id", r6("score"))


_DENSE = "SELECT c.cell_id, c.grp, x.gene_id, coalesce(k.value, 0) AS value FROM g c CROSS JOIN (SELECT DISTINCT gene_id FROM counts) x LEFT JOIN counts k ON k.cell_id = c.cell_id AND k.gene_id = x.gene_id"
_RANK = "SELECT *, rank() OVER (PARTITION BY gene_id ORDER BY value) + (count(*) OVER (PARTITION BY gene_id, value) - 1) / 2.0 AS r FROM d"


@query(
    "k11_rank_sum_markers",
    sql("counts cells", f"SELECT grp, gene_id, round(sum(r) - count(*) * (count(*) + 1) / 2.0, 4) AS u, round((sum(r) - count(*) * (count(*) + 1) / 2.0 - count(*) * ({_N} - count(*)) / 2.0) / sqrt(count(*) * ({_N} - count(*)) / 12.0 * (({_N} + 1) - any_value(ties) / ({_N} * ({_N} - 1.0)))), 4) AS z FROM r JOIN (SELECT gene_id, sum(t ** 3 - t) AS ties FROM (SELECT gene_id, value, count(*) AS t FROM d GROUP BY 1, 2) GROUP BY 1) USING (gene_id) GROUP BY 1, 2 HAVING max(value) > 0", g=GRP, d=_DENSE, r=_RANK),
)
def _(v: Views):
    return X.rank_sum_markers(v.counts(), groups(v)).select("grp", "gene_id", F.round("u", 4).alias("u"), F.round("z", 4).alias("z"))


@query("b4_marker_table")
def _(v: Views):
    return X.marker_table(v.counts(), groups(v), v.genes().select("gene_id", "name"), 20)


@query("n9_expression_value", sql("counts genes", "SELECT cell_id, round(sum(ln(1 + value)) / (SELECT count(*) FROM genes WHERE brand = 'Brand#13'), 6) AS value FROM counts WHERE gene_id IN (SELECT gene_id FROM genes WHERE brand = 'Brand#13') GROUP BY 1"))
def _(v: Views):
    pick = v.genes().where("brand = 'Brand#13'")
    return X.expression_value(v.counts(), pick, pick.count()).select("cell_id", r6("value"))


@query("k13_panel_scores")
def _(v: Views):
    return X.panel_scores(X.normalised(v.counts()), v.genes().where("brand in ('Brand#11', 'Brand#21')").select(F.col("brand").alias("panel"), "gene_id"))


_PAIRS = "SELECT p_partkey AS a, p_partkey + 1 AS b FROM part"


@query("f13_impossible_coexpression", sql("counts cells", f"SELECT a, b, round(count(k2.cell_id) / {_N}, 6) AS rate FROM p LEFT JOIN counts k1 ON k1.gene_id = a AND k1.value > 0 LEFT JOIN counts k2 ON k2.gene_id = b AND k2.cell_id = k1.cell_id AND k2.value > 0 GROUP BY 1, 2", p=_PAIRS))
def _(v: Views):
    pairs = v.table("part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return X.coexpression(v.counts(), pairs, n_cells(v)).select("a", "b", r6("rate"))


_TOP = "SELECT gene_id FROM v ORDER BY round(variance, 9) DESC, gene_id LIMIT 200"
_EDGE = "SELECT cell_id AS a, cell_id + 1 AS b FROM cells WHERE cell_id + 1 IN (SELECT cell_id FROM cells)"


@query(
    "f14_neighbour_divergence",
    sql("counts cells", "SELECT count(*) AS pairs, round(avg(sqrt(d)), 6) AS divergence FROM (SELECT a, b, sum((sqrt(coalesce(x.p, 0)) - sqrt(coalesce(y.p, 0))) ** 2) / 2 AS d FROM e CROSS JOIN t LEFT JOIN p x ON x.cell_id = a AND x.gene_id = t.gene_id LEFT JOIN p y ON y.cell_id = b AND y.gene_id = t.gene_id GROUP BY 1, 2)",
        v=_VAR, t=_TOP, e=_EDGE, p="SELECT cell_id, gene_id, value / sum(value) OVER (PARTITION BY cell_id) AS p FROM counts WHERE gene_id IN (SELECT gene_id FROM t)"),
)
def _(v: Views):
    genes = X.gene_moments(v.counts(), n_cells(v)).orderBy(F.desc(F.round("variance", 9)), "gene_id").limit(200)
    cells = v.table("supplier").select(F.col("s_suppkey").alias("a"))
    pairs = cells.withColumn("b", F.col("a") + 1).join(cells.select(F.col("a").alias("b")), "b", "left_semi")
    return X.neighbour_divergence(v.counts(), pairs, genes).select("pairs", r6("divergence"))


@query("f15_marker_survival", sql("counts genes cells", "SELECT roi, round(count(*) FILTER (n >= 200 AND marker / total >= 0.035) / nullif(count(*) FILTER (marker / total >= 0.035), 0), 6) AS survival, count(*) FILTER (marker > 0) AS any_marker FROM (SELECT cell_id, coalesce(sum(value) FILTER (brand IN ('Brand#11', 'Brand#12')), 0) AS marker, sum(value) AS total, count(*) AS n FROM counts JOIN genes USING (gene_id) GROUP BY 1) JOIN cells USING (cell_id) GROUP BY 1"))
def _(v: Views):
    from ..operators.metrics import survival

    m = v.counts().join(v.genes(), "gene_id").groupBy("cell_id").agg(F.sum(F.when(F.col("brand").isin("Brand#11", "Brand#12"), F.col("value")).otherwise(0.0)).alias("marker"), F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    return survival(m.join(v.cells(), "cell_id"), "roi", F.col("n") >= 200, 0.035).withColumn("survival", F.round("survival", 6))


@query("f22_near_far_fold", sql("points counts", "SELECT near, round(avg(coalesce(value, 0)), 6) AS mean, count(*) AS n FROM (SELECT id, x < 3000 AS near FROM points) LEFT JOIN (SELECT gene_id, sum(value) AS value FROM counts GROUP BY 1) ON gene_id = id GROUP BY 1"))
def _(v: Views):
    t = v.counts().groupBy(F.col("gene_id").alias("id")).agg(F.sum("value").alias("value"))
    p = v.points().select("id", (F.col("x") < 3000).alias("near")).join(t, "id", "left")
    return p.groupBy("near").agg(F.round(F.avg(F.coalesce("value", F.lit(0.0))), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("l4_pca_scores")
def _(v: Views):
    return M.pca(v.vectors(), 4)


@query(
    "l6_nearest_vectors",
    sql("vectors", "SELECT id, near, nth FROM (SELECT a.id, b.id AS near, CAST(row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.v, b.v), 9), b.id) AS INTEGER) AS nth FROM vectors a JOIN vectors b ON a.id <> b.id) WHERE nth <= 5"),
)
def _(v: Views):
    vectors = v.vectors()
    return M.nearest_vectors(vectors, vectors, 5).select("id", "near", "nth")


@query("l9_graph_clusters")
def _(v: Views):
    vectors = v.vectors()
    near = M.nearest_vectors(vectors, vectors, 10)
    return M.cluster_graph(near.select(F.col("id").alias("src"), F.col("near").alias("dst"), F.lit(1.0).alias("weight")), [0.3, 1.0])


@query("l10_resolution_search")
def _(v: Views):
    vectors = v.vectors()
    near = M.nearest_vectors(vectors, vectors, 10).select(F.col("id").alias("src"), F.col("near").alias("dst"), F.lit(1.0).alias("weight"))
    return v.spark.createDataFrame([M.resolution_for(near, 8)], "resolution double, clusters int")


@query("l11_kmeans")
def _(v: Views):
    return M.kmeans(v.vectors(), 5, 42)


@query("g9_share_within_partition", sql("counts genes", "SELECT panel, gene_id, round(total / sum(total) OVER (PARTITION BY panel), 9) AS share FROM (SELECT panel, gene_id, sum(value) AS total FROM counts JOIN genes USING (gene_id) GROUP BY 1, 2)"))
def _(v: Views):
    t = v.counts().join(v.genes(), "gene_id").groupBy("panel", "gene_id").agg(F.sum("value").alias("total"))
    return t.select("panel", "gene_id", F.round(F.col("total") / F.sum("total").over(Window.partitionBy("panel")), 9).alias("share"))
