"""Labels of cells and clusters (survey sections G11-G15, L12-L14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate as A
from ..operators import expression as X
from .registry import query
from .views import Views, sql

r6 = lambda c: F.round(c, 6).alias(c)
_VOTE = "SELECT CAST(c_nationkey AS INTEGER) AS cluster, c_mktsegment AS label, (c_custkey % 100) / 100.0 AS confidence FROM customer"
_MAJ = "SELECT cluster, label, n / t AS share, confidence FROM (SELECT cluster, label, n, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS k FROM (SELECT cluster, label, count(*) AS n FROM votes GROUP BY 1, 2)) JOIN (SELECT cluster, count(*) AS t, avg(confidence) AS confidence FROM votes GROUP BY 1) USING (cluster) WHERE k = 1"


def votes(v: Views):
    return v.table("customer").select(F.col("c_nationkey").cast("int").alias("cluster"), F.col("c_mktsegment").alias("label"), ((F.col("c_custkey") % 100) / 100.0).alias("confidence"))


@query("g12_majority_label", sql("", "SELECT cluster, label, round(share, 6) AS share, round(confidence, 6) AS confidence FROM m", votes=_VOTE, m=_MAJ))
def _(v: Views):
    return A.majority(votes(v)).select("cluster", "label", r6("share"), r6("confidence"))


_SCORES = "SELECT CAST(cell_id % 8 AS INTEGER) AS grp, panel, round(avg(value), 9) AS score FROM counts JOIN genes USING (gene_id) GROUP BY 1, 2"


def panel_scores(v: Views):
    s = v.counts().join(v.genes(), "gene_id").groupBy((F.col("cell_id") % 8).cast("int").alias("grp"), "panel").agg(F.round(F.avg("value"), 9).alias("score"))
    return s.withColumn("ord", F.col("panel"))


@query("g11_best_panel", sql("counts genes", "SELECT grp, CASE WHEN score > 26 THEN panel END AS panel, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, panel) AS k FROM s) WHERE k = 1", s=_SCORES))
def _(v: Views):
    return A.best_panel(panel_scores(v), 26.0).select("grp", "panel", r6("score"))


@query("g13_priority_type", sql("counts genes", "SELECT cell_id, CASE WHEN greatest(a, b, c) <= 0 THEN 'other' WHEN a > 0 AND a + 5 >= greatest(a, b, c) THEN 'A' WHEN b = greatest(a, b, c) THEN 'B' ELSE 'C' END AS kind FROM (SELECT cell_id, coalesce(max(value) FILTER (brand = 'Brand#11'), 0) AS a, coalesce(max(value) FILTER (brand = 'Brand#22'), 0) AS b, coalesce(max(value) FILTER (brand = 'Brand#33'), 0) AS c FROM counts JOIN genes USING (gene_id) GROUP BY 1)"))
def _(v: Views):
    top = lambda b: F.max(F.when(F.col("brand") == b, F.col("value")).otherwise(0.0))
    m = v.counts().join(v.genes(), "gene_id").groupBy("cell_id").agg(top("Brand#11").alias("a"), top("Brand#22").alias("b"), top("Brand#33").alias("c"))
    return m.select("cell_id", A.priority_type({"A": F.col("a"), "B": F.col("b"), "C": F.col("c")}, "A", 5.0).alias("kind"))


@query("g14_highest_group", sql("counts cells", "SELECT grp, round(top, 6) AS top FROM (SELECT grp, max(m) AS top FROM (SELECT CAST(cell_id % 6 AS INTEGER) AS grp, gene_id, round(sum(value) / any_value(n), 9) AS m FROM counts JOIN (SELECT cell_id % 6 AS g, count(*) AS n FROM cells GROUP BY 1) ON g = cell_id % 6 GROUP BY 1, 2) GROUP BY 1) ORDER BY top DESC, grp LIMIT 1"))
def _(v: Views):
    g = v.table("supplier").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_suppkey") % 6).cast("int").alias("grp"))
    m = X.group_means(v.counts(), g).withColumn("mean", F.round("mean", 9))
    return A.highest_group(m).select("grp", r6("top"))


@query("g15_marker_types", sql("counts genes cells", "SELECT grp, panel, round(sum(x) / any_value(n), 5) AS score FROM (SELECT cell_id, CAST(cell_id % 6 AS INTEGER) AS grp, panel, max(value / mu) AS x FROM counts JOIN genes USING (gene_id) JOIN (SELECT gene_id, sum(value) / (SELECT count(*) FROM cells) AS mu FROM counts GROUP BY 1) USING (gene_id) GROUP BY 1, 2, 3) JOIN (SELECT cell_id % 6 AS g, count(*) AS n FROM cells GROUP BY 1) ON g = grp GROUP BY 1, 2"))
def _(v: Views):
    g = v.table("supplier").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_suppkey") % 6).cast("int").alias("grp"))
    n = v.table("supplier").count()
    return A.marker_types(v.counts(), g, v.genes().select("panel", "gene_id"), n).select("grp", "panel", F.round("score", 5).alias("score"))


_OTHER = "SELECT CAST(s_nationkey AS INTEGER) AS cluster, CASE WHEN s_suppkey % 2 = 0 THEN 'Non-immune' ELSE 'T cell' END AS label, (s_suppkey % 10) / 10.0 AS confidence FROM supplier"


@query("l12_dual_annotation", sql("", "SELECT t.cluster, CASE WHEN i.label <> 'Non-immune' AND i.confidence >= 0.5 THEN i.label ELSE t.label END AS label, round(CASE WHEN i.label <> 'Non-immune' AND i.confidence >= 0.5 THEN i.confidence ELSE t.confidence END, 6) AS confidence FROM m t LEFT JOIN i USING (cluster)", votes=_VOTE, m=_MAJ, o=_OTHER, i=_MAJ.replace("votes", "o")))
def _(v: Views):
    o = v.table("supplier").select(F.col("s_nationkey").cast("int").alias("cluster"), F.when(F.col("s_suppkey") % 2 == 0, "Non-immune").otherwise("T cell").alias("label"), ((F.col("s_suppkey") % 10) / 10.0).alias("confidence"))
    return A.dual_rule(A.majority(votes(v)), A.majority(o)).select("cluster", "label", r6("confidence"))


@query("l13_panel_refinement", sql("counts genes", "SELECT cluster, label, coalesce(p, label) AS refined, confidence < 0.7 AS uncertain FROM m LEFT JOIN (SELECT cluster, CASE WHEN score > 20 THEN panel END AS p FROM (SELECT m.cluster, s.panel, s.score, row_number() OVER (PARTITION BY m.cluster ORDER BY s.score DESC, s.panel) AS k FROM m JOIN w ON contains(lower(m.label), w.keyword) JOIN s ON s.grp = m.cluster AND s.panel = w.panel) WHERE k = 1) USING (cluster)", votes=_VOTE, m=_MAJ, s=_SCORES, w="SELECT * FROM (VALUES ('build', 'ECONOMY'), ('build', 'PROMO'), ('house', 'SMALL'), ('mach', 'LARGE'), ('auto', 'STANDARD')) t(keyword, panel)"))
def _(v: Views):
    words = [("build", "ECONOMY"), ("build", "PROMO"), ("house", "SMALL"), ("mach", "LARGE"), ("auto", "STANDARD")]
    keywords = v.spark.createDataFrame(words, "keyword string, panel string")
    return A.refine(A.majority(votes(v)), panel_scores(v), keywords, 20.0)


@query("l14_fine_relabel", sql("", "SELECT cluster, CASE WHEN i.confidence >= 0.45 THEN i.label || '|act' ELSE m.label || '|act' END AS label FROM m LEFT JOIN i USING (cluster)", votes=_VOTE, m=_MAJ, o=_OTHER, i=_MAJ.replace("votes", "o")))
def _(v: Views):
    o = v.table("supplier").select(F.col("s_nationkey").cast("int").alias("cluster"), F.when(F.col("s_suppkey") % 2 == 0, "Non-immune").otherwise("T cell").alias("label"), ((F.col("s_suppkey") % 10) / 10.0).alias("confidence"))
    base = A.majority(votes(v)).select("cluster", F.concat("label", F.lit("|act")).alias("label"))
    return A.relabel(base, A.majority(o), 0.45)


@query("c12b_cluster_labels_applied", sql("", "SELECT c_custkey AS id, coalesce(m.label, 'Unknown') AS cell_type FROM customer LEFT JOIN m ON m.cluster = c_nationkey AND m.cluster % 3 <> 0", votes=_VOTE, m=_MAJ))
def _(v: Views):
    cells = v.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("int").alias("cluster"))
    return A.apply_labels(cells, A.majority(votes(v)).where("cluster % 3 <> 0")).select("id", "cell_type")
