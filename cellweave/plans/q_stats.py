"""Ranks, tests and scores (survey sections G1-G4, G10, G17-G18, K1-K5, K8-K9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embed as M
from ..operators import stats as T
from .registry import query
from .views import Views, sql

r6 = lambda c: F.round(c, 6).alias(c)
_SITE = "SELECT method, site, sum(value) AS total FROM bins JOIN cells USING (cell_id) GROUP BY 1, 2"


def per_site(v: Views):
    return v.bins().join(v.cells(), "cell_id").groupBy("method", "site").agg(F.sum("value").alias("total"))


def _rank(value: str, by: str, src: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"SELECT *, rank() OVER ({part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{value}) - 1) / 2.0 AS r FROM {src}"


@query("g1_average_ranks", sql("pixels", 'SELECT "row", col, value, CAST(r AS DOUBLE) AS r FROM t', s='SELECT "row", col, max(value) AS value FROM pixels GROUP BY 1, 2', t=_rank("value", "col", "s")))
def _(v: Views):
    t = v.pixels().groupBy("row", "col").agg(F.max("value").alias("value"))
    return t.withColumn("r", T.average_rank("value", ["col"]).cast("double"))


_P = 'SELECT col, "row", (1 + sum(value)) / 40000.0::DOUBLE AS p FROM pixels GROUP BY 1, 2'


@query("g2_simple_adjusted_p", sql("pixels", 'SELECT col, "row", round(least(p * n / r, 1), 9) AS q FROM (SELECT *, count(*) OVER (PARTITION BY col) AS n FROM t)', s=_P, t=_rank("p", "col", "s")))
def _(v: Views):
    from pyspark.sql.window import Window

    t = v.pixels().groupBy("col", "row").agg(((1 + F.sum("value")) / 40000.0).alias("p"))
    n = F.count(F.lit(1)).over(Window.partitionBy("col"))
    return t.select("col", "row", F.round(T.adjusted_simple("p", n, T.average_rank("p", ["col"])), 9).alias("q"))


@query("g2b_benjamini_hochberg", sql("pixels", 'SELECT col, "row", round(least(min(raw) OVER (PARTITION BY col ORDER BY p DESC), 1), 9) AS q FROM (SELECT *, p * count(*) OVER (PARTITION BY col) / rank() OVER (PARTITION BY col ORDER BY p) AS raw FROM s)', s=_P))
def _(v: Views):
    t = v.pixels().groupBy("col", "row").agg(((1 + F.sum("value")) / 40000.0).alias("p"))
    return T.benjamini_hochberg(t, "p", ["col"]).select("col", "row", F.round("q", 9).alias("q"))


@query("g3_method_ranks", sql("bins cells", "SELECT method, site, CAST(r AS DOUBLE) AS r FROM t", s=_SITE, t=_rank("total", "site", "s")))
def _(v: Views):
    return per_site(v).select("method", "site", T.average_rank("total", ["site"]).cast("double").alias("r"))


@query("g4_components_kept", "SELECT CAST(least(greatest(coalesce(min(pc) FILTER (run >= 0.85), 1), 10), 50) AS INTEGER) AS n_pcs FROM (SELECT pc, sum(ratio) OVER (ORDER BY pc) AS run FROM (SELECT p_size AS pc, count(*) * 1.0 / (SELECT count(*) FROM part) AS ratio FROM part GROUP BY 1))")
def _(v: Views):
    n = v.table("part").count()
    t = v.table("part").groupBy(F.col("p_size").alias("pc")).agg((F.count(F.lit(1)) / n).alias("variance_ratio"))
    return M.components_kept(t)


@query("g10_max_normalised", sql("bins cells", "SELECT method, site, round(total / max(total) OVER (), 6) AS share FROM s", s=_SITE))
def _(v: Views):
    t = per_site(v)
    return t.crossJoin(F.broadcast(t.agg(F.max("total").alias("m")))).select("method", "site", F.round(F.col("total") / F.col("m"), 6).alias("share"))


@query("g17_min_max", sql("bins cells", "SELECT method, site, round((total - min(total) OVER ()) / (max(total) OVER () - min(total) OVER ()), 6) AS a, round(1 - (n - min(n) OVER ()) / CAST(max(n) OVER () - min(n) OVER () AS DOUBLE), 6) AS b FROM (SELECT method, site, sum(value) AS total, count(*) AS n FROM bins JOIN cells USING (cell_id) GROUP BY 1, 2)"))
def _(v: Views):
    t = v.bins().join(v.cells(), "cell_id").groupBy("method", "site").agg(F.sum("value").alias("a"), F.count(F.lit(1)).cast("double").alias("b"))
    return T.min_max(t, ["a", "b"], ("b",)).select("method", "site", r6("a"), r6("b"))


@query("g18_whisker_tops", "SELECT event_type, round(least(q3 + 1.5 * (q3 - q1), m), 6) AS top FROM (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, max(value) AS m FROM events GROUP BY 1)")
def _(v: Views):
    return T.whisker_tops(v.table("events"), "value", "event_type").select("event_type", r6("top"))


_TWO = "SELECT subtype, id % 2 = 0 AS side, floor(x / 10) AS value FROM points"


@query(
    "k1_mann_whitney",
    sql("points", "SELECT subtype, round(rs - n1 * (n1 + 1) / 2.0, 4) AS u, round(1 - 2 * (rs - n1 * (n1 + 1) / 2.0) / (n1 * (n - n1)), 6) AS effect, round((rs - n1 * (n1 + 1) / 2.0 - n1 * (n - n1) / 2.0) / sqrt(n1 * (n - n1) / 12.0 * (n + 1 - ties / (n * (n - 1.0)))), 6) AS z FROM (SELECT subtype, sum(r) FILTER (side) AS rs, count(*) FILTER (side) AS n1, count(*) AS n FROM t GROUP BY 1) JOIN (SELECT subtype, sum(t ** 3 - t) AS ties FROM (SELECT subtype, value, count(*) AS t FROM s GROUP BY 1, 2) GROUP BY 1) USING (subtype)", s=_TWO, t=_rank("value", "subtype", "s")),
)
def _(v: Views):
    p = v.points().select("subtype", (F.col("id") % 2 == 0).alias("side"), F.floor(F.col("x") / 10).cast("double").alias("value"))
    return T.mann_whitney(p, "value", "side", ["subtype"]).select("subtype", F.round("u", 4).alias("u"), r6("effect"), r6("z"))


@query("k2_grouped_mann_whitney_p")
def _(v: Views):
    p = v.points().select("subtype", (F.col("id") % 2 == 0).alias("side"), F.floor(F.col("x") / 10).cast("double").alias("value"))
    return T.mann_whitney(p, "value", "side", ["subtype"])


_PAIR = "SELECT a.method AS ma, b.method AS mb, a.site, a.total - b.total AS d, abs(a.total - b.total) AS value FROM s a JOIN s b ON a.site = b.site AND a.method < b.method WHERE a.total <> b.total"


@query("k3_signed_rank", sql("bins cells", "SELECT ma, mb, count(*) AS n, round(least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)), 4) AS w FROM t GROUP BY 1, 2", s=_SITE, u=_PAIR, t=_rank("value", "ma, mb", "u")))
def _(v: Views):
    t = per_site(v)
    b = t.select("site", F.col("method").alias("mb"), F.col("total").alias("y"))
    pairs = t.select("site", F.col("method").alias("ma"), F.col("total").alias("x")).join(b, "site").where("ma < mb")
    return T.signed_rank(pairs, "x", "y", ["ma", "mb"]).select("ma", "mb", "n", F.round("w", 4).alias("w"))


@query(
    "k4_friedman",
    sql("bins cells", "SELECT round((12.0 / (n * 3 * 4) * q - 3.0 * n * 4) / (1 - ties / (n * 24.0)), 6) AS chi2, n AS blocks FROM (SELECT sum(s * s) AS q FROM (SELECT method, sum(r) AS s FROM t GROUP BY 1)), (SELECT count(DISTINCT site) AS n FROM t), (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*) AS c FROM s GROUP BY site, total))", s=_SITE, t=_rank("total", "site", "s")),
)
def _(v: Views):
    return T.friedman(per_site(v), "site", "method", "total").select(F.round("chi2", 6).alias("chi2"), "blocks")


@query("k5_spearman", sql("points", "SELECT subtype, round(corr(rx, ry), 6) AS rho FROM (SELECT subtype, rank() OVER (PARTITION BY subtype ORDER BY x) + (count(*) OVER (PARTITION BY subtype, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY subtype ORDER BY y) + (count(*) OVER (PARTITION BY subtype, y) - 1) / 2.0 AS ry FROM points) GROUP BY 1"))
def _(v: Views):
    return T.spearman(v.points(), "x", "y", ["subtype"]).select("subtype", r6("rho"))


_M = "SELECT method, site AS roi, sum(CASE WHEN in_tissue THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS a1_capture, sum(value) / count(DISTINCT gene_id) AS a1_umi_density, quantile_cont(value, 0.5) * 12 AS a2_median_umi, quantile_cont(value, 0.75) * 5 AS a3_median_genes, 0.01 * (count(*) % 7) AS c1_coexpr, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE 0.1 * (count(*) % 9) END AS ned, 0.05 * (count(*) % 11) AS d1_silhouette, 0.9 - 0.02 * (count(*) % 13) AS e1_immune_survival FROM bins JOIN cells USING (cell_id) GROUP BY 1, 2"
_NORMS = (
    "SELECT *, least(greatest(a1_umi_density / max(a1_umi_density) OVER (), 0), 1) AS a1d_norm, CASE WHEN a2_median_umi > 0 THEN least(greatest(ln(greatest(a2_median_umi, 1)) / ln(1000), 0), 1) ELSE 0 END AS a2_norm, "
    "least(greatest(a3_median_genes / 300, 0), 1) AS a3_norm, least(greatest(1 - c1_coexpr, 0), 1) AS c1_norm, least(greatest(ned, 0), 1) AS ned0, least(greatest((d1_silhouette + 1) / 2, 0), 1) AS d1_norm, least(greatest(e1_immune_survival, 0), 1) AS e1_norm FROM m"
)


def metric_rows(v: Views):
    rows = v.bins().join(v.cells(), "cell_id").select("method", F.col("site").alias("roi"), "gene_id", "value", F.col("in_tissue").cast("int").alias("in"))
    # quantiles over counted values; a distinct count in the same aggregate would keep a buffer of values per gene
    each = rows.groupBy("method", "roi", "value").agg(F.count(F.lit(1)).alias("c"), F.sum("in").alias("in"))
    quantile = lambda p: F.percentile("value", p, F.col("c"))
    n = F.sum("c")
    t = each.groupBy("method", "roi").agg((F.sum("in") / n).alias("a1_capture"), F.sum(F.col("value") * F.col("c")).alias("_s"), (quantile(0.5) * 12).alias("a2_median_umi"), (quantile(0.75) * 5).alias("a3_median_genes"), n.alias("n"))
    genes = rows.groupBy("method", "roi").agg(F.countDistinct("gene_id").alias("_g"))
    t = t.join(genes, ["method", "roi"]).withColumn("a1_umi_density", F.col("_s") / F.col("_g")).drop("_s", "_g")
    k = lambda m: (F.col("n") % m).cast("double")
    return t.select("*", (0.01 * k(7)).alias("c1_coexpr"), F.when(F.col("n") % 5 != 0, 0.1 * k(9)).alias("ned"), (0.05 * k(11)).alias("d1_silhouette"), (0.9 - 0.02 * k(13)).alias("e1_immune_survival")).drop("n")


_NED = "CASE WHEN ned IS NULL THEN NULL ELSE ned0 END"


@query("k8_composite_score", sql("bins cells", f"SELECT method, roi, round(cap, 6) AS capture_score, round(pur, 6) AS purity_score, round(least(greatest(0.65 * sqrt(least(greatest(cap, 0), 1) * least(greatest(pur, 0), 1)) + 0.35 * d1_norm, 0), 1), 6) AS tas FROM (SELECT *, (2 * a1d_norm + a2_norm + a3_norm) / 4 AS cap, sqrt(c1_norm * coalesce({_NED}, c1_norm)) AS pur FROM n)", m=_M, n=_NORMS))
def _(v: Views):
    return T.composite(metric_rows(v)).select("method", "roi", r6("capture_score"), r6("purity_score"), r6("tas"))


@query("k9_composite_v2", sql("bins cells", f"SELECT method, roi, round(least(greatest(0.65 * sqrt(least(cap, 1) * least(pur, 1)) + 0.2 * d1_norm + 0.15 * e1_norm, 0), 1), 6) AS tas FROM (SELECT *, (a1d_norm + a2_norm + a3_norm) / 3 AS cap, sqrt(c1_norm * coalesce({_NED}, 0.5)) AS pur FROM n)", m=_M, n=_NORMS))
def _(v: Views):
    return T.composite_v2(metric_rows(v)).select("method", "roi", r6("tas"))
