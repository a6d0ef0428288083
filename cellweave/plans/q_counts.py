"""Counts, quality control and filters (survey sections D4-D19, F1-F12, F31-F34, H, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import counts as C
from ..operators import export as E
from ..operators import joins as J
from .registry import query
from .views import Views, sql

r6 = lambda c: F.round(c, 6).alias(c)

METRICS = (
    "SELECT cell_id, sum(value) AS total, count(*) FILTER (value > 0) AS n_genes, coalesce(sum(value) FILTER (mito), 0.0) AS flagged_total, "
    "coalesce(100 * coalesce(sum(value) FILTER (mito), 0.0) / nullif(sum(value), 0), 0) AS pct_flagged FROM counts JOIN genes USING (gene_id) GROUP BY 1"
)


def metrics(v: Views):
    return C.qc_metrics(v.counts(), v.genes().select("gene_id", "mito"))


@query(
    "roi_summary",
    sql("counts genes cells", "SELECT roi, count(*) AS n_cells, count(*) FILTER (n_genes >= 20 AND total >= 5 AND pct_flagged <= 80) AS n_pass, quantile_cont(total, 0.5) AS median_counts, quantile_cont(CAST(n_genes AS DOUBLE), 0.5) AS median_genes, round(avg(pct_flagged), 6) AS mean_pct FROM m JOIN cells USING (cell_id) GROUP BY 1", m=METRICS),
)
def _(v: Views):
    ok = C.qc_pass(min_genes=20, min_counts=5, max_pct=80)
    m = metrics(v).join(v.cells(), "cell_id")
    return m.groupBy("roi").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(ok).alias("n_pass"), F.percentile("total", 0.5).alias("median_counts"), F.percentile("n_genes", 0.5).alias("median_genes"), F.round(F.avg("pct_flagged"), 6).alias("mean_pct"))


@query("f1_count_aggregation", sql("counts", "SELECT * FROM counts"))
def _(v: Views):
    return C.cell_counts(v.bins())


@query("f2_weighted_aggregation", "SELECT l_suppkey AS cell_id, l_partkey AS gene_id, round(sum(l_quantity * l_discount), 6) AS value FROM lineitem GROUP BY 1, 2")
def _(v: Views):
    b = v.table("lineitem").select(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"), F.col("l_quantity").alias("value"), F.col("l_discount").alias("w"))
    return C.cell_counts(b, "w").withColumn("value", F.round("value", 6))


@query("f3_bins_per_cell", sql("bins", "SELECT cell_id, count(*) AS n_bins FROM bins GROUP BY 1"))
def _(v: Views):
    return v.bins().groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_bins"))


@query("f5_qc_metrics", sql("counts genes", "SELECT cell_id, total, n_genes, flagged_total, round(pct_flagged, 6) AS pct_flagged, round(CASE WHEN total > 0 AND total <> 1 AND n_genes > 0 THEN log10(n_genes) / log10(total) ELSE 0 END, 6) AS complexity FROM m", m=METRICS))
def _(v: Views):
    return metrics(v).select("cell_id", "total", "n_genes", "flagged_total", r6("pct_flagged"), r6("complexity"))


@query("f6_dataset_comparison", sql("counts genes cells", "SELECT roi, count(*) AS n_cells, sum(total) AS total, round(avg(total), 6) AS mean_counts, quantile_cont(total, 0.5) AS median_counts, round(avg(n_genes), 6) AS mean_genes, quantile_cont(CAST(n_genes AS DOUBLE), 0.5) AS median_genes, quantile_cont(total, 0.25) AS q1_counts, quantile_cont(total, 0.75) AS q3_counts FROM m JOIN cells USING (cell_id) GROUP BY 1", m=METRICS))
def _(v: Views):
    d = C.describe(metrics(v).join(v.cells(), "cell_id"), "roi")
    return d.withColumns({c: F.round(c, 6) for c in ("mean_counts", "mean_genes")})


@query("f7_sparsity", sql("counts genes cells", "SELECT nnz, n_cells, n_genes, round(1 - nnz / (n_cells * n_genes), 6) AS sparsity FROM (SELECT count(*) AS nnz FROM counts WHERE value <> 0), (SELECT count(DISTINCT cell_id) AS n_cells FROM cells), (SELECT count(DISTINCT gene_id) AS n_genes FROM genes)"))
def _(v: Views):
    return C.sparsity(v.counts(), v.cells(), v.genes()).select("nnz", "n_cells", "n_genes", r6("sparsity"))


@query("f8_histogram", "SELECT event_type, CAST(CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 60) + 1, 60) ELSE 1 END AS INTEGER) AS bin, count(*) AS n FROM events JOIN (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events WHERE value >= 0 GROUP BY 1) USING (event_type) WHERE value >= 0 GROUP BY 1, 2")
def _(v: Views):
    return C.histogram(v.table("events"), "value", 60, ["event_type"])


@query("f8b_percentiles", "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def _(v: Views):
    p = C.percentiles(v.table("events"), "value", ["event_type"])
    return p.select("event_type", r6("mean"), r6("p05"), r6("p50"), r6("p95"), r6("p99"))


@query("f9_mad_bounds", "SELECT event_type, round(greatest(exp(m - 3 * d) - 1, 0), 6) AS low, round(exp(m + 3 * d) - 1, 6) AS high FROM (SELECT event_type, any_value(m) AS m, median(abs(ln(1 + value) - m)) AS d FROM events JOIN (SELECT event_type, median(ln(1 + value)) AS m FROM events GROUP BY 1) USING (event_type) GROUP BY 1)")
def _(v: Views):
    return C.mad_bounds(v.table("events"), "value", ["event_type"]).select("event_type", r6("low"), r6("high"))


@query("d4_cell_filter", sql("counts genes", "SELECT cell_id, total, n_genes FROM m WHERE n_genes >= 20 AND n_genes <= 8000 AND total >= 5 AND pct_flagged <= 60", m=METRICS))
def _(v: Views):
    return metrics(v).where(C.qc_pass(20, 8000, 5, 60, 0)).select("cell_id", "total", "n_genes")


@query("d5_gene_filter", sql("counts", "SELECT gene_id, count(*) AS n_cells, sum(value) AS total FROM counts WHERE value > 0 GROUP BY 1 HAVING count(*) >= 12"))
def _(v: Views):
    kept = C.filter_genes(v.counts(), 12)
    return kept.where("value > 0").groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("value").alias("total"))


@query("d6_standalone_filter", sql("counts genes", "SELECT count(*) AS kept, count(*) >= 10 AS enough FROM m WHERE n_genes >= 150 AND pct_flagged <= 45 AND total >= 80", m=METRICS))
def _(v: Views):
    return metrics(v).where(C.qc_pass(min_genes=150, max_pct=45, min_counts=80)).agg(F.count(F.lit(1)).alias("kept"), (F.count(F.lit(1)) >= 10).alias("enough"))


@query("d7_qc_yield", sql("counts genes cells", "SELECT roi, count(*) FILTER (total >= 15000 AND n_genes >= 400 AND pct_flagged <= 42) AS n_pass, count(*) AS n, round(count(*) FILTER (total < 14000) / count(*), 6) AS debris FROM m JOIN cells USING (cell_id) GROUP BY 1", m=METRICS))
def _(v: Views):
    ok = C.qc_pass(min_genes=400, min_counts=15000, max_pct=42)
    return metrics(v).join(v.cells(), "cell_id").groupBy("roi").agg(F.count_if(ok).alias("n_pass"), F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("total") < 14000) / F.count(F.lit(1)), 6).alias("debris"))


@query("d9_prefix_flag", sql("genes", "SELECT gene_id, starts_with(lower(name), 'brand#3') AS hit FROM genes"))
def _(v: Views):
    return v.genes().select("gene_id", C.prefix_flag(F.col("name"), "BRAND#3").alias("hit"))


@query("d10_prefix_choice", sql("genes", "SELECT CASE WHEN bool_or(starts_with(name, 'MT-')) THEN 'MT-' ELSE 'mt-' END AS prefix FROM genes"))
def _(v: Views):
    return C.chosen_prefix(v.genes(), "MT-", "mt-")


@query("d11_missing_genes", sql("genes", "SELECT want FROM (SELECT 'Brand#13_' || n_nationkey * 7 AS want FROM nation) WHERE want NOT IN (SELECT name FROM genes)"))
def _(v: Views):
    want = v.table("nation").select(F.concat(F.lit("Brand#13_"), (F.col("n_nationkey") * 7).cast("string")).alias("want"))
    return want.join(v.genes(), F.col("want") == F.col("name"), "left_anti")


@query("d12_usable_panels", sql("genes", "SELECT panel, count(*) AS n FROM genes WHERE name LIKE '%1' GROUP BY 1 HAVING count(*) >= 2"))
def _(v: Views):
    return v.genes().where(F.col("name").endswith("1")).groupBy("panel").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("d13_marker_specificity", sql("counts genes", "SELECT cell_id FROM counts JOIN genes USING (gene_id) GROUP BY 1 HAVING sum(value) FILTER (brand = 'Brand#11') / sum(value) >= 0.04"))
def _(v: Views):
    m = v.counts().join(v.genes(), "gene_id").groupBy("cell_id").agg(F.sum(F.when(F.col("brand") == "Brand#11", F.col("value"))).alias("marker"), F.sum("value").alias("total"))
    return m.where(F.col("marker") / F.col("total") >= 0.04).select("cell_id")


@query("d16_finite_values", "SELECT event_type, count(*) AS n FROM events WHERE value IS NOT NULL AND value >= 0 GROUP BY 1 HAVING max(value) > 0")
def _(v: Views):
    x = F.col("value")
    return v.table("events").where(x.isNotNull() & ~F.isnan(x) & (x >= 0)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max(x).alias("top")).where("top > 0").select("event_type", "n")


@query("d17_scored_labels", "SELECT quality, count(*) AS n FROM labels WHERE quality IN (0, 1) AND toxic = 0 GROUP BY 1")
def _(v: Views):
    return v.table("labels").where(F.col("quality").isin(0, 1) & (F.col("toxic") == 0)).groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@query("d18_tile_owner", sql("points", "SELECT subtype, CAST(floor(x / 2500) AS BIGINT) AS tx, CAST(floor(y / 2500) AS BIGINT) AS ty, count(*) AS n FROM points GROUP BY 1, 2, 3"))
def _(v: Views):
    return v.points().groupBy("subtype", F.floor(F.col("x") / 2500).alias("tx"), F.floor(F.col("y") / 2500).alias("ty")).agg(F.count(F.lit(1)).alias("n"))


@query("d19_pass_rate_from_bins", "SELECT event_type, round(sum(CASE WHEN lo + (bin - 0.5) * (hi - lo) / 60 BETWEEN 20 AND 80 THEN n ELSE 0 END) / sum(n), 6) AS rate FROM (SELECT event_type, least(floor((value - lo) / (hi - lo) * 60) + 1, 60) AS bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n FROM events JOIN (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) USING (event_type) GROUP BY 1, 2) GROUP BY 1")
def _(v: Views):
    e = v.table("events")
    ends = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    h = C.histogram(e, "value", 60, ["event_type"]).join(ends, "event_type")
    center = F.col("lo") + (F.col("bin") - 0.5) * (F.col("hi") - F.col("lo")) / 60
    return h.groupBy("event_type").agg(F.round(F.sum(F.when(center.between(20, 80), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("rate"))


@query("f10_capture_rate", sql("pixels raster", "SELECT gene_id % 7 AS method, round(avg(CASE WHEN cell_id IS NULL THEN 0 ELSE 1 END), 6) AS capture FROM pixels LEFT JOIN raster USING (\"row\", col) GROUP BY 1"))
def _(v: Views):
    a = J.attribute(v.pixels(), v.raster())
    return a.groupBy((F.col("gene_id") % 7).alias("method")).agg(F.round(F.avg((F.col("cell_id") > 0).cast("int")), 6).alias("capture"))


@query("f11_count_density", sql("pixels raster", 'SELECT b, round(median(total / area), 6) AS density FROM (SELECT "row" // 10 AS b, "row", col, sum(value) AS total FROM pixels GROUP BY ALL) JOIN (SELECT "row", count(*) AS area FROM raster GROUP BY 1) USING ("row") WHERE total > 0 GROUP BY 1'))
def _(v: Views):
    t = v.pixels().groupBy("row", "col").agg(F.sum("value").alias("total"))
    area = v.raster().groupBy("row").agg(F.count(F.lit(1)).alias("area"))
    return t.join(area, "row").where("total > 0").groupBy(F.floor(F.col("row") / 10).cast("int").alias("b")).agg(F.round(F.median(F.col("total") / F.col("area")), 6).alias("density"))


@query("f12_medians_yield", sql("counts genes cells", "SELECT site, quantile_cont(total, 0.5) AS a2_median_umi, quantile_cont(CAST(n_genes AS DOUBLE), 0.5) AS a3_median_genes, round(avg(CASE WHEN total < 15000 THEN 1 ELSE 0 END), 6) AS b1_debris_rate, count(*) FILTER (n_genes >= 500) AS b2_qc_yield FROM m JOIN cells USING (cell_id) GROUP BY 1", m=METRICS))
def _(v: Views):
    m = metrics(v).join(v.cells(), "cell_id")
    return m.groupBy("site").agg(F.percentile("total", 0.5).alias("a2_median_umi"), F.percentile("n_genes", 0.5).alias("a3_median_genes"), F.round(F.avg((F.col("total") < 15000).cast("int")), 6).alias("b1_debris_rate"), F.count_if(F.col("n_genes") >= 500).alias("b2_qc_yield"))


@query("f31_method_means", sql("bins cells", "SELECT method, round(avg(total), 6) AS mean_total, round(avg(n), 6) AS mean_n FROM (SELECT method, site, sum(value) AS total, count(*) AS n FROM bins JOIN cells USING (cell_id) GROUP BY 1, 2) GROUP BY 1"))
def _(v: Views):
    per = v.bins().join(v.cells(), "cell_id").groupBy("method", "site").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("method").agg(F.round(F.avg("total"), 6).alias("mean_total"), F.round(F.avg("n"), 6).alias("mean_n"))


@query("f32_composition", sql("points", "SELECT zone, subtype, n, round(n / sum(n) OVER (PARTITION BY zone), 6) AS share FROM (SELECT CAST(floor(y / 2000) AS BIGINT) AS zone, subtype, count(*) AS n FROM points GROUP BY 1, 2)"))
def _(v: Views):
    p = v.points().withColumn("zone", F.floor(F.col("y") / 2000))
    return C.value_counts(p, ["zone"], "subtype").select("zone", "subtype", "n", r6("share"))


@query("f33_detection_rate", sql("counts cells", "SELECT roi, round(count(DISTINCT cell_id) FILTER (gene_id % 50 = 0) / any_value(n), 6) AS rate, round(coalesce(sum(value) FILTER (gene_id % 50 = 0), 0) / any_value(n), 6) AS mean_count FROM counts JOIN cells USING (cell_id) JOIN (SELECT roi, count(*) AS n FROM cells GROUP BY 1) USING (roi) GROUP BY 1"))
def _(v: Views):
    n = v.cells().groupBy("roi").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("gene_id") % 50 == 0
    t = v.counts().join(v.cells(), "cell_id").groupBy("roi", "cell_id").agg(F.max(hit).alias("any"), F.sum(F.when(hit, F.col("value"))).alias("value")).groupBy("roi").agg(F.count_if("any").alias("hits"), F.sum("value").alias("value"))
    return n.join(t, "roi").select("roi", F.round(F.col("hits") / F.col("n"), 6).alias("rate"), F.round(F.coalesce("value", S.num(0)) / F.col("n"), 6).alias("mean_count"))


@query("f34_quality_verdict", sql("bins", "SELECT cell_id, CASE WHEN d >= 0.03 THEN 'good' WHEN d >= 0.01 THEN 'marginal' ELSE 'poor' END AS verdict FROM (SELECT cell_id, avg(CASE WHEN in_tissue THEN 1.0 ELSE 0.0 END) - 0.49 AS d FROM bins GROUP BY 1)"))
def _(v: Views):
    d = v.bins().groupBy("cell_id").agg((F.avg(F.col("in_tissue").cast("double")) - 0.49).alias("d"))
    return d.select("cell_id", S.quality_label(F.col("d")).alias("verdict"))


@query("h1_top_genes_in_order", sql("counts", "SELECT gene_id, total FROM (SELECT gene_id, sum(value) AS total FROM counts GROUP BY 1 ORDER BY total DESC, gene_id LIMIT 50)"))
def _(v: Views):
    t = v.counts().groupBy("gene_id").agg(F.sum("value").alias("total"))
    return t.orderBy(F.desc("total"), "gene_id").limit(50).orderBy("gene_id")


@query("h3_largest_differences", sql("bins", "SELECT cell_id, diff FROM (SELECT cell_id, coalesce(sum(value) FILTER (method = 'A'), 0) - coalesce(sum(value) FILTER (method = 'R'), 0) AS diff FROM bins GROUP BY 1) ORDER BY abs(diff) DESC, cell_id LIMIT 4"))
def _(v: Views):
    part = lambda m: F.sum(F.when(F.col("method") == m, F.col("value")).otherwise(0.0))
    d = v.bins().groupBy("cell_id").agg((part("A") - part("R")).alias("diff"))
    return d.orderBy(F.desc(F.abs("diff")), "cell_id").limit(4)


@query("h4_numeric_order", "SELECT s, row_number() OVER (ORDER BY try_cast(s AS INTEGER), s) AS place FROM (SELECT DISTINCT CAST(p_size AS VARCHAR) AS s FROM part)")
def _(v: Views):
    from pyspark.sql.window import Window

    s = v.table("part").select(F.col("p_size").cast("string").alias("s")).distinct()
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.expr("try_cast(s AS int)"), "s")).cast("long"))  # the distinct ids only


@query("h5_best_and_failed", "SELECT event_id, value, kind FROM (SELECT event_id, value, 'best' AS kind FROM events ORDER BY value DESC, event_id LIMIT 8) UNION ALL (SELECT event_id, value, 'failed' FROM events WHERE value < 35 ORDER BY value DESC, event_id LIMIT 5)")
def _(v: Views):
    e = v.table("events").select("event_id", "value")
    best = e.orderBy(F.desc("value"), "event_id").limit(8).withColumn("kind", F.lit("best"))
    return best.union(e.where("value < 35").orderBy(F.desc("value"), "event_id").limit(5).withColumn("kind", F.lit("failed")))


@query("h6_best_trial", "SELECT event_type, arg_max(event_id, {'v': value, 'i': -event_id}) AS trial, max(value) AS value FROM events GROUP BY 1")
def _(v: Views):
    return v.table("events").groupBy("event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("trial"), F.max("value").alias("value"))


@query("h7_seeded_sample")
def _(v: Views):
    return C.sampled(v.table("events").select("event_id", "value"), ["event_id"], 200)


@query("b13_handoff_report", sql("counts", "SELECT '{\"cells\":' || count(DISTINCT cell_id) || ',\"genes\":' || count(DISTINCT gene_id) || '}' AS report FROM counts"))
def _(v: Views):
    return E.handoff(v.counts().agg(F.countDistinct("cell_id").alias("cells"), F.countDistinct("gene_id").alias("genes")))


@query("b14_two_section_report", sql("points", "SELECT 'composition' AS section, subtype AS name, round(100.0 * count(*) / (SELECT count(*) FROM points), 6) AS value FROM points GROUP BY 2 UNION ALL SELECT 'overlap', 'positive', round(avg(CASE WHEN x > 0 THEN 1 ELSE 0 END), 6) FROM points"))
def _(v: Views):
    p = v.points()
    share = C.value_counts(p.withColumn("g", F.lit(1)), ["g"], "subtype").select(F.lit("composition").alias("section"), F.col("subtype").alias("name"), F.round(100 * F.col("share"), 6).alias("value"))
    return share.union(p.agg(F.round(F.avg((F.col("x") > 0).cast("int")), 6)).select(F.lit("overlap"), F.lit("positive"), "*"))


@query("b5_polygon_features")
def _(v: Views):
    p = v.points()
    v4 = p.select(F.col("id").alias("cell_id"), "x", "y", F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(float(dx)).alias("dx"), F.lit(float(dy)).alias("dy")) for i, (dx, dy) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4)])])).alias("s"))
    return E.polygon_features(v4.select("cell_id", F.col("s.ord").alias("ord"), (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y")), 0.2737)
