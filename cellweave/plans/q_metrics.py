"""Segmentation and classification metrics (survey sections F24-F30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as Q
from .registry import query
from .views import Views, sql

r6 = lambda c: F.round(c, 6).alias(c)
_TRUTH = "SELECT quality AS t, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)"


def truth(v: Views):
    d = v.table("documents").select("doc_id", "n_chars")
    return v.table("labels").join(d, "doc_id").select(F.col("quality").alias("t"), (F.col("n_chars") > 1500).cast("int").alias("p"))


@query("f24_confusion", sql("", "SELECT t, p, n, round(n / sum(n) OVER (PARTITION BY t), 6) AS share FROM (SELECT t, p, count(*) AS n FROM s GROUP BY 1, 2)", s=_TRUTH))
def _(v: Views):
    return Q.confusion(truth(v), "t", "p").withColumn("share", F.round("share", 6))


_CLASS = "SELECT label, support, predicted, tp, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1 FROM (SELECT l.label, count(*) FILTER (t = l.label) AS support, count(*) FILTER (p = l.label) AS predicted, count(*) FILTER (t = l.label AND p = l.label) AS tp FROM s, (VALUES (0), (1)) l(label) GROUP BY 1)"


@query("f25_class_scores", sql("", "SELECT label, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM c", s=_TRUTH, c=_CLASS))
def _(v: Views):
    return Q.class_scores(truth(v), "t", "p").select("label", "support", "predicted", "tp", r6("precision"), r6("recall"), r6("f1"))


@query("f25b_f1_summary", sql("", "SELECT round(2 * sum(tp) / (sum(predicted) + sum(support)), 6) AS micro, round(avg(f1), 6) AS macro, round(sum(f1 * support) / sum(support), 6) AS weighted FROM c", s=_TRUTH, c=_CLASS))
def _(v: Views):
    return Q.f1_summary(Q.class_scores(truth(v), "t", "p")).select(r6("micro"), r6("macro"), r6("weighted"))


def block(v: Views, a: int, b: int, keep=None):
    r = v.raster()
    r = r.where(keep) if keep is not None else r
    return r.select("row", "col", (F.floor((F.col("row") + a) / 5) * 100 + F.floor((F.col("col") + b) / 5)).alias("cell_id"))


_X = 'SELECT "row", col, CAST(("row" // 5) * 100 + col // 5 AS BIGINT) AS id FROM raster'
_Y = 'SELECT "row", col, CAST((("row" + 1) // 5) * 100 + col // 5 AS BIGINT) AS id FROM raster WHERE ("row" * 7 + col) % 11 <> 0'
_IOU = 'SELECT x.id AS a, y.id AS b, count(*) AS shared FROM x JOIN y USING ("row", col) GROUP BY 1, 2'
_MATCH = "SELECT a, b, shared / (xa.n + yb.n - shared) AS iou FROM i JOIN (SELECT id, count(*) AS n FROM x GROUP BY 1) xa ON xa.id = a JOIN (SELECT id, count(*) AS n FROM y GROUP BY 1) yb ON yb.id = b WHERE shared / (xa.n + yb.n - shared) > 0.5"


@query("f26_panoptic_quality", sql("raster", "SELECT matched, n_pred, n_true, round(sq, 6) AS sq, round(2 * matched / (n_pred + n_true), 6) AS rq, round(sq * 2 * matched / (n_pred + n_true), 6) AS pq FROM (SELECT count(*) AS matched, coalesce(avg(iou), 0) AS sq FROM m), (SELECT count(DISTINCT id) AS n_pred FROM x), (SELECT count(DISTINCT id) AS n_true FROM y)", x=_X, y=_Y, i=_IOU, m=_MATCH))
def _(v: Views):
    q = Q.panoptic(block(v, 0, 0), block(v, 1, 0, (F.col("row") * 7 + F.col("col")) % 11 != 0))
    return q.select("matched", "n_pred", "n_true", r6("sq"), r6("rq"), r6("pq"))


@query("f27_average_precision", sql("raster", "SELECT round(matched / n_pred, 6) AS precision, round(matched / n_true, 6) AS recall, round(matched / (n_pred + n_true - matched), 6) AS ap FROM (SELECT count(*) AS matched FROM m), (SELECT count(DISTINCT id) AS n_pred FROM x), (SELECT count(DISTINCT id) AS n_true FROM y)", x=_X, y=_Y, i=_IOU, m=_MATCH))
def _(v: Views):
    q = Q.panoptic(block(v, 0, 0), block(v, 1, 0, (F.col("row") * 7 + F.col("col")) % 11 != 0))
    return q.select(r6("precision"), r6("recall"), r6("ap"))


@query("f28_pixel_overlap", sql("raster", 'SELECT both_n, only_a, only_b, round(both_n / (both_n + only_a + only_b), 6) AS iou, round(both_n / (both_n + only_a), 6) AS cover_a, round(both_n / (both_n + only_b), 6) AS cover_b FROM (SELECT count(*) FILTER (a AND b) AS both_n, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM (SELECT "row" % 3 <> 0 AS a, col % 4 <> 0 AS b FROM raster))'))
def _(v: Views):
    r = v.raster()
    q = Q.pixel_overlap(r.where("row % 3 <> 0"), r.where("col % 4 <> 0"))
    return q.select(F.col("both").alias("both_n"), "only_a", "only_b", r6("iou"), r6("cover_a"), r6("cover_b"))


@query("f29_mostly_inside", sql("raster", 'SELECT id AS cell_id, round(avg(CASE WHEN "row" < 22 AND col < 17 THEN 1 ELSE 0 END), 6) AS inside FROM x GROUP BY 1 HAVING avg(CASE WHEN "row" < 22 AND col < 17 THEN 1 ELSE 0 END) >= 0.5', x=_X))
def _(v: Views):
    return Q.mostly_inside(block(v, 0, 0), v.raster().where("row < 22 and col < 17")).select("cell_id", r6("inside"))


@query("f30_circularity", sql("genes", "SELECT panel, round(median(least(4 * pi() * p_size / ((p_size % 9 + 12.0) ** 2), 1)), 6) AS circularity FROM genes JOIN part ON p_partkey = gene_id GROUP BY 1"))
def _(v: Views):
    p = v.table("part").select(F.col("p_type").alias("panel"), F.col("p_size").alias("area"), (F.col("p_size") % 9 + 12.0).alias("perimeter"))
    return p.groupBy("panel").agg(F.round(F.median(Q.circularity(p, "area", "perimeter")), 6).alias("circularity"))
