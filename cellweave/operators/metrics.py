"""Segmentation and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import num, ratio
from .joins import overlaps


def survival(cells: DataFrame, by: str, passes: Column, specific: float) -> DataFrame:
    """Share of specific-marker cells that pass, null without any; and the number with any marker."""
    hit = F.col("marker") / F.col("total") >= specific
    return cells.groupBy(by).agg(F.try_divide(F.count_if(passes & hit).cast("double"), F.count_if(hit).cast("double")).alias("survival"), F.count_if(F.col("marker") > 0).alias("any_marker"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts and row shares of (truth, predicted)."""
    n = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def class_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``label, support, tp, precision, recall, f1`` of each class; 0 on zero division."""
    n = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    true = n.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    pred = n.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    j = true.join(pred, "label", "full").na.fill(0)
    pr, rc = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return j.select("label", "support", "predicted", "tp", pr.alias("precision"), rc.alias("recall"), ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"))


def f1_summary(scores: DataFrame) -> DataFrame:
    """Micro, macro and weighted F1 of class scores."""
    return scores.agg(ratio(2 * F.sum("tp"), F.sum("predicted") + F.sum("support")).alias("micro"), F.avg("f1").alias("macro"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted"))


def panoptic(predicted: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``matched, n_pred, n_true, sq, rq, pq, precision, recall, ap``: pairs with IoU above one half are unique matches."""
    m = overlaps(predicted, truth).where(F.col("iou") > threshold).agg(F.count(F.lit(1)).alias("matched"), F.avg("iou").alias("_iou"))
    n = lambda df, name: df.agg(F.countDistinct("cell_id").alias(name))
    g = m.crossJoin(n(predicted, "n_pred")).crossJoin(n(truth, "n_true"))  # one row each
    sq, rq = F.coalesce("_iou", num(0)), ratio(2 * F.col("matched"), F.col("n_pred") + F.col("n_true"))
    return g.select("matched", "n_pred", "n_true", sq.alias("sq"), rq.alias("rq"), (sq * rq).alias("pq"), ratio(F.col("matched"), F.col("n_pred")).alias("precision"), ratio(F.col("matched"), F.col("n_true")).alias("recall"), ratio(F.col("matched"), F.col("n_pred") + F.col("n_true") - F.col("matched")).alias("ap"))


def pixel_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """``both, only_a, only_b, iou, cover_a, cover_b`` of the foregrounds of two rasters."""
    x, y = a.select("row", "col", F.lit(1).alias("_a")).distinct(), b.select("row", "col", F.lit(1).alias("_b")).distinct()
    j = x.join(y, ["row", "col"], "full").agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))
    s = lambda *c: sum((F.col(x) for x in c[1:]), F.col(c[0]))
    return j.select("*", ratio(F.col("both"), s("both", "only_a", "only_b")).alias("iou"), ratio(F.col("both"), s("both", "only_a")).alias("cover_a"), ratio(F.col("both"), s("both", "only_b")).alias("cover_b"))


def mostly_inside(cells: DataFrame, region: DataFrame, share: float = 0.5) -> DataFrame:
    """``cell_id, inside`` of cells with at least ``share`` of their pixels in the region."""
    hits = cells.join(region.select("row", "col").distinct().withColumn("_h", F.lit(1)), ["row", "col"], "left")
    g = hits.groupBy("cell_id").agg((F.count("_h") / F.count(F.lit(1))).alias("inside"))
    return g.where(F.col("inside") >= share)


def circularity(df: DataFrame, area: str, perimeter: str) -> Column:
    """min(4 pi A / P^2, 1)."""
    p = F.col(perimeter)
    return F.when(p > 0, F.least(4 * F.pi() * F.col(area) / (p * p), num(1)))
