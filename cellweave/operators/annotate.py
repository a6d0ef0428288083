"""Labels of cells and clusters."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import num


class Predictor(Protocol):
    """A model that labels cells; pretrained ones plug in here."""

    def predict(self, counts: DataFrame) -> DataFrame:
        """``cell_id, label, confidence``."""


def majority(labels: DataFrame) -> DataFrame:
    """``cluster, label, share, confidence`` of ``labels(cluster, label, confidence)``: the most frequent label, ties by name."""
    n = labels.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    total = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("_t"), F.avg("confidence").alias("confidence"))
    best = n.groupBy("cluster").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"), F.max("n").alias("n"))
    return best.join(total, "cluster").select("cluster", "label", (F.col("n") / F.col("_t")).alias("share"), "confidence")


def best_panel(scores: DataFrame, threshold: float) -> DataFrame:
    """``grp, panel, score``: the panel of the largest mean score above the threshold, the first in panel order among equals."""
    key = F.struct(-F.col("score"), F.col("ord"))
    best = scores.groupBy("grp").agg(F.min_by("panel", key).alias("panel"), F.max("score").alias("score"))
    return best.withColumn("panel", F.when(F.col("score") > threshold, F.col("panel")))


def dual_rule(tissue: DataFrame, immune: DataFrame, least: float = 0.5, none: str = "Non-immune") -> DataFrame:
    """``cluster, label, confidence``: the immune model's label if it names an immune type with confidence, else the tissue model's."""
    i = immune.select("cluster", F.col("label").alias("_il"), F.col("confidence").alias("_ic"))
    takes = (F.col("_il") != none) & (F.col("_ic") >= least)
    j = tissue.join(i, "cluster", "left")
    return j.select("cluster", F.when(takes, F.col("_il")).otherwise(F.col("label")).alias("label"), F.when(takes, F.col("_ic")).otherwise(F.col("confidence")).alias("confidence"))


def refine(labels: DataFrame, panels: DataFrame, keywords: DataFrame, threshold: float = 0.0, sure: float = 0.7) -> DataFrame:
    """``cluster, label, refined, uncertain``: the best panel of ``panels(grp, panel, score, ord)`` among those whose keyword the label contains.

    ``keywords(keyword, panel)``: a panel is relevant to labels that contain the keyword, case ignored.
    """
    relevant = labels.join(F.broadcast(keywords), F.lower("label").contains(F.lower("keyword"))).select("cluster", "panel").distinct()
    scored = relevant.join(panels.withColumnRenamed("grp", "cluster"), ["cluster", "panel"]).withColumnRenamed("cluster", "grp")
    best = best_panel(scored, threshold).select(F.col("grp").alias("cluster"), F.col("panel").alias("_p"))
    return labels.join(best, "cluster", "left").select("cluster", "label", F.coalesce("_p", "label").alias("refined"), (F.col("confidence") < sure).alias("uncertain"))


def relabel(labels: DataFrame, finer: DataFrame, threshold: float) -> DataFrame:
    """Labels replaced by a finer model's above a confidence, a state suffix after ``|`` kept."""
    f = finer.select("cluster", F.col("label").alias("_f"), F.col("confidence").alias("_c"))
    state = F.regexp_extract("label", r"(\|.*)$", 1)
    return labels.join(f, "cluster", "left").withColumn("label", F.when(F.col("_c") >= threshold, F.concat("_f", state)).otherwise(F.col("label"))).drop("_f", "_c")


def priority_type(values: dict[str, Column], first: str, margin: float = 0.0, none: str = "other") -> Column:
    """The type of the largest value; ``first`` wins if positive and within ``margin`` of it; ``none`` if all are 0; ties go to the first named."""
    top = F.greatest(*values.values()) if len(values) > 1 else next(iter(values.values()))
    out = F.when(top <= 0, F.lit(none)).when((values[first] > 0) & (values[first] + margin >= top), F.lit(first))
    for name, v in values.items():
        out = out.when(v == top, F.lit(name))
    return out


def marker_types(counts: DataFrame, groups: DataFrame, panels: DataFrame, n_cells: int) -> DataFrame:
    """``grp, panel, score``: mean over the group's cells of the largest value / gene mean among the panel's genes."""
    mean = counts.groupBy("gene_id").agg((F.sum("value") / n_cells).alias("_mu"))
    c = counts.join(panels.select("panel", "gene_id"), "gene_id").join(mean, "gene_id")
    best = c.groupBy("cell_id", "panel").agg(F.max(F.col("value") / F.col("_mu")).alias("_x"))
    n = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    s = best.join(groups, "cell_id").groupBy("grp", "panel").agg(F.sum("_x").alias("_s"))
    return s.join(n, "grp").select("grp", "panel", (F.col("_s") / F.col("_n")).alias("score"))


def highest_group(means: DataFrame) -> DataFrame:
    """``grp, top``: the group with the largest of its genes' means, the first among equals."""
    m = means.groupBy("grp").agg(F.max("mean").alias("top"))
    return m.agg(F.min_by("grp", F.struct(-F.col("top"), F.col("grp"))).alias("grp"), F.max("top").alias("top"))


def apply_labels(cells: DataFrame, labels: DataFrame, missing: str = "Unknown") -> DataFrame:
    return cells.join(labels.select("cluster", F.col("label").alias("cell_type")), "cluster", "left").withColumn("cell_type", F.coalesce("cell_type", F.lit(missing)))


def split_first(column: str, sep: str = "|") -> Column:
    return F.get(F.split(column, f"[{sep}]"), F.lit(0))


def relevant_order(df: DataFrame, key: str, ordered: str) -> DataFrame:
    """First occurrence of each value per key, in order."""
    w = Window.partitionBy(key, ordered).orderBy("ord")
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == num(1).cast("int")).drop("_k")
