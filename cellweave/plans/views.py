"""Domain views over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    """``counts`` (cell, gene, value), ``genes``, ``cells``, ``bins``, ``points``, ``raster`` and the plain tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def counts(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))

    def genes(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("gene_id"), F.concat_ws("_", "p_brand", F.col("p_partkey").cast("string")).alias("name"),
            F.lower("p_brand").startswith("brand#1").alias("mito"), F.col("p_type").alias("panel"), F.col("p_brand").alias("brand"),
        )

    def cells(self) -> DataFrame:
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("cell_id"), F.col("r_name").alias("roi"), F.col("n_name").alias("site"))

    def bins(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_partkey").alias("gene_id"), F.col("l_suppkey").alias("cell_id"), F.col("l_extendedprice").alias("x"),
            F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).alias("y"), (F.col("l_linestatus") == "O").alias("in_tissue"),
            F.col("l_quantity").alias("value"), F.col("l_returnflag").alias("method"),
        )

    def points(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), ((F.col("c_custkey") * 7919) % 10000).cast("double").alias("y"), F.col("c_mktsegment").alias("subtype"))

    def raster(self) -> DataFrame:
        return self.table("part").groupBy(F.col("p_size").alias("row"), (F.col("p_partkey") % 40).cast("int").alias("col")).agg((F.min("p_partkey") + 1).alias("cell_id"))

    def pixels(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_quantity").cast("int").alias("row"), (F.col("l_partkey") % 40).cast("int").alias("col"), F.col("l_suppkey").alias("gene_id"), F.col("l_quantity").alias("value"))

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


SQL = {
    "counts": "SELECT l_suppkey AS cell_id, l_partkey AS gene_id, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2",
    "genes": "SELECT p_partkey AS gene_id, p_brand || '_' || p_partkey AS name, starts_with(lower(p_brand), 'brand#1') AS mito, p_type AS panel, p_brand AS brand FROM part",
    "cells": "SELECT s_suppkey AS cell_id, r_name AS roi, n_name AS site FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "bins": "SELECT l_partkey AS gene_id, l_suppkey AS cell_id, l_extendedprice AS x, datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS y, l_linestatus = 'O' AS in_tissue, l_quantity AS value, l_returnflag AS method FROM lineitem",
    "points": "SELECT c_custkey AS id, c_acctbal AS x, CAST((c_custkey * 7919) % 10000 AS DOUBLE) AS y, c_mktsegment AS subtype FROM customer",
    "raster": "SELECT p_size AS \"row\", CAST(p_partkey % 40 AS INTEGER) AS col, min(p_partkey) + 1 AS cell_id FROM part GROUP BY 1, 2",
    "pixels": "SELECT CAST(l_quantity AS INTEGER) AS \"row\", CAST(l_partkey % 40 AS INTEGER) AS col, l_suppkey AS gene_id, l_quantity AS value FROM lineitem",
    "vectors": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings",
}


def sql(views: str, body: str, **more: str) -> str:
    """``body`` with the named views, and further ones, in front."""
    parts = [f"{v} AS ({SQL[v]})" for v in views.split()] + [f"{k} AS ({v})" for k, v in more.items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
