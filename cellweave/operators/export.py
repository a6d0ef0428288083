"""Sinks and the tables that they write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def indptr(counts: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """Row pointers of the compressed sparse rows in the order of cell_id.

    Running sums are taken within ranges of cell ids; one row per range goes through the global window.
    """
    nnz = counts.groupBy("cell_id").agg(F.count(F.lit(1)).alias("nnz")).withColumn("_part", F.floor(F.col("cell_id") / chunk))
    sizes = nnz.groupBy("_part").agg(F.sum("nnz").alias("_n"))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead(Window.orderBy("_part"))), F.lit(0)).alias("_start"))
    own = F.coalesce(F.sum("nnz").over(ahead(Window.partitionBy("_part").orderBy("cell_id"))), F.lit(0))
    return nnz.join(starts, "_part").select("cell_id", "nnz", (own + F.col("_start")).alias("indptr"))


def pseudo_transcripts(bins: DataFrame, most: int | None = None, seed: int = 0) -> DataFrame:
    """One row per pixel and gene with counts; beyond ``most`` rows a seeded sample."""
    rows = bins.where("value > 0").groupBy("row", "col", "gene_id").agg(F.sum("value").alias("value"))
    if most is None:
        return rows
    return rows.orderBy(F.xxhash64("row", "col", "gene_id", F.lit(seed)), "row", "col", "gene_id").limit(most)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, if_exists: str = "error") -> DataFrame:
    """Parquet sink, partitioned on request; ``if_exists="reuse"`` reads a table that is there, whose key should hold all parameters."""
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if not (if_exists == "reuse" and fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))):
        w = df.write.mode("overwrite" if if_exists in ("overwrite", "reuse") else "error")
        (w.partitionBy(*by) if by else w).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def polygon_features(vertices: DataFrame, scale: float = 1.0) -> DataFrame:
    """GeoJSON features of ``vertices(cell_id, ord, x, y)``: one closed ring per cell."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))), lambda p: F.array(p["x"] * scale, p["y"] * scale))
    cells = vertices.groupBy("cell_id").agg(ring.alias("_r"))
    closed = F.when(F.get("_r", F.lit(0)) == F.element_at("_r", -1), F.col("_r")).otherwise(F.concat("_r", F.array(F.get("_r", F.lit(0)))))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    return cells.select("cell_id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("cell_id").alias("properties"))).alias("feature"))


def write_geojson_lines(features: DataFrame, path: str) -> None:
    """A feature per line, in as many files as the table has partitions."""
    features.select("feature").write.mode("overwrite").text(path)


def handoff(summary: DataFrame) -> DataFrame:
    """A one-row JSON report of a summary row."""
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("report"))
