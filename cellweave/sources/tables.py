"""Scans: explicit schemas, pruned columns, pushed ranges."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import canonical_id
from ..operators.region import require_columns

POSITIONS = T.StructType([T.StructField("barcode", T.StringType()), T.StructField("in_tissue", T.IntegerType()), T.StructField("pxl_row_in_fullres", T.DoubleType()), T.StructField("pxl_col_in_fullres", T.DoubleType())])
TRANSCRIPTS = T.StructType([T.StructField(n, t) for n, t in (("feature_name", T.StringType()), ("x_location", T.DoubleType()), ("y_location", T.DoubleType()), ("z_location", T.DoubleType()), ("qv", T.DoubleType()))])
BOUNDARIES = T.StructType([T.StructField("cell_id", T.StringType()), T.StructField("vertex_x", T.DoubleType()), T.StructField("vertex_y", T.DoubleType())])
EXPERIMENTS = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("approach", T.StringType()), T.StructField("rationale", T.StringType())])
FEATURES = "type string, features array<struct<type: string, id: string, geometry: struct<type: string, coordinates: array<array<array<double>>>>, properties: map<string, string>>>"


def positions(spark: SparkSession, path: str, in_tissue: bool = True) -> DataFrame:
    """Bin positions; the tissue filter and the column list reach the scan."""
    return positions_of(spark.read.parquet(path), in_tissue)


def positions_of(df: DataFrame, in_tissue: bool = True) -> DataFrame:
    df = require_columns(df, ["barcode", "in_tissue", "pxl_row_in_fullres", "pxl_col_in_fullres"])
    df = df.select("barcode", "in_tissue", "pxl_row_in_fullres", "pxl_col_in_fullres")
    return df.where("in_tissue = 1") if in_tissue else df


def with_positions(counts: DataFrame, positions_: DataFrame) -> DataFrame:
    """Counts of the barcodes that have a position, with x and y."""
    p = positions_.select("barcode", F.col("pxl_col_in_fullres").alias("x"), F.col("pxl_row_in_fullres").alias("y"))
    return counts.join(p, "barcode")


def platform_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cell table with string ids; optional columns are kept if there."""
    return cells_of(spark.read.parquet(path))


def cells_of(df: DataFrame) -> DataFrame:
    df = require_columns(df, ["cell_id", "x_centroid", "y_centroid"])
    more = [c for c in ("nucleus_area", "cell_area") if c in df.columns]
    return df.select(F.col("cell_id").cast("string").alias("cell_id"), "x_centroid", "y_centroid", *more)


def transcripts_in(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Transcripts of a half-open box; range and columns reach the scan."""
    return in_box(spark.read.parquet(path), box)


def in_box(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    x, y = F.col("x_location"), F.col("y_location")
    cols = [c for c in TRANSCRIPTS.names if c in df.columns]
    return df.where((x >= box[0]) & (x < box[2]) & (y >= box[1]) & (y < box[3])).select(*cols)


def boundaries_in(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """All vertices of the cells that have a vertex in the box."""
    return with_vertex_in(spark.read.schema(BOUNDARIES).parquet(path), box)


def with_vertex_in(v: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    hit = v.where(F.col("vertex_x").between(box[0], box[2]) & F.col("vertex_y").between(box[1], box[3])).select("cell_id").distinct()
    return v.join(hit, "cell_id", "left_semi")


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """``row, col, value`` (1-based) of a coordinate file in text, comments and size line skipped; split by line."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%"))
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.select(F.get(p, F.lit(0)).cast("long").alias("row"), F.get(p, F.lit(1)).cast("long").alias("col"), F.get(p, F.lit(2)).cast("double").alias("value"), F.monotonically_increasing_id().alias("_n"))
    first = rows.agg(F.min("_n")).first()[0]
    return rows.where(F.col("_n") != F.lit(first)).drop("_n")


def h5_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``barcode, gene, value`` of a compressed sparse matrix file; needs h5py where the driver runs."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs h5py; convert to Parquet (barcode, gene, value) instead") from e
    with h5py.File(path) as f:
        m = f["matrix"]
        indptr, indices, data = m["indptr"][:], m["indices"][:], m["data"][:]
        barcodes, genes = m["barcodes"][:].astype(str), m["features"]["name"][:].astype(str)
    cells = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    return spark.createDataFrame(pd.DataFrame({"barcode": barcodes[cells], "gene": genes[indices], "value": data.astype(float)}))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """``cell_id, ring`` of the features of collections, plain or gzip."""
    df = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    name = F.coalesce(F.col("f.properties")["cell_id"], F.col("f.id"))
    return df.select(canonical_id(name).alias("cell_id"), F.get("f.geometry.coordinates", F.lit(0)).alias("ring"))


def points_csv(spark: SparkSession, path: str, schema: str, id_column: str, dense: DataFrame) -> DataFrame:
    """Point CSV with ids replaced by the dense ids of ``dense(cell_id, dense)``, missing ones -1."""
    df = spark.read.csv(path, header=True, schema=schema).withColumn("_k", canonical_id(F.col(id_column)))
    return df.join(dense.select(F.col("cell_id").alias("_k"), "dense"), "_k", "left").withColumn(id_column, F.coalesce("dense", F.lit(-1))).drop("_k", "dense")


def npy_raster(spark: SparkSession, path: str) -> DataFrame:
    """``path, row, col, cell_id`` of the labelled pixels of npy rasters, one task per file."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                r, c = np.nonzero(a)
                yield pd.DataFrame({"path": name, "row": r.astype("int32"), "col": c.astype("int32"), "cell_id": a[r, c].astype("int64")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, row int, col int, cell_id long")


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of an experiment log; malformed lines are skipped."""
    return spark.read.schema(EXPERIMENTS).option("mode", "DROPMALFORMED").json(path)


def parsed_lines(df: DataFrame, text: str, schema: str) -> DataFrame:
    """JSON lines in column ``text`` as column ``row`` by ``schema``; rows with a malformed line are skipped."""
    j = F.from_json(F.col(text), schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return df.withColumn("row", j).where("row._bad is null").drop(text)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """``kind, path, size``: the best image and matrix under a folder: tiled images first, then the largest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    low = F.lower("path")
    kind = F.when(low.rlike(r"\.(btf|tif|tiff)$"), "image").when(low.rlike(r"\.(h5|h5ad|mtx|mtx\.gz)$"), "matrix").when(low.endswith(".parquet"), "table")
    best = F.struct(low.endswith(".btf").cast("int"), F.col("size"), F.col("path"))
    return files.withColumn("kind", kind).where("kind is not null").groupBy("kind").agg(F.max_by("path", best).alias("path"), F.max_by("size", best).alias("size"))


#: Files that tell that a stage is done: a pattern of the path below the output folder.
STAGE_FILES = {
    "roi": r"/roi/[^/.][^/]*/he_crop\.tif$", "segmentation": r"/roi/[^/.][^/]*/segmentation_masks\.npy$", "count": r"/roi/[^/.][^/]*/cellpose_cells\.h5ad$",
    "proseg_rna": r"/roi/[^/.][^/]*/proseg_cells\.h5ad$", "analysis": r"/(umap_computed|qc_preprocessed|roi/[^/.][^/]*/clustering)\.h5ad$",
}


def stage_report(spark: SparkSession, root: str, stages: dict[str, str] = STAGE_FILES) -> DataFrame:
    """``stage, done, regions``: whether a file of each stage lies under ``root``, and the regions that have one, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    rows = spark.createDataFrame(list(stages.items()), "stage string, pattern string")  # a row per stage
    hits = files.join(F.broadcast(rows), F.expr("path rlike pattern")).select("stage", F.regexp_extract("path", r"/roi/([^/]+)/[^/]+$", 1).alias("roi"))
    found = hits.groupBy("stage").agg(F.array_sort(F.collect_set(F.when(F.col("roi") != "", F.col("roi")))).alias("regions"))
    return rows.select("stage").join(found, "stage", "left").select("stage", F.col("regions").isNotNull().alias("done"), F.coalesce("regions", F.array().cast("array<string>")).alias("regions"))


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path of a fallback chain that exists, on any file system."""
    jvm = spark._jvm
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hp):
            return p
    raise FileNotFoundError(paths)


def merge_deep(base: dict, over: dict) -> dict:
    """``over`` laid over ``base``, nested dicts merged, lists replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge_deep(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(folder: str, profile: str | None = None, request: dict | None = None) -> dict:
    """Profile, then project file, then saved state, then the request's non-null values; JSON files in a local folder."""
    if profile is not None and not re.fullmatch(r"[\w\-]+", profile):
        raise ValueError(f"bad profile name: {profile!r}")
    out: dict = {}
    for name in ([f"profiles/{profile}.json"] if profile else []) + ["project.json", "state.json"]:
        p = Path(folder, name)
        if p.exists():
            out = merge_deep(out, json.loads(p.read_text()))
    return merge_deep(out, {k: v for k, v in (request or {}).items() if v is not None})
