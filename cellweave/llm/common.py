"""Stage tables in the shared folder, and connected components over link tables."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of bytes that are not white space; the same words as ``textkernel.Words``.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, else one set here (local runs and tests only)."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            folder = held.get()
        else:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = "/tmp/cellweave-checkpoints"
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Stages:
    """Parquet tables under the shared folder, which cut lineage: a lost executor costs no more than its running tasks.

    Tables are deleted when dropped, and the whole folder when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/cellweave-{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.delete, self.folder)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.folder}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        schema = df.schema
        del df
        self.sweep()
        out = self.spark.read.schema(schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and getattr(t, "_stage_path", "").startswith(self.folder):
                self.delete(t._stage_path)

    def sweep(self) -> None:
        """Lets Spark delete shuffle files that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def delete(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is over; nothing can be deleted any more
            if self.spark._jsc.sc().isStopped() is False:
                raise


#: Links that one task contracts at once.
PIECE = 2_000_000


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex of the links u - v that isn't the least of its component, with that one."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    up = np.arange(len(ids))
    while True:
        a, b = up[u], up[v]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        apart = lo != hi
        if not apart.any():
            break
        np.minimum.at(up, hi[apart], lo[apart])  # a root hangs on the least root that it has a link to
        while (up[up] != up).any():
            up = up[up]
    low = np.flatnonzero(up != np.arange(len(ids)))
    return ids[low], ids[up[low]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if rows:
        u, v = contract(*(np.concatenate(x) for x in zip(*rows, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(stages: Stages, links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)`` as ``(id, component)``, component the smallest id reachable.

    First, pieces of PIECE links are contracted to stars, a piece in a task; with one piece, that is the result.  Then
    alternates large-star and small-star steps until every vertex has one link, to a vertex without any.  Each step is
    a minimum per vertex (partial aggregation) and a join back, which adaptive execution splits at hubs; no neighbour
    list is ever gathered in one row.
    """

    def minima(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))

    def step(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("u", "v")
        if large:
            both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = minima(both)
        joined = both.join(m, "u")
        keep = F.col("v") > F.col("u") if large else F.col("v") != F.col("m")
        out = joined.where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.union(m.select("u", F.col("m").alias("v")))
        return out.where("u <> v")

    def done(edges: DataFrame) -> bool:
        if not edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return False
        return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()

    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stages.save(edges, "links")
    pieces = max(1, -(-edges.count() // PIECE))
    stars = stages.save(edges.coalesce(pieces).mapInArrow(_contract, "u long, v long"), "stars")
    stages.drop(edges)
    edges = stars
    while pieces > 1 and not done(edges):
        after = stages.save(step(step(edges, True), False).distinct(), "star")
        stages.drop(edges)
        edges = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
