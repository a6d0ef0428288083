"""Scans (survey section A) over the driver's tables, which stand for the domain's files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import image as I
from ..operators import joins as J
from ..sources import tables as S
from ..streaming import ingest
from .registry import query
from .views import Views, sql


@query("a2_positions_in_tissue", "SELECT l_partkey, l_suppkey, l_extendedprice AS x FROM lineitem WHERE l_linestatus = 'O' AND l_quantity >= 45")
def _(v: Views):
    ids = F.concat_ws("-", "l_partkey", "l_suppkey").alias("barcode")
    tissue = ((F.col("l_linestatus") == "O") & (F.col("l_quantity") >= 45)).cast("int").alias("in_tissue")
    p = v.table("lineitem").select(ids, tissue, F.col("l_extendedprice").alias("pxl_row_in_fullres"), F.col("l_tax").alias("pxl_col_in_fullres"))
    key = F.split("barcode", "-")
    return S.positions_of(p).select(F.get(key, F.lit(0)).cast("long").alias("l_partkey"), F.get(key, F.lit(1)).cast("long").alias("l_suppkey"), F.col("pxl_row_in_fullres").alias("x"))


@query("a3_column_list_scan", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def _(v: Views):
    return v.table("lineitem").select("l_suppkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("a4_cells_with_string_ids", "SELECT CAST(s_suppkey AS VARCHAR) AS cell_id, s_acctbal AS x, n_name AS site FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(v: Views):
    s = v.table("supplier").select(F.col("s_suppkey").alias("cell_id"), F.col("s_acctbal").alias("x_centroid"), F.lit(0.0).alias("y_centroid"), F.col("s_nationkey").alias("cell_area"))
    n = v.table("nation").select(F.col("n_nationkey").alias("cell_area"), F.col("n_name").alias("site"))
    return S.cells_of(s).join(n, "cell_area").select("cell_id", F.col("x_centroid").alias("x"), "site")


@query("a5_transcripts_in_box", "SELECT l_orderkey, l_partkey, l_extendedprice AS x, l_discount AS y FROM lineitem WHERE l_extendedprice >= 30000 AND l_extendedprice < 42000 AND l_discount >= 0.02 AND l_discount < 0.06")
def _(v: Views):
    t = v.table("lineitem").select(F.concat_ws("-", "l_orderkey", "l_partkey").alias("feature_name"), F.col("l_extendedprice").alias("x_location"), F.col("l_discount").alias("y_location"))
    key = F.split("feature_name", "-")
    return S.in_box(t, (30000, 0.02, 42000, 0.06)).select(F.get(key, F.lit(0)).cast("long").alias("l_orderkey"), F.get(key, F.lit(1)).cast("long").alias("l_partkey"), F.col("x_location").alias("x"), F.col("y_location").alias("y"))


@query("a8_gene_list", sql("genes counts", "SELECT DISTINCT name FROM genes JOIN counts USING (gene_id)"))
def _(v: Views):
    return v.genes().join(v.counts(), "gene_id", "left_semi").select("name").distinct()


@query("a10_points_with_dense_ids", sql("points", "SELECT id, coalesce(dense, -1) AS dense FROM points LEFT JOIN (SELECT k, CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS dense FROM (SELECT DISTINCT id AS k FROM points WHERE id % 3 <> 0)) ON id = k"))
def _(v: Views):
    dense = J.dense_ids(v.points().where("id % 3 <> 0").select(F.col("id").alias("k")).distinct(), "k", chunk=1000)
    return v.points().join(dense, F.col("id") == F.col("k"), "left").select("id", F.coalesce("dense", F.lit(-1)).cast("long").alias("dense"))


@query("a16_log_lines", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 7 <> 0")
def _(v: Views):
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{broken "), F.col("props"))).otherwise(F.col("props"))
    return S.parsed_lines(v.table("events").select("event_id", text.alias("line")), "line", "k long").select("event_id", F.col("row.k").alias("k"))


@query("c7_shifted_polygons", sql("points", "SELECT id AS cell_id, [[x + 10, y - 5], [x + 14, y - 5], [x + 14, y - 1], [x + 10, y - 5]] AS ring FROM points"))
def _(v: Views):
    ring = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((10.0, -5.0), (14.0, -5.0), (14.0, -1.0), (10.0, -5.0))])
    return I.shift_rings(v.points().select(F.col("id").alias("cell_id"), ring.alias("ring"), "x", "y"), F.col("x"), F.col("y")).select("cell_id", "ring")


@query("e20_polygon_fill")
def _(v: Views):
    k = F.col("c_custkey")
    x, y = (k * 37 % 500).cast("double"), (k * 91 % 400).cast("double")
    rings = v.table("customer").select(k.alias("cell_id"), k.alias("ord"), F.array(*[F.array(x + a, y + b) for a, b in ((0, 0), (6, 1), (5, 6), (0, 4))]).alias("ring"))
    return I.fill_polygons(rings)


@query("n5_density_seeds")
def _(v: Views):
    p = v.points().select((F.col("y") / 20).cast("int").alias("row"), (F.col("x") / 20 + 60).cast("int").alias("col"))
    return I.density_seeds(p, sigma=3.0, least=0.02)


@query("n3_ensemble_merge")
def _(v: Views):
    r = v.raster().withColumn("tile", F.lit(0))
    one = r.select("tile", "row", "col", (F.floor(F.col("row") / 5) * 100 + F.floor(F.col("col") / 5) + 1).alias("cell_id"), F.lit(0).alias("run"))
    two = r.select("tile", "row", "col", (F.floor((F.col("row") + 2) / 6) * 100 + F.floor(F.col("col") / 6) + 1).alias("cell_id"), F.lit(1).alias("run")).where("row % 7 <> 0")
    return I.merge_masks(one.where("(row + col) % 9 < 6").union(two))


@query("e24_stitched_tiles")
def _(v: Views):
    r = v.raster().withColumn("cell_id", F.floor(F.col("row") / 7) * 100 + F.floor(F.col("col") / 9) + 1)
    tiled = r.select(F.floor(F.col("row") / 20).cast("int").alias("trow"), F.floor(F.col("col") / 20).cast("int").alias("tcol"), "row", "col", "cell_id")
    return I.stitch(tiled)


@query("n8_contours")
def _(v: Views):
    return I.contours(v.raster().withColumn("cell_id", F.floor(F.col("row") / 5) * 100 + F.floor(F.col("col") / 5) + 1))


@query("n10_tile_polygons_merged", sql("points", "SELECT id, tx, ty, round(x + 0, 4) AS x, round(y + 0, 4) AS y FROM (SELECT id, x, y, CAST(floor(x / 2500) AS BIGINT) AS tx, CAST(floor(y / 2500) AS BIGINT) AS ty FROM points)"))
def _(v: Views):
    return I.owned_by_tile(v.points(), 2500.0).select("id", "tx", "ty", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def _stain_sql() -> str:
    m = np.array(I.STAINS)
    inv = np.linalg.inv(m / np.linalg.norm(m, axis=1, keepdims=True)).tolist()
    amount = [" + ".join(f"-ln(({c} + 1) / 256.0::DOUBLE) * ({x!r}::DOUBLE)" for c, x in zip("rgb", inv[k], strict=True)) for k in (0, 1)]
    return f"SELECT id, round(greatest({amount[0]}, 0), 6) AS hematoxylin, round({amount[1]}, 6) AS eosin FROM px"


@query("n2_stain_separation", sql("", _stain_sql(), px="SELECT c_custkey AS id, c_custkey * 7 % 200 + 30 AS r, c_custkey * 11 % 180 + 20 AS g, c_custkey * 13 % 190 + 40 AS b FROM customer"))
def _(v: Views):
    k = F.col("c_custkey")
    px = v.table("customer").select(k.alias("id"), (k * 7 % 200 + 30).alias("r"), (k * 11 % 180 + 20).alias("g"), (k * 13 % 190 + 40).alias("b"))
    return I.stains(px).select("id", F.round("hematoxylin", 6).alias("hematoxylin"), F.round("eosin", 6).alias("eosin"))


@query("e16_adaptive_expansion")
def _(v: Views):
    seed = (F.col("row") % 5 == 0) & (F.col("col") % 5 == 0)
    return I.adaptive_expand(v.raster().where(seed), v.raster().where(~seed), 4)


@query("m_windowed_event_totals", "SELECT event_type, epoch_ms(CAST(epoch_ms(ts) // 86400000 * 86400000 AS BIGINT)) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(v: Views):
    return ingest.windowed(v.table("events"), "1 day").select("event_type", F.col("window.start").alias("day"), "n", F.round("total", 4).alias("total"))
