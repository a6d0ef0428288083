"""Regions, coordinates and scalar functions (survey sections C, D1-D3, D14-D15, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import region as R
from .registry import query
from .views import Views, sql

BOX = (20_000.0, 500.0, 40_000.0, 1500.0)
M = [[1.1, 0.05, 30.0], [-0.02, 0.95, -12.0], [0.000001, 0.000002, 1.0]]
_IN = "x >= 20000 AND x < 40000 AND y >= 500 AND y < 1500"


@query("d1_box_half_open", sql("bins", f"SELECT gene_id, cell_id, x, CAST(y AS INTEGER) AS y FROM bins WHERE {_IN}"))
def _(v: Views):
    return R.in_box(v.bins(), BOX).select("gene_id", "cell_id", "x", F.col("y").cast("int").alias("y"))


@query("d2_box_inclusive", sql("bins", "SELECT method, count(*) AS n FROM bins WHERE x BETWEEN 20000 AND 40000 AND y BETWEEN 500 AND 1500 GROUP BY 1"))
def _(v: Views):
    return R.in_box(v.bins(), BOX, inclusive=True).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("d3_in_bounds_share", sql("bins", f"SELECT method, count(*) FILTER ({_IN}) AS hits, count(*) AS n, count(*) FILTER (NOT ({_IN})) * 10 > count(*) * 3 AS warn FROM bins GROUP BY 1"))
def _(v: Views):
    hit = R.inside(F.col("x"), F.col("y"), BOX)
    return v.bins().groupBy("method").agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n"), (F.count_if(~hit) * 10 > F.count(F.lit(1)) * 3).alias("warn"))


@query("c1_pixels_to_um", sql("points", "SELECT id, round(x * 0.2737, 6) AS x_um, round(y * 0.2737, 6) AS y_um FROM points"))
def _(v: Views):
    p = R.pixels_to_um(v.points(), ["x", "y"], 0.2737)
    return p.select("id", F.round("x_um", 6).alias("x_um"), F.round("y_um", 6).alias("y_um"))


@query("c2_um_to_pixels", sql("points", "SELECT id, CAST(round_even(x / 0.2737, 0) AS BIGINT) AS x_px, CAST(round_even(y / 0.2737, 0) AS BIGINT) AS y_px FROM points"))
def _(v: Views):
    p = v.points().select("id", F.col("x").alias("x_um"), F.col("y").alias("y_um"))
    return R.um_to_pixels(p, ["x_um", "y_um"], 0.2737).select("id", "x_px", "y_px")


_D = "(0.000001 * {x} + 0.000002 * {y} + 1.0)"
_PX, _PY = "(1.1 * {x} + 0.05 * {y} + 30.0) / " + _D, "(-0.02 * {x} + 0.95 * {y} - 12.0) / " + _D
_corner = lambda e: [e.format(x=a, y=b) for a in ("x0", "x1") for b in ("y0", "y1")]


@query(
    "c3_projected_box",
    sql(
        "points",
        f"SELECT subtype, round(least({', '.join(_corner(_PX))}), 6) AS px0, round(least({', '.join(_corner(_PY))}), 6) AS py0, round(greatest({', '.join(_corner(_PX))}), 6) AS px1, round(greatest({', '.join(_corner(_PY))}), 6) AS py1 FROM box",
        box="SELECT subtype, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM points GROUP BY 1",
    ),
)
def _(v: Views):
    box = v.points().groupBy("subtype").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return R.project_box(box, M).select("subtype", *[F.round(c, 6).alias(c) for c in ("px0", "py0", "px1", "py1")])


@query("c4_inverse_projection", sql("points", "SELECT id, round(x, 5) AS x, round(y, 5) AS y FROM points"))
def _(v: Views):
    p = v.points()
    fx, fy = R.project(F.col("x"), F.col("y"), M)
    p = p.select("id", fx.alias("fx"), fy.alias("fy"))
    bx, by = R.project_back(F.col("fx"), F.col("fy"), M)
    return p.select("id", (F.round(bx, 5) + S.num(0)).alias("x"), (F.round(by, 5) + S.num(0)).alias("y"))


@query("c5_local_pixels", sql("points", "SELECT id, CAST(round_even(y - 100.5, 0) AS INTEGER) AS row_r, CAST(round_even(x + 20.25, 0) AS INTEGER) AS col_r, CAST(trunc(y - 100.5) AS INTEGER) AS row_t, CAST(trunc(x + 20.25) AS INTEGER) AS col_t FROM points"))
def _(v: Views):
    r = R.local_pixels(v.points(), -20.25, 100.5).withColumnsRenamed({"row": "row_r", "col": "col_r"})
    return R.local_pixels(r, -20.25, 100.5, mode="trunc").select("id", "row_r", "col_r", F.col("row").alias("row_t"), F.col("col").alias("col_t"))


@query("c6_global_offset", sql("points", "SELECT id, subtype, round(x + x0, 6) AS x, round(y + y0, 6) AS y FROM points JOIN origins USING (subtype)", origins="SELECT subtype, min(x) AS x0, max(y) AS y0 FROM points GROUP BY 1"))
def _(v: Views):
    origins = v.points().groupBy("subtype").agg(F.min("x").alias("x0"), F.max("y").alias("y0"))
    return R.offset(v.points(), origins, "subtype").select("id", "subtype", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("c8_rescaled", sql("points", "SELECT id, round(x * (0.2737 / 0.5), 6) AS x, round(y * (0.2737 / 0.5), 6) AS y FROM points"))
def _(v: Views):
    return R.rescale(v.points(), 0.2737, 0.5, ["x", "y"]).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("c9_area_um2", sql("raster", "SELECT cell_id, count(*) AS area, round(count(*) * (0.2737::DOUBLE * 0.2737::DOUBLE), 6) AS area_um2 FROM raster GROUP BY 1"))
def _(v: Views):
    a = v.raster().groupBy("cell_id").agg(F.count(F.lit(1)).alias("area"))
    return R.areas_to_um2(a, "area", 0.2737).select("cell_id", "area", F.round("area_um2", 6).alias("area_um2"))


@query(
    "c10_tile_boxes",
    sql("", "SELECT level, tx, ty, " + ", ".join(
        f"CAST(least(floor(greatest({t} * 254 - CASE WHEN {t} > 0 THEN 1 ELSE 0 END, 0) * pow(2.0, 12 - level)), {m}) AS BIGINT) AS {a}, CAST(least(ceil((({t} + 1) * 254 + 1) * pow(2.0, 12 - level)), {m}) AS BIGINT) AS {b}"
        for t, a, b, m in (("tx", "x0", "x1", 4000), ("ty", "y0", "y1", 3000))) + " FROM tiles",
        tiles="SELECT CAST(p_size % 4 + 9 AS INTEGER) AS level, CAST(p_partkey % 7 AS INTEGER) AS tx, CAST(p_partkey % 5 AS INTEGER) AS ty FROM part"),
)
def _(v: Views):
    t = v.table("part").select((F.col("p_size") % 4 + 9).cast("int").alias("level"), (F.col("p_partkey") % 7).cast("int").alias("tx"), (F.col("p_partkey") % 5).cast("int").alias("ty"))
    return R.tile_box(t, 4000, 3000, 254, 1, 12)


@query("c11_strided_pixels", sql("raster", 'SELECT "row", col, cell_id FROM raster WHERE "row" % 4 = 0 AND col % 4 = 0'))
def _(v: Views):
    return R.strided(v.raster(), 4)


@query("c12_label_remap", sql("points", "SELECT coalesce(label, 'Unknown') AS label, count(*) AS n FROM points LEFT JOIN map ON subtype = key GROUP BY 1", map="SELECT * FROM (VALUES ('BUILDING', 'Epithelial'), ('MACHINERY', 'Immune'), ('FURNITURE', 'Immune')) t(key, label)"))
def _(v: Views):
    label = S.lookup(F.col("subtype"), {"BUILDING": "Epithelial", "MACHINERY": "Immune", "FURNITURE": "Immune"}, "Unknown")
    return v.points().groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


_WIDE = "SELECT roi, sum(value) FILTER (panel = 'ECONOMY') AS a, sum(value) FILTER (panel = 'PROMO') AS b FROM counts JOIN genes USING (gene_id) JOIN cells USING (cell_id) GROUP BY 1"


@query("c13_wide_to_long", sql("counts genes cells", "SELECT roi, 'mean' AS metric, avg(value) AS value FROM t GROUP BY 1 UNION ALL SELECT roi, 'max', max(value) FROM t GROUP BY 1", t="SELECT roi, value FROM counts JOIN cells USING (cell_id)").replace("avg(value)", "round(avg(value), 6)"))
def _(v: Views):
    wide = v.counts().join(v.cells(), "cell_id").groupBy("roi").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max"))
    return wide.unpivot(["roi"], ["mean", "max"], "metric", "value")


@query("c14_long_to_wide", sql("bins cells", "SELECT roi, sum(value) FILTER (method = 'A') AS a, sum(value) FILTER (method = 'N') AS n, sum(value) FILTER (method = 'R') AS r FROM bins JOIN cells USING (cell_id) GROUP BY 1"))
def _(v: Views):
    t = v.bins().join(v.cells().select("cell_id", "roi"), "cell_id").groupBy("roi").pivot("method", ["A", "N", "R"]).agg(F.sum("value"))
    return t.select("roi", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("c15_label_colours", sql("points", "SELECT subtype, CAST(dense_rank() OVER (ORDER BY subtype) - 1 AS INTEGER) AS code, CAST((dense_rank() OVER (ORDER BY subtype) - 1) % 3 AS INTEGER) AS colour FROM (SELECT DISTINCT subtype FROM points)"))
def _(v: Views):
    from pyspark.sql.window import Window

    code = (F.dense_rank().over(Window.orderBy("subtype")) - 1).cast("int")  # over the distinct labels only
    return v.points().select("subtype").distinct().withColumn("code", code).withColumn("colour", F.col("code") % 3)


_WIN = "SELECT CAST(p_partkey AS BIGINT) AS win, CAST((p_partkey * 997) % 60000 AS BIGINT) AS x0, CAST((p_partkey * 331) % 1800 AS BIGINT) AS y0, CAST((p_partkey * 997) % 60000 + 9000 AS BIGINT) AS x1, CAST((p_partkey * 331) % 1800 + 640 AS BIGINT) AS y1 FROM part WHERE p_size <= 5"


def _windows(v: Views):
    p = v.table("part").where("p_size <= 5")
    x, y = (F.col("p_partkey") * 997) % 60000, (F.col("p_partkey") * 331) % 1800
    return p.select(F.col("p_partkey").alias("window"), x.alias("x0"), y.alias("y0"), (x + 9000).alias("x1"), (y + 640).alias("y1"))


@query(
    "d14_window_coverage",
    sql("bins", "SELECT win AS \"window\", count(*) AS cells, count(taken.r) AS hits, round(count(taken.r) / count(*), 6) AS coverage FROM grid LEFT JOIN taken ON taken.r = grid.r AND taken.c = grid.c GROUP BY 1",
        w=_WIN, taken="SELECT DISTINCT CAST(floor(y / 160.0) AS BIGINT) AS r, CAST(floor(x / 160.0) AS BIGINT) AS c FROM bins WHERE in_tissue",
        rows_="SELECT win, x0, x1, unnest(range(y0 // 160, (y1 - 1) // 160 + 1)) AS r FROM w", grid="SELECT win, r, unnest(range(x0 // 160, (x1 - 1) // 160 + 1)) AS c FROM rows_"),
)
def _(v: Views):
    out = R.coverage(_windows(v), v.bins().where("in_tissue"), 160)
    return out.withColumn("coverage", F.round("coverage", 6))


@query("d15_sampled_windows")
def _(v: Views):
    cover = R.coverage(_windows(v), v.bins().where("in_tissue"), 160)
    return R.sample_windows(cover.withColumn("try_no", (F.col("window") % 50).cast("int")), strict=0.05, loose=0.01)


@query("j1_math", sql("counts", "SELECT cell_id, gene_id, round(log10(value), 6) AS a, round(ln(value), 6) AS b, round(ln(1 + value), 6) AS c, round(sqrt(value), 6) AS d, least(greatest(value, 3.0), 40.0) AS e FROM counts"))
def _(v: Views):
    x = F.col("value")
    return v.counts().select("cell_id", "gene_id", F.round(F.log10(x), 6).alias("a"), F.round(F.log(x), 6).alias("b"), F.round(F.log1p(x), 6).alias("c"), F.round(F.sqrt(x), 6).alias("d"), S.clip(x, 3, 40).alias("e"))


@query("j2_rounding", sql("points", "SELECT id, CAST(round_even(x, 0) AS INTEGER) AS a, CAST(trunc(x) AS INTEGER) AS b, CAST(floor(x / 16) AS BIGINT) AS c, CAST(ceil(x / 16) AS BIGINT) AS d FROM points"))
def _(v: Views):
    x = F.col("x")
    return v.points().select("id", S.rounded(x).alias("a"), S.truncated(x).alias("b"), F.floor(x / 16).alias("c"), F.ceil(x / 16).alias("d"))


@query("j3_angles", sql("points", "SELECT id, round(atan2(y, x), 6) AS angle, round(sqrt(x * x + y * y), 4) AS norm FROM points"))
def _(v: Views):
    return v.points().select("id", F.round(F.atan2("y", "x"), 6).alias("angle"), F.round(F.hypot("x", "y"), 4).alias("norm"))


@query("j6_strings", sql("genes", "SELECT gene_id, lower(name) AS low, upper(name) AS up, starts_with(name, 'Brand#2') AS pre, string_split(name, '_')[1] AS head, replace(name, '#', '-') AS rep, contains(lower(name), '13') AS has FROM genes"))
def _(v: Views):
    n = F.col("name")
    return v.genes().select("gene_id", F.lower(n).alias("low"), F.upper(n).alias("up"), n.startswith("Brand#2").alias("pre"), F.get(F.split(n, "_"), F.lit(0)).alias("head"), F.replace(n, F.lit("#"), F.lit("-")).alias("rep"), F.lower(n).contains("13").alias("has"))


_ID = "SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 5 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN 'cell_' || p_partkey WHEN 2 THEN 'roi' || p_size || '__cell_' || p_partkey WHEN 3 THEN p_partkey || '.0' ELSE 'AAAC' || p_partkey || '-x' END AS name FROM part"


def _names(v: Views):
    k = F.col("p_partkey")
    t = k.cast("string")
    name = F.when(k % 5 == 0, t).when(k % 5 == 1, F.concat(F.lit("cell_"), t)).when(k % 5 == 2, F.concat(F.lit("roi"), F.col("p_size").cast("string"), F.lit("__cell_"), t)).when(k % 5 == 3, F.concat(t, F.lit(".0"))).otherwise(F.concat(F.lit("AAAC"), t, F.lit("-x")))
    return v.table("part").select(k.alias("id"), name.alias("name"))


_CANON = "CAST(nullif(regexp_extract(name, '^(?:.*__)?(?:cell_)?(\\d+)(?:\\.0+)?$', 1), '') AS BIGINT)"


@query("j7_regex", sql("", f"SELECT id, {_CANON} AS canon, CAST(nullif(regexp_extract(name, '(\\d+)$', 1), '') AS BIGINT) AS tail, regexp_matches(name, '^[\\w\\-]+$') AS plain FROM ids", ids=_ID))
def _(v: Views):
    n = F.col("name")
    return _names(v).select("id", S.canonical_id(n).alias("canon"), S.trailing_number(n).alias("tail"), n.rlike(r"^[\w\-]+$").alias("plain"))


@query("e17_dense_ids", sql("", "SELECT canon, CAST(row_number() OVER (ORDER BY canon) - 1 AS BIGINT) AS dense FROM (SELECT DISTINCT canon FROM c WHERE canon IS NOT NULL)", ids=_ID, c=f"SELECT {_CANON} AS canon FROM ids"))
def _(v: Views):
    from ..operators.joins import dense_ids

    return dense_ids(_names(v).select(S.canonical_id(F.col("name")).alias("canon")).where("canon is not null").distinct(), "canon")


@query("j8_formatting", "SELECT event_id, CASE WHEN value < 10 THEN '***' WHEN value < 50 THEN '**' ELSE 'ns' END AS mark FROM events")
def _(v: Views):
    return v.table("events").select("event_id", S.steps(F.col("value"), [(10.0, "***"), (50.0, "**")], "ns").alias("mark"))


@query("j9_arrays", "SELECT vec_id, list_aggregate(list_distinct(list_transform(embedding[1:8], lambda x: CAST(floor(x * 4) AS INTEGER))), 'count') AS kinds, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings")
def _(v: Views):
    e = F.transform(F.slice("embedding", 1, 8), lambda x: F.floor(x * 4).cast("int"))
    return v.table("embeddings").select("vec_id", F.size(F.array_distinct(e)).cast("long").alias("kinds"), F.size("embedding").alias("dims"))


@query("j10_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.none'), 'unset') AS missing FROM events")
def _(v: Views):
    return v.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("unset")).alias("missing"))


@query("j11_dates", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS elapsed FROM events")
def _(v: Views):
    return v.table("events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.unix_timestamp("ts") - F.lit(1704067200)).cast("long").alias("elapsed"))


@query("j12_nulls", sql("counts", "SELECT cell_id, round(coalesce(sum(value) / nullif(count(*) FILTER (value > 60), 0), 0), 6) AS r FROM counts GROUP BY 1"))
def _(v: Views):
    return v.counts().groupBy("cell_id").agg(F.round(S.ratio(F.sum("value"), F.count_if(F.col("value") > 60)), 6).alias("r"))


@query("j13_category_codes", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM customer")
def _(v: Views):
    from ..operators.joins import category_codes

    return category_codes(v.table("customer"), "c_mktsegment").select("c_custkey", "code")


@query("j14_polygon_measures", sql("", "SELECT id, round(area, 4) AS area, round(cx, 4) AS centroid_x, round(cy, 4) AS centroid_y FROM (SELECT id, w * h / 2 AS area, x + w / 3 AS cx, y + h / 3 AS cy FROM t)", t="SELECT c_custkey AS id, c_acctbal AS x, CAST(c_custkey % 97 AS DOUBLE) AS y, CAST(c_custkey % 13 + 1 AS DOUBLE) AS w, CAST(c_custkey % 7 + 1 AS DOUBLE) AS h FROM customer"))
def _(v: Views):
    k = F.col("c_custkey")
    x, y, w, h = F.col("c_acctbal"), (k % 97).cast("double"), (k % 13 + 1).cast("double"), (k % 7 + 1).cast("double")
    t = v.table("customer").select(k.alias("id"), F.array(x, x + w, x).alias("xs"), F.array(y, y, y + h).alias("ys"))
    return R.polygon_measures(t).select("id", *[(F.round(c, 4) + S.num(0)).alias(c) for c in ("area", "centroid_x", "centroid_y")])


_B4 = "concat(" + ", ".join(f"substr('ACGT', CAST((s_suppkey // {4**k}) % 4 AS INTEGER) + 1, 1)" for k in range(15, -1, -1)) + ", '-1')"


@query("j15_barcodes", f"SELECT s_suppkey, {_B4} AS barcode FROM supplier")
def _(v: Views):
    return v.table("supplier").select("s_suppkey", S.barcode(F.col("s_suppkey")).alias("barcode"))


@query("j16_auto_resolution", sql("cells", "SELECT roi, count(*) * 100 AS n, CASE WHEN count(*) * 100 < 5000 THEN 0.8::DOUBLE WHEN count(*) * 100 < 50000 THEN 0.5::DOUBLE WHEN count(*) * 100 < 500000 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS resolution FROM cells GROUP BY 1"))
def _(v: Views):
    n = v.cells().groupBy("roi").agg((F.count(F.lit(1)) * 100).alias("n"))
    return n.withColumn("resolution", S.auto_resolution(F.col("n")))
