"""Joins and set operations (survey sections E and I, D8, F4, G7, N7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from .registry import query
from .views import Views, sql


@query("e1_bin_attribution", sql("pixels raster", "SELECT coalesce(cell_id, 0) AS cell_id, count(*) AS bins, sum(value) AS value FROM pixels LEFT JOIN raster USING (\"row\", col) GROUP BY 1"))
def _(v: Views):
    return J.attribute(v.pixels(), v.raster()).groupBy("cell_id").agg(F.count(F.lit(1)).alias("bins"), F.sum("value").alias("value"))


@query("e2_barcode_join", sql("bins cells", "SELECT roi, count(*) AS n, sum(value) AS value FROM bins JOIN cells USING (cell_id) GROUP BY 1"))
def _(v: Views):
    return v.bins().join(v.cells(), "cell_id").groupBy("roi").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


@query("e3_index_intersection", sql("counts genes", "SELECT DISTINCT gene_id FROM genes JOIN counts USING (gene_id)"))
def _(v: Views):
    return v.genes().join(v.counts(), "gene_id", "left_semi").select("gene_id")


_PER = "SELECT method, site, sum(value) AS {0} FROM bins JOIN cells USING (cell_id) WHERE {1} GROUP BY 1, 2"


@query("e4_composite_key_left_join", sql("bins cells", "SELECT a.method, a.site, total, high FROM a LEFT JOIN b ON a.method = b.method AND a.site = b.site", a=_PER.format("total", "true"), b=_PER.format("high", "value > 49")))
def _(v: Views):
    t = v.bins().join(v.cells(), "cell_id")
    per = lambda df, name: df.groupBy("method", "site").agg(F.sum("value").alias(name))
    return per(t, "total").join(per(t.where("value > 49"), "high"), ["method", "site"], "left")


@query("e5_left_join_labels", sql("points", "SELECT id, subtype, n_name AS label FROM points LEFT JOIN nation ON id = n_nationkey"))
def _(v: Views):
    n = v.table("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("label"))
    return v.points().join(n, "id", "left").select("id", "subtype", "label")


@query("e6_semi_join", sql("counts genes", "SELECT gene_id, name FROM genes WHERE gene_id IN (SELECT gene_id FROM counts WHERE value >= 100)"))
def _(v: Views):
    return v.genes().join(v.counts().where("value >= 100"), "gene_id", "left_semi").select("gene_id", "name")


@query("e7_unlabelled_cells", sql("raster counts", "SELECT count(*) AS unlabelled FROM (SELECT DISTINCT cell_id FROM raster) r WHERE NOT EXISTS (SELECT 1 FROM counts c WHERE c.gene_id = r.cell_id AND value >= 100)"))
def _(v: Views):
    known = v.counts().where("value >= 100").select(F.col("gene_id").alias("cell_id"))
    return v.raster().select("cell_id").distinct().join(known, "cell_id", "left_anti").agg(F.count(F.lit(1)).alias("unlabelled"))


_SQUARE = 'SELECT bin_id, cell_id, count(*) AS n FROM b JOIN raster r ON r."row" BETWEEN b."row" - 1 AND b."row" + 1 AND r.col BETWEEN b.col - 1 AND b.col + 1 GROUP BY 1, 2'
_BINS = 'SELECT c_custkey AS bin_id, CAST(c_custkey % 53 AS INTEGER) AS "row", CAST(c_custkey % 41 AS INTEGER) AS col FROM customer'


def _some_bins(v: Views):
    k = F.col("c_custkey")
    return v.table("customer").select(k.alias("bin_id"), (k % 53).cast("int").alias("row"), (k % 41).cast("int").alias("col"))


@query("e8_weighted_attribution", sql("raster", "SELECT bin_id, cell_id, round(n / sum(n) OVER (PARTITION BY bin_id), 6) AS weight FROM hits", b=_BINS, hits=_SQUARE))
def _(v: Views):
    return J.weighted_attribution(_some_bins(v), v.raster(), 1).withColumn("weight", F.round("weight", 6))


@query("e12_touching_cells", sql("raster", 'SELECT DISTINCT least(cell_id, m) AS a, greatest(cell_id, m) AS b FROM (SELECT p."row", p.col, p.cell_id, max(q.cell_id) AS m FROM raster p JOIN raster q ON q."row" BETWEEN p."row" - 1 AND p."row" + 1 AND q.col BETWEEN p.col - 1 AND p.col + 1 GROUP BY ALL) WHERE m <> cell_id'))
def _(v: Views):
    return J.touching(v.raster())


_TOUCH = 'SELECT DISTINCT least(cell_id, m) AS a, greatest(cell_id, m) AS b FROM (SELECT p."row", p.col, p.cell_id, max(q.cell_id) AS m FROM raster p JOIN raster q ON q."row" BETWEEN p."row" - 1 AND p."row" + 1 AND q.col BETWEEN p.col - 1 AND p.col + 1 GROUP BY ALL) WHERE m <> cell_id'


@query("e13_larger_neighbours", sql("raster", "SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS n FROM t) WHERE n <= 3", t=_TOUCH))
def _(v: Views):
    return J.larger_neighbours(v.raster())


_HALF = 'SELECT "row", col, cell_id FROM raster WHERE ("row" + col) % 3 = 0'


@query(
    "e15_label_expansion",
    sql("raster", 'SELECT "row", col, cell_id, d2 FROM (SELECT e."row", e.col, s.cell_id, CAST((s."row" - e."row") * (s."row" - e."row") + (s.col - e.col) * (s.col - e.col) AS INTEGER) AS d2, row_number() OVER (PARTITION BY e."row", e.col ORDER BY (s."row" - e."row") ** 2 + (s.col - e.col) ** 2, s."row", s.col) AS n FROM e JOIN s ON (s."row" - e."row") ** 2 + (s.col - e.col) ** 2 <= 9) WHERE n = 1',
        s='SELECT * FROM raster WHERE "row" % 5 = 0 AND col % 5 = 0', e='SELECT * FROM raster WHERE NOT ("row" % 5 = 0 AND col % 5 = 0)'),
)
def _(v: Views):
    seed = (F.col("row") % 5 == 0) & (F.col("col") % 5 == 0)
    return J.expand_labels(v.raster().where(seed), v.raster().where(~seed), 3)


@query("e18_id_barcode_map", sql("cells", "SELECT cell_id, barcode FROM (SELECT cell_id, row_number() OVER (ORDER BY cell_id) AS n FROM cells) JOIN (SELECT name AS barcode, row_number() OVER (ORDER BY name) AS n FROM (SELECT 'BC' || p_partkey AS name FROM part)) USING (n)"))
def _(v: Views):
    pool = v.table("part").select(F.concat(F.lit("BC"), F.col("p_partkey").cast("string")).alias("barcode"))
    return J.assign_barcodes(v.cells().select("cell_id"), pool)


@query("e19_truth_label_chain", sql("raster genes", "SELECT coalesce(panel, 'unmatched') AS label, count(*) AS n FROM b LEFT JOIN raster USING (\"row\", col) LEFT JOIN genes ON genes.gene_id = raster.cell_id AND genes.gene_id <> 0 GROUP BY 1", b=_BINS))
def _(v: Views):
    labels = v.genes().select(F.col("gene_id").alias("cell_id"), F.col("panel").alias("label"))
    return J.label_chain(_some_bins(v), v.raster(), labels).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_BOXES = "SELECT subtype, min(x) + 2000 AS x0, min(y) AS y0, max(x) AS x1, max(y) - 1000 AS y1 FROM points WHERE id % 3 = {0} GROUP BY 1"


@query("e21_boxes_overlap", sql("points", "SELECT a.subtype AS a, b.subtype AS b FROM a JOIN b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1", a=_BOXES.format(0), b=_BOXES.format(1)))
def _(v: Views):
    box = lambda k: v.points().where(F.col("id") % 3 == k).groupBy("subtype").agg((F.min("x") + 2000).alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), (F.max("y") - 1000).alias("y1"))
    a, b = box(0), box(1)
    return a.join(b, J.boxes_meet(a, b)).select(a["subtype"].alias("a"), b["subtype"].alias("b"))


@query("e22_parameter_grid", "SELECT m.method, r_name AS roi FROM (SELECT DISTINCT l_returnflag AS method FROM lineitem) m CROSS JOIN region")
def _(v: Views):
    return v.bins().select("method").distinct().crossJoin(v.table("region").select(F.col("r_name").alias("roi")))


@query("e23_method_pairs", "SELECT a.m AS a, b.m AS b FROM (SELECT DISTINCT l_returnflag AS m FROM lineitem) a JOIN (SELECT DISTINCT l_returnflag AS m FROM lineitem) b ON a.m < b.m")
def _(v: Views):
    return J.pairs_of(v.bins(), "method")


@query("e14_label_overlap", sql("raster", "SELECT a_id, b_id, shared, a_area, b_area, round(shared / (a_area + b_area - shared), 6) AS iou FROM (SELECT a_id, b_id, count(*) AS shared FROM x JOIN y USING (\"row\", col) GROUP BY 1, 2) JOIN (SELECT a_id, count(*) AS a_area FROM x GROUP BY 1) USING (a_id) JOIN (SELECT b_id, count(*) AS b_area FROM y GROUP BY 1) USING (b_id)",
    x='SELECT "row", col, CAST(("row" // 5) * 100 + col // 5 AS BIGINT) AS a_id FROM raster', y='SELECT "row", col, CAST((("row" + 2) // 5) * 100 + (col + 1) // 5 AS BIGINT) AS b_id FROM raster'))
def _(v: Views):
    block = lambda a, b: v.raster().select("row", "col", (F.floor((F.col("row") + a) / 5) * 100 + F.floor((F.col("col") + b) / 5)).alias("cell_id"))
    return J.overlaps(block(0, 0), block(2, 1)).withColumn("iou", F.round("iou", 6))


@query("d8_area_filter", sql("raster", 'SELECT * FROM (SELECT CAST(("row" // 6) * 100 + col // 6 AS BIGINT) AS cell_id, count(*) AS area FROM raster GROUP BY 1) WHERE area BETWEEN 20 AND 35'))
def _(v: Views):
    cells = v.raster().withColumn("cell_id", F.floor(F.col("row") / 6) * 100 + F.floor(F.col("col") / 6))
    from ..operators.counts import area_filter

    return area_filter(cells, 20, 35).groupBy("cell_id").agg(F.count(F.lit(1)).alias("area"))


@query("f4_area_centroid", sql("raster", 'SELECT CAST(("row" // 6) * 100 + col // 6 AS BIGINT) AS cell_id, count(*) AS area, round(avg("row"), 6) AS centroid_row, round(avg(col), 6) AS centroid_col FROM raster GROUP BY 1'))
def _(v: Views):
    from ..operators.counts import area_centroid

    cells = v.raster().withColumn("cell_id", F.floor(F.col("row") / 6) * 100 + F.floor(F.col("col") / 6))
    return area_centroid(cells).select("cell_id", "area", F.round("centroid_row", 6).alias("centroid_row"), F.round("centroid_col", 6).alias("centroid_col"))


@query("g7_dense_relabel", sql("raster", "SELECT cell_id, CAST(dense_rank() OVER (ORDER BY cell_id) - 1 AS BIGINT) AS dense FROM (SELECT DISTINCT cell_id FROM raster)"))
def _(v: Views):
    return J.dense_ids(v.raster().select("cell_id").distinct(), "cell_id", chunk=64)


@query("n7_boundary_pixels", sql("raster", 'SELECT DISTINCT p."row", p.col, p.cell_id FROM b p LEFT JOIN b q ON abs(p."row" - q."row") + abs(p.col - q.col) = 1 AND p.cell_id = q.cell_id GROUP BY ALL HAVING count(q.cell_id) < 4', b='SELECT "row", col, CAST(("row" // 6) * 100 + col // 6 AS BIGINT) AS cell_id FROM raster'))
def _(v: Views):
    return J.boundary_pixels(v.raster().withColumn("cell_id", F.floor(F.col("row") / 6) * 100 + F.floor(F.col("col") / 6)))


@query("a1_unique_names", sql("genes", "SELECT gene_id, CASE WHEN k = 0 THEN brand ELSE brand || '-' || k END AS unique_name FROM (SELECT gene_id, brand, row_number() OVER (PARTITION BY brand ORDER BY gene_id) - 1 AS k FROM genes)"))
def _(v: Views):
    return J.unique_names(v.genes(), "brand", "gene_id").select("gene_id", "unique_name")


_ROI = "SELECT 'r{0}' AS roi, 'r{0}__' || cell_id AS cell_id, gene_id, value FROM counts WHERE cell_id % 4 = {0} AND gene_id % {1} <> 0"


def _rois(v: Views):
    return {f"r{k}": v.counts().where((F.col("cell_id") % 4 == k) & (F.col("gene_id") % m != 0)) for k, m in ((0, 3), (1, 5))}


@query("i1_concat_outer", sql("counts", f"SELECT roi, count(DISTINCT cell_id) AS cells, count(DISTINCT gene_id) AS genes, sum(value) AS total FROM ({_ROI.format(0, 3)} UNION ALL {_ROI.format(1, 5)}) GROUP BY 1"))
def _(v: Views):
    return J.concat(_rois(v)).groupBy("roi").agg(F.countDistinct("cell_id").alias("cells"), F.countDistinct("gene_id").alias("genes"), F.sum("value").alias("total"))


@query("i2_concat_inner", sql("counts", "SELECT roi, count(DISTINCT cell_id) AS cells, count(DISTINCT gene_id) AS genes, sum(value) AS total FROM u WHERE gene_id IN (SELECT gene_id FROM u GROUP BY 1 HAVING count(DISTINCT roi) = 2) GROUP BY 1", u=f"{_ROI.format(0, 3)} UNION ALL {_ROI.format(1, 5)}"))
def _(v: Views):
    return J.concat(_rois(v), genes="inner").groupBy("roi").agg(F.countDistinct("cell_id").alias("cells"), F.countDistinct("gene_id").alias("genes"), F.sum("value").alias("total"))


@query("i3_union_groups", sql("points", "SELECT subtype, max(x) AS best FROM points WHERE x > 0 GROUP BY 1 UNION ALL SELECT subtype, min(x) FROM points GROUP BY 1"))
def _(v: Views):
    p = v.points()
    return p.where("x > 0").groupBy("subtype").agg(F.max("x").alias("best")).union(p.groupBy("subtype").agg(F.min("x")))


@query("i4_intersect_keys", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(v: Views):
    return v.table("customer").select(F.col("c_nationkey").alias("k")).intersect(v.table("supplier").select("s_nationkey"))


@query("i5_key_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def _(v: Views):
    return v.table("part").select(F.col("p_partkey").alias("k")).exceptAll(v.table("lineitem").where("l_quantity > 45").select("l_partkey").distinct())


@query("i6_upsert", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 3 OR n_nationkey > 20) UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 3 OR n_nationkey > 20")
def _(v: Views):
    new = v.table("nation").where("n_nationkey < 3 OR n_nationkey > 20").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name"))
    return J.upsert(v.table("region").select("r_regionkey", "r_name"), new, "r_regionkey")


@query("i7_ordered_distinct", "SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(l), lambda x: {'p': list_position(l, x), 'x': x})), lambda s: s.x), ',') AS kinds FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x * 3) AS INTEGER)) AS l FROM embeddings)")
def _(v: Views):
    e = F.array_distinct(F.transform("embedding", lambda x: F.floor(x * 3).cast("int")))
    return v.table("embeddings").select("vec_id", F.array_join(F.transform(e, lambda x: x.cast("string")), ",").alias("kinds"))


@query("a6_boundaries_by_id", sql("points", "SELECT id, x, y FROM points WHERE subtype IN (SELECT DISTINCT subtype FROM points WHERE x BETWEEN 9000 AND 9300)"))
def _(v: Views):
    from ..sources.tables import with_vertex_in

    p = v.points().select("id", F.col("subtype").alias("cell_id"), F.col("x").alias("vertex_x"), F.col("y").alias("vertex_y"))
    return with_vertex_in(p, (9000, float("-inf"), 9300, float("inf"))).select("id", F.col("vertex_x").alias("x"), F.col("vertex_y").alias("y"))


@query("b11_sparse_indptr", sql("counts", "SELECT cell_id, nnz, CAST(coalesce(sum(nnz) OVER (ORDER BY cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS indptr FROM (SELECT cell_id, count(*) AS nnz FROM counts GROUP BY 1)"))
def _(v: Views):
    from ..operators.export import indptr

    return indptr(v.counts())


@query("b6_pseudo_transcripts", sql("pixels", 'SELECT "row", col, gene_id, sum(value) AS value FROM pixels WHERE value > 0 GROUP BY 1, 2, 3'))
def _(v: Views):
    from ..operators.export import pseudo_transcripts

    return pseudo_transcripts(v.pixels())


