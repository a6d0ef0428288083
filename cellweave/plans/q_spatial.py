"""Spatial operators (survey sections E9-E11, F20-F23, G16, K6-K7, K10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embed as M
from ..operators import spatial as P
from .registry import query
from .views import Views, sql

_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


def kind(v: Views, name: str):
    return v.points().where(F.col("subtype") == name)


@query("e9_nearest_point", sql("points", f"SELECT id, near, round(sqrt(d2), 6) AS distance FROM (SELECT a.id, arg_min(b.id, {{'d': {_D2}, 'i': b.id}}) AS near, min({_D2}) AS d2 FROM points a JOIN points b ON a.subtype = 'BUILDING' AND b.subtype = 'MACHINERY' GROUP BY 1)"))
def _(v: Views):
    return P.nearest(kind(v, "BUILDING"), kind(v, "MACHINERY"), 200.0).select("id", "near", F.round("distance", 6).alias("distance"))


@query("e10_radius_join", sql("points", f"SELECT a.id, b.id AS other, round({_D2}, 4) AS d2 FROM points a JOIN points b ON a.subtype = 'BUILDING' AND b.subtype = 'FURNITURE' AND {_D2} <= 90000"))
def _(v: Views):
    return P.radius_pairs(kind(v, "BUILDING"), kind(v, "FURNITURE"), 300.0).select("id", "other", F.round("d2", 4).alias("d2"))


@query("e11_within_any", sql("points", f"SELECT id, subtype FROM points a WHERE EXISTS (SELECT 1 FROM points b WHERE b.subtype = 'HOUSEHOLD' AND {_D2} <= 22500)"))
def _(v: Views):
    return P.within_any(v.points(), kind(v, "HOUSEHOLD"), 150.0).select("id", "subtype")


@query("f20_neighbourhoods", sql("points", f"SELECT id, subtype, n, round(n / sum(n) OVER (PARTITION BY id), 6) AS fraction FROM (SELECT a.id, b.subtype, count(*) AS n FROM points a JOIN points b ON a.subtype = 'BUILDING' AND b.subtype <> 'BUILDING' AND {_D2} <= 160000 WHERE b.subtype IN (SELECT subtype FROM points GROUP BY 1 HAVING count(*) >= 20) GROUP BY 1, 2)"))
def _(v: Views):
    return P.neighbourhoods(v.points(), "BUILDING", 400.0, 20).withColumn("fraction", F.round("fraction", 6))


@query("f21_distance_bands", sql("points", f"SELECT band, count(*) AS n, round(avg(x), 4) AS mean_x FROM (SELECT a.id, any_value(a.x) AS x, CAST(CASE WHEN sqrt(min({_D2})) < 100 THEN 0 WHEN sqrt(min({_D2})) < 300 THEN 1 ELSE 2 END AS INTEGER) AS band FROM points a JOIN points b ON a.subtype = 'FURNITURE' AND b.subtype = 'MACHINERY' GROUP BY 1) GROUP BY 1"))
def _(v: Views):
    a = kind(v, "FURNITURE")
    d = a.join(P.nearest(a, kind(v, "MACHINERY"), 200.0), "id")
    return d.groupBy(P.distance_bands(d, "distance", (100.0, 300.0)).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 4).alias("mean_x"))


_GRID = "SELECT CAST(floor(y / 1000) AS BIGINT) AS gr, CAST(floor(x / 1000) AS BIGINT) AS gc, count(*) FILTER (subtype = 'BUILDING') AS na, count(*) FILTER (subtype = 'MACHINERY') AS nb FROM points GROUP BY 1, 2"


@query("f23_grid_ratio", sql("points", "SELECT gr, gc, na, nb, round(na / (na + nb + 1e-6), 6) AS ratio FROM g WHERE na + nb > 0", g=_GRID))
def _(v: Views):
    g = P.grid_ratio(v.points(), 1000.0, F.col("subtype") == "BUILDING", F.col("subtype") == "MACHINERY")
    return g.withColumn("ratio", F.round("ratio", 6))


@query("k7_morans_i", sql("points", "SELECT round((SELECT count(*) FROM z) * sum(a.z * b.z) / (count(*) * (SELECT sum(z * z) FROM z)), 6) AS i FROM z a JOIN z b ON abs(a.gr - b.gr) <= 1 AND abs(a.gc - b.gc) <= 1 AND (a.gr <> b.gr OR a.gc <> b.gc)", g=_GRID, z="SELECT gr, gc, CAST(na AS DOUBLE) - (SELECT avg(na) FROM g) AS z FROM g"))
def _(v: Views):
    g = v.points().groupBy(F.floor(F.col("y") / 1000).alias("gr"), F.floor(F.col("x") / 1000).alias("gc")).agg(F.count_if(F.col("subtype") == "BUILDING").cast("double").alias("value"))
    return P.morans_i(g).select(F.round("i", 6).alias("i"))


@query("k6_random_nearest", sql("points", f"SELECT perm, round(median(d), 6) AS median_nn, round(avg(CASE WHEN d <= 150 THEN 1 ELSE 0 END), 6) AS contact FROM (SELECT p.perm, a.id, sqrt(min({_D2})) AS d FROM points a JOIN p b ON a.subtype = 'BUILDING' JOIN (SELECT DISTINCT perm FROM p) p ON p.perm = b.perm GROUP BY 1, 2) GROUP BY 1", p="SELECT CAST(id % 3 AS INTEGER) AS perm, id, x, y FROM points WHERE subtype <> 'BUILDING'"))
def _(v: Views):
    a, out = kind(v, "BUILDING"), None
    others = v.points().where("subtype <> 'BUILDING'")
    for k in range(3):
        d = P.nearest_distance(a, others.where(F.col("id") % 3 == k), 400.0)
        row = d.agg(F.lit(k).alias("perm"), F.round(F.median("distance"), 6).alias("median_nn"), F.round(F.avg((F.col("distance") <= 150).cast("int")), 6).alias("contact"))
        out = row if out is None else out.union(row)
    return out


@query("k6_randomness_test")
def _(v: Views):
    return P.randomness_test(P.random_nearest(kind(v, "BUILDING"), kind(v, "MACHINERY"), 200.0, 20, 100.0, seed=42))


_WINDOWS = "SELECT wr, wc, n, 3 * least(a, b, c) + n AS score FROM (SELECT wr * 500 AS wr, wc * 500 AS wc, count(DISTINCT id) AS n, count(DISTINCT id) FILTER (subtype = 'BUILDING') AS a, count(DISTINCT id) FILTER (subtype = 'MACHINERY') AS b, count(DISTINCT id) FILTER (subtype = 'FURNITURE') AS c FROM points JOIN (SELECT unnest(range(0, 21)) AS wr) ON y >= wr * 500 AND y < wr * 500 + 2000 JOIN (SELECT unnest(range(0, 21)) AS wc) ON x >= wc * 500 AND x < wc * 500 + 2000 GROUP BY 1, 2) WHERE n >= 30 AND least(a, b, c) > 0"


@query("g16_sliding_window", sql("points", _WINDOWS))
def _(v: Views):
    return P.sliding_windows(v.points(), 2000, 500, ["BUILDING", "MACHINERY", "FURNITURE"], 30)


@query("g16b_best_window", sql("points", "SELECT arg_min(wr, {'s': -score, 'r': wr, 'c': wc}) AS wr, arg_min(wc, {'s': -score, 'r': wr, 'c': wc}) AS wc, max(score) AS score FROM w", w=_WINDOWS))
def _(v: Views):
    return P.best_window(P.sliding_windows(v.points(), 2000, 500, ["BUILDING", "MACHINERY", "FURNITURE"], 30))


@query(
    "k10_silhouette",
    sql("vectors", "SELECT id, label, round((b - a) / greatest(a, b), 5) AS silhouette FROM (SELECT id, any_value(lab) AS label, max(m) FILTER (lab = other) AS a, min(m) FILTER (lab <> other) AS b FROM (SELECT a.id, a.label AS lab, b.label AS other, CASE WHEN a.label = b.label THEN sum(list_distance(a.v, b.v)) / (count(*) - 1) ELSE avg(list_distance(a.v, b.v)) END AS m FROM vectors a CROSS JOIN vectors b GROUP BY 1, 2, 3) GROUP BY 1)"),
)
def _(v: Views):
    return M.silhouette(v.vectors()).withColumn("silhouette", F.round("silhouette", 5))
