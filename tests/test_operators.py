"""Golden values and properties of the operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import scalar as S
from cellweave.operators import counts as C
from cellweave.operators import embed as M
from cellweave.operators import expression as X
from cellweave.operators import image as I
from cellweave.operators import joins as J
from cellweave.operators import spatial as P
from cellweave.operators import stats as T


def squares(spark):
    rows = [(r, c, k) for k, (r0, c0) in enumerate([(5, 5), (5, 50), (50, 5), (50, 50), (25, 25)], 1) for r in range(r0, r0 + 10) for c in range(c0, c0 + 10)]
    return spark.createDataFrame(rows, "row int, col int, cell_id long")


def test_square_masks(spark):
    m = squares(spark)
    a = {r.cell_id: r for r in C.area_centroid(m).collect()}
    assert a[1].area == 100 and (a[1].centroid_row, a[1].centroid_col) == (9.5, 9.5)
    assert J.touching(m).count() == 0
    assert C.area_filter(m, 20, 99).count() == 0
    assert J.boundary_pixels(m).where("cell_id = 1").count() == 36


def test_touching_pair(spark):
    rows = [(r, c, 1) for r in range(4) for c in range(4)] + [(r, c, 2) for r in range(4) for c in range(4, 8)] + [(20, 20, 3)]
    m = spark.createDataFrame(rows, "row int, col int, cell_id long")
    assert [tuple(r) for r in J.touching(m).collect()] == [(1, 2)]


def test_attribution_keeps_totals(spark):
    bins = spark.createDataFrame([(5, 5, 2.0), (5, 50, 3.0), (0, 0, 4.0)], "row int, col int, value double")
    got = {r.cell_id: r.value for r in J.attribute(bins, squares(spark)).collect()}
    assert got == {1: 2.0, 2: 3.0, 0: 4.0}


def test_ids_of_many_formats(spark):
    df = spark.createDataFrame([("7",), ("cell_7",), ("roi__cell_7",), ("7.0",), ("AAAC-1",)], "s string")
    assert [r[0] for r in df.select(S.canonical_id(F.col("s"))).collect()] == [7, 7, 7, 7, None]


def test_dense_ids(spark):
    df = spark.createDataFrame([(x,) for x in (5, 100, 7, 2_000_000, 3)], "k long")
    assert {r.k: r.dense for r in J.dense_ids(df, "k", chunk=50).collect()} == {3: 0, 5: 1, 7: 2, 100: 3, 2_000_000: 4}


def test_empty_cells_are_kept_on_request(spark):
    counts = spark.createDataFrame([(1, 1, 3.0), (1, 2, 1.0)], "cell_id long, gene_id long, value double")
    genes = spark.createDataFrame([(1, True), (2, False)], "gene_id long, mito boolean")
    cells = spark.createDataFrame([(1,), (2,)], "cell_id long")
    got = {r.cell_id: (r.total, r.n_genes, r.pct_flagged, r.complexity) for r in C.qc_metrics(counts, genes, cells).collect()}
    assert got[1][:3] == (4.0, 2, 75.0) and got[2] == (0.0, 0, 0.0, 0.0)


#: Neighbour divergences of two methods on 15 regions whose exact test is published: differences with these ranks and signs.
def test_exact_signed_rank():
    assert T.exact_signed_rank_p(21.0, list(range(1, 16))) == pytest.approx(0.02557373046875, abs=0)
    assert T.exact_signed_rank_p(0.0, [1.0]) == 1.0


def test_chi2_tail():
    assert T.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert T.chi2_tail(11.070497693516351, 5) == pytest.approx(0.05, rel=1e-9)
    assert T.chi2_tail(0.0, 2) == 1.0


#: Rows of the published metric table, with their composite scores.
def test_composite_formula(spark):
    row = dict(a1_capture=0.7, a1_umi_density=10.0, a2_median_umi=500.0, a3_median_genes=240.0, c1_coexpr=0.01, ned=0.7, d1_silhouette=0.1, e1_immune_survival=0.9)
    df = spark.createDataFrame([("m", "a", *row.values()), ("m", "b", *(row | {"a1_umi_density": 12.5, "ned": None}).values())], "method string, roi string, " + ", ".join(f"{k} double" for k in row))
    got = {r.roi: r for r in T.composite(df).collect()}
    cap = (2 * 0.8 + math.log(500) / math.log(1000) + 0.8) / 4
    assert got["a"].tas == pytest.approx(0.65 * math.sqrt(cap * math.sqrt(0.99 * 0.7)) + 0.35 * 0.55)
    assert got["b"].purity_score == pytest.approx(0.99)


def test_nearest_equals_brute_force(spark):
    rng = random.Random(4)
    a = [(i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(60)]
    b = [(i, rng.uniform(0, 5000), rng.uniform(0, 1000)) for i in range(40)]
    got = {r.id: (r.near, r.distance) for r in P.nearest(spark.createDataFrame(a, "id long, x double, y double"), spark.createDataFrame(b, "id long, x double, y double"), 20.0).collect()}
    for i, x, y in a:
        d, j = min(((x - p) ** 2 + (y - q) ** 2, k) for k, p, q in b)
        assert got[i][0] == j and got[i][1] == pytest.approx(math.sqrt(d))


def test_nearest_meets_few_places(spark):
    rng = random.Random(6)
    b = [(i, float(i % 40), float(i // 40 % 40)) for i in range(4800)]  # three points a place
    a = [(i, rng.uniform(-1, 41), rng.uniform(0, 40)) for i in range(80)] + [(80, None, 1.0)]
    A, B = (spark.createDataFrame(x, "id long, x double, y double") for x in (a, b))
    assert P._met(A, B, 400.0)[1].count() < 80 * 200  # all 1,600 places each before, in 4,800 rows
    got = {r.id: (r.near, r.distance) for r in P.nearest(A, B, 400.0).collect()}
    want = {i: min(((x - p) ** 2 + (y - q) ** 2, k) for k, p, q in b) for i, x, y in a[:-1]}
    assert set(got) == set(want) and all(got[i][0] == j and got[i][1] == pytest.approx(math.sqrt(d)) for i, (d, j) in want.items())


def executed(df):
    """Rows, and the plan as it ran at last."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_nearest_sends_no_exploded_rows_to_the_driver(spark):
    rng = random.Random(8)
    b = [(i, float(i % 20 - 10), float(i // 20 % 20 - 10)) for i in range(400)] + [(400, 300.0, -250.0), (401, 300.0, -250.0)]
    a = [(i, rng.randint(-30, 30) / 2, rng.randint(-30, 30) / 2) for i in range(60)]  # ties of two and four places, both sides of 0
    a += [(60 + i, rng.uniform(-400, 400), rng.uniform(-400, 400)) for i in range(20)] + [(80, 1.0, None)]
    A, B = (spark.createDataFrame(x, "id long, x double, y double") for x in (a, b))
    rows, plan = executed(P.nearest(A, B, 5.0))
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan  # sides of joins were broadcast by their size before 9, 49 or more steps
    want = {i: min(((x - p) ** 2 + (y - q) ** 2, k) for k, p, q in b) for i, x, y in a[:-1]}
    assert {r.id: r.near for r in rows} == {i: k for i, (_, k) in want.items()}
    assert all(r.distance == pytest.approx(math.sqrt(want[r.id][0])) for r in rows)
    one = spark.createDataFrame([(7, 2.0, 3.0)], "id long, x double, y double")
    assert {r.near for r in P.nearest(A, one, 5.0).collect()} == {7} and P.nearest(A, one.limit(0), 5.0).count() == 0 == P.nearest(A.limit(0), B, 5.0).count()


def test_neighbourhoods_of_crowded_places(spark):
    n = 60_000  # n * n pairs of points, but few of places
    points = spark.range(4 * n).select("id", (F.col("id") % 4 % 3).cast("double").alias("x"), F.lit(0.0).alias("y"), F.element_at(F.array(*map(F.lit, "abca")), (F.col("id") % 4 + 1).cast("int")).alias("subtype"))
    got = P.neighbourhoods(points, "a", 1.0, 2).groupBy("subtype", "n", "fraction").count().collect()
    assert {(r.subtype, r.n, r.fraction, r["count"]) for r in got} == {("b", n, 1.0, 2 * n)}


def test_local_fit_of_repeated_points():
    rng = np.random.default_rng(3)
    x = np.sort(rng.uniform(0, 4, 300))
    y = np.sin(x) + rng.normal(0, 0.1, 300)
    fit = M.loess(np.repeat(x, 1000), np.repeat(y, 1000))  # 300,000 windows of 90,000 points before
    assert np.allclose(fit[::1000], M.loess(x, y), atol=1e-9)


def test_radius_includes_its_border(spark):
    grid = spark.createDataFrame([(5 * i + j, 10.0 * i, 10.0 * j) for i in range(5) for j in range(5)], "id long, x double, y double")
    n = P.radius_pairs(grid, grid, 10.0).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in n}[12] == 5


def test_morans_i(spark):
    cells = lambda f: spark.createDataFrame([(r, c, float(f(r, c))) for r in range(4) for c in range(4)], "gr int, gc int, value double")
    assert P.morans_i(cells(lambda r, c: 3)).first().i == 0
    z = [[(r + c) % 2 - 0.5 for c in range(4)] for r in range(4)]
    links = [(r, c, r + a, c + b) for r in range(4) for c in range(4) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and 0 <= r + a < 4 and 0 <= c + b < 4]
    want = 16 * sum(z[r][c] * z[p][q] for r, c, p, q in links) / (len(links) * 16 * 0.25)
    assert P.morans_i(cells(lambda r, c: (r + c) % 2)).first().i == pytest.approx(want)


def test_hellinger_kinds(spark):
    df = spark.createDataFrame([([0.5, 0.5], [1.0, 0.0])], "p array<double>, q array<double>")
    a, b = df.select(X.hellinger(F.col("p"), F.col("q")), X.hellinger_sq(F.col("p"), F.col("q"))).first()
    assert a * a == pytest.approx(b)


def test_divergence_bounds_and_empty_cells(spark):
    counts = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0)], "cell_id long, gene_id long, value double")
    genes = spark.createDataFrame([(1,), (2,)], "gene_id long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 4)], "a long, b long")
    r = X.neighbour_divergence(counts, pairs, genes, least=3).first()
    assert r.divergence == pytest.approx((1 + math.sqrt(0.5) + 0) / 3)
    assert X.neighbour_divergence(counts, pairs, genes, least=5).first().divergence is None


def test_rank_sums_with_implicit_zeros(spark):
    rng = random.Random(1)
    dense = {(c, g): rng.choice([0, 0, 1, 2, 3]) for c in range(12) for g in range(3)}
    counts = spark.createDataFrame([(c, g, float(v)) for (c, g), v in dense.items() if v], "cell_id long, gene_id long, value double")
    groups = spark.createDataFrame([(c, c % 2) for c in range(12)], "cell_id long, grp int")
    got = {(r.grp, r.gene_id): r.u for r in X.rank_sum_markers(counts, groups).collect()}
    for (k, g), u in got.items():
        a, b = [dense[c, g] for c in range(12) if c % 2 == k], [dense[c, g] for c in range(12) if c % 2 != k]
        assert u == pytest.approx(sum((x > y) + 0.5 * (x == y) for x in a for y in b))


def brute_silhouettes(x, y):
    d, out = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), []
    for k, lab in enumerate(y):
        means = {m: d[k][y == m].sum() / ((y == m).sum() - (m == lab)) for m in set(y.tolist()) if (y == m).sum() > 1 or m != lab}
        own, other = means.get(lab), min(v for m, v in means.items() if m != lab)
        out.append(0.0 if own is None else (other - own) / max(own, other))
    return out


def test_silhouettes_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS", 16)
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((90, 3)), np.arange(90) % 4
    y[:5] = 7
    y[89] = 9  # alone
    x, y, ids = np.concatenate([x, x[:2]]), np.concatenate([y, y[:2]]), [*range(90), 0, 1]  # repeated rows
    rows = [(i, v.tolist(), int(k)) for i, v, k in zip(ids, x, y, strict=True)] + [(500, x[0].tolist(), None)]
    got = sorted((r.id, r.label, r.silhouette) for r in M.silhouette(spark.createDataFrame(rows, "id long, v array<double>, label int")).collect())
    want = sorted((i, int(k), s) for i, k, s in zip(ids, y, brute_silhouettes(x, y), strict=True))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want])


def test_silhouettes_take_all_rows(spark):
    n = 10_050  # one dimension and two labels, so that brute force is short
    table = spark.range(n).select("id", F.array((F.col("id") % 97).cast("double")).alias("v"), (F.col("id") % 2).cast("int").alias("label"))
    got = {r.id: r.silhouette for r in M.silhouette(table).collect()}
    v, lab = np.arange(n) % 97, np.arange(n) % 2
    assert len(got) == n
    for k in (0, 1, 5000, n - 1):
        d = np.abs(v - v[k])
        a, b = d[lab == lab[k]].sum() / ((lab == lab[k]).sum() - 1), d[lab != lab[k]].mean()
        assert got[k] == pytest.approx((b - a) / max(a, b))


def test_expansion_keeps_ties_in_order(spark):
    seeds = spark.createDataFrame([(0, 0, 1), (0, 4, 2)], "row int, col int, cell_id long")
    empty = spark.createDataFrame([(0, c) for c in (1, 2, 3)], "row int, col int")
    assert {r.col: r.cell_id for r in J.expand_labels(seeds, empty, 3).collect()} == {1: 1, 2: 1, 3: 2}


def test_stitching_joins_across_a_seam(spark):
    rows = [(0 if c < 5 else 0, 0 if c < 5 else 1, 2, c, 1) for c in range(3, 8)] + [(0, 1, 8, 9, 2)]
    m = spark.createDataFrame(rows, "trow int, tcol int, row int, col int, cell_id long")
    ids = {(r.row, r.col): r.cell_id for r in I.stitch(m).collect()}
    assert len({ids[2, c] for c in range(3, 8)}) == 1 and ids[8, 9] != ids[2, 3]


def test_polygon_fill_and_contour(spark):
    ring = [[2.0, 2.0], [6.0, 2.0], [6.0, 6.0], [2.0, 6.0]]
    px = I.fill_polygons(spark.createDataFrame([(9, 0, ring)], "cell_id long, ord long, ring array<array<double>>"))
    assert px.count() == 25
    out = I.contours(px).first()
    assert out.ring[0] == out.ring[-1] and len(out.ring) == 21


def test_filters_reach_the_scan(spark, small):
    from cellweave.plans.catalogue import QUERIES

    plan = QUERIES["a5_transcripts_in_box"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_extendedprice)" in plan and "l_shipdate" not in plan


def test_marker_table(spark):
    rng = np.random.default_rng(3)
    dense = rng.poisson(0.8, (40, 12)).astype(float)
    dense[:20, 0] += 3
    dense[20:, 5] = 0  # a gene that one group lacks
    group = np.repeat([0, 1], 20)
    counts = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(40) for j in range(12) if dense[i, j] > 0], "cell_id long, gene_id long, value double")
    groups = spark.createDataFrame([(i, int(g)) for i, g in enumerate(group)], "cell_id long, grp int")
    names = spark.createDataFrame([(j, f"g{j}") for j in range(12)], "gene_id long, name string")
    got = {(r.cluster, r.gene): r for r in X.marker_table(counts, groups, names, 12).collect()}
    for g in (0, 1):
        z = []
        for j in range(12):
            v = dense[:, j]
            rank = np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
            u = rank[group == g].sum() - 20 * 21 / 2
            ties = sum(t**3 - t for t in np.unique(v, return_counts=True)[1])
            z.append((u - 200) / math.sqrt(400 / 12 * (41 - ties / (40 * 39))))
        p = np.array([math.erfc(abs(x) / math.sqrt(2)) for x in z])
        order = np.argsort(p)
        q = np.empty(12)
        q[order] = np.minimum(np.minimum.accumulate((p[order] * 12 / np.arange(1, 13))[::-1])[::-1], 1)
        for j in range(12):
            r = got[g, f"g{j}"]
            assert r.score == pytest.approx(z[j]) and r.pval_adj == pytest.approx(q[j])
    best = [r.gene for r in X.marker_table(counts, groups, names, 1).orderBy("cluster").collect()]
    assert best[0] in ("g0", "g5") and len(best) == 2


def test_resolution_search_keeps_the_nearest(spark):
    edges = [(4 * b + i, 4 * b + j, 1.0) for b in range(6) for i in range(4) for j in range(i)] + [(4 * b, (4 * b + 4) % 24, 1.0) for b in range(6)]
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    assert M.resolution_for(e, 6)[1] == 6
    resolution, n = M.resolution_for(e, 5, tries=3)
    tried = [M.cluster_graph(e, [x]).select("cluster").distinct().count() for x in (1.55, resolution)]
    assert tried[1] == n and abs(n - 5) <= abs(tried[0] - 5)


def test_regularised_genes_against_dense(spark):
    rng = np.random.default_rng(9)
    mean = rng.uniform(0.2, 6, 60)
    dense = rng.poisson(mean, (80, 60)).astype(float)
    counts = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(80) for j in range(60) if dense[i, j] > 0], "cell_id long, gene_id long, value double")
    got = {r.gene_id: r.variance_norm for r in M.regularised_genes(counts, 80, 60).collect()}
    mu, var = dense.mean(axis=0), dense.var(axis=0, ddof=1)
    x, y = np.log10(mu), np.log10(var)
    fit = np.empty(60)
    for i in range(60):
        near = np.argsort(np.abs(x - x[i]), kind="stable")[:18]
        w = np.sqrt(np.maximum((1 - (np.abs(x[near] - x[i]) / np.abs(x[near] - x[i]).max()) ** 3) ** 3, 0))
        fit[i] = np.polyval(np.polyfit(x[near] - x[i], y[near], 2, w=w), 0)
    sd = np.sqrt(10**fit)
    clipped = np.minimum(dense, mu + sd * math.sqrt(80))
    want = ((clipped - mu) ** 2).sum(axis=0) / (79 * sd**2)
    assert all(got[j] == pytest.approx(want[j], rel=1e-4) for j in range(60))


def test_tissue_mask_against_loops(spark):
    rng = np.random.default_rng(2)
    img = rng.integers(215, 256, (30, 34, 3))
    img[8:14, 9:20] = 90
    img[20, 25] = 10
    rows = [(i, j, *map(int, img[i, j])) for i in range(30) for j in range(34)]
    got = {(r.row, r.col) for r in I.tissue_mask(spark.createDataFrame(rows, "row int, col int, r int, g int, b int"), (30, 34)).collect()}
    shape = lambda k: [(y, x) for y in range(-(k // 2), k // 2 + 1) for x in range(-(k // 2), k // 2 + 1) if abs(x) <= round((k // 2) * math.sqrt(1 - (y / (k // 2)) ** 2))]
    inside = lambda i, j: 0 <= i < 30 and 0 <= j < 34

    def grow(mask, k):
        return {(i + y, j + x) for i, j in mask for y, x in shape(k) if inside(i + y, j + x)}

    mask = {(i, j) for i in range(30) for j in range(34) if round(float(img[i, j] @ [0.299, 0.587, 0.114])) < 220}
    grown = grow(mask, 11)
    closed = {(i, j) for i, j in grown if all((i + y, j + x) in grown for y, x in shape(11) if inside(i + y, j + x))}
    assert got == grow(grow(closed, 5), 5)


def test_stain_vectors(spark):
    rng = np.random.default_rng(6)
    true = np.array([[0.56, 0.72, 0.41], [0.22, 0.80, 0.56]])
    true /= np.linalg.norm(true, axis=1, keepdims=True)
    od = rng.uniform(0, 1.5, (4000, 2)) ** 2 @ true + 0.02
    px = 241 * np.exp(-od) - 1
    table = spark.createDataFrame(px.tolist(), "r double, g double, b double")
    got = I.stain_vectors(table)
    seen = od[(od >= 0.15).all(axis=1)]
    axes = np.linalg.eigh(np.cov(seen, rowvar=False))[1][:, [2, 1]]
    angle = np.arctan2(seen @ axes[:, 1], seen @ axes[:, 0])
    ends = np.stack([axes @ [np.cos(a), np.sin(a)] for a in np.percentile(angle, [1, 99])])
    want = ends if ends[0, 0] > ends[1, 0] else ends[::-1]
    assert np.allclose(got, want, atol=1e-6)
    assert I.stain_vectors(table.limit(20)) is None


def test_points_in_regions(spark):
    from cellweave.operators.region import in_regions

    rng = random.Random(4)
    points = [(i, rng.uniform(-50, 150), float(rng.randint(-5, 12) * 10)) for i in range(300)]
    boxes = [("a", 0.0, 0.0, 50.0, 40.0), ("b", 40.0, 30.0, 120.0, 70.0), ("c", -20.0, -20.0, 0.0, 0.0), ("empty", 5.0, 5.0, 5.0, 5.0)]
    got = in_regions(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(boxes, "roi string, x0 double, y0 double, x1 double, y1 double"))
    want = {(i, b[0]) for i, x, y in points for b in boxes if b[1] <= x < b[3] and b[2] <= y < b[4]}
    rows = [(r.id, r.roi) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and got.columns == ["id", "x", "y", "roi", "x0", "y0", "x1", "y1"]


def test_outlines_at_half_height():
    assert I.outlines({(0, 0)}) == [[(-0.5, 0.0), (0.0, 0.5), (0.5, 0.0), (0.0, -0.5), (-0.5, 0.0)]]
    assert sorted(map(len, I.outlines({(0, 0), (1, 1)}))) == [5, 5]  # corners only: apart
    frame = {(r, c) for r in range(5) for c in range(5)} - {(2, 2)}
    assert sorted(map(len, I.outlines(frame))) == [5, 21]
    bent = {(0, 0), (1, 0), (1, 1)}
    (ring,) = I.outlines(bent)
    assert len(ring) == 9 and set(ring) == {(-0.5, 0), (0, 0.5), (0.5, 1), (1, 1.5), (1.5, 1), (1.5, 0), (1, -0.5), (0, -0.5)}


def test_draws_are_not_sent_to_the_driver(spark):
    rng = random.Random(9)
    a, b = ([(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(n)] for n in (20, 30))
    A, B = (spark.createDataFrame(x, "id long, x double, y double") for x in (a, b))
    rows, plan = executed(P.random_nearest(A, B, 10.0, 4, 3.0, seed=7))
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan  # the draws were broadcast by the size of the points before
    own = {r.perm: r.median for r in rows}
    assert set(own) == {-1, 0, 1, 2, 3} and own[-1] == pytest.approx(np.median([min(math.hypot(x - p, y - q) for _, p, q in b) for _, x, y in a]))


def test_randomness_against_loops(spark):
    rng = random.Random(5)
    b = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(40)]
    a = [(i, b[i][1] + rng.uniform(-2, 2), b[i][2] + rng.uniform(-2, 2)) for i in range(30)]
    A, B = (spark.createDataFrame(x, "id long, x double, y double") for x in (a, b))
    drawn = {r.perm: r for r in P.random_nearest(A, B, 10.0, 12, 3.0, seed=7).collect()}
    u = spark.createDataFrame([(i, p) for i, _, _ in a for p in range(12)], "id long, perm int").select("id", "perm", *[(F.shiftrightunsigned(F.xxhash64("id", "perm", F.lit(7), F.lit(k)), 11) / float(1 << 53)).alias(f"u{k}") for k in (1, 2)]).collect()
    xs, ys = [p[1] for p in a + b], [p[2] for p in a + b]
    near = lambda x, y: min(math.hypot(x - q[1], y - q[2]) for q in b)
    draws = {-1: [near(x, y) for _, x, y in a]}
    for r in u:
        draws.setdefault(r.perm, []).append(near(min(xs) + r.u1 * (max(xs) - min(xs)), min(ys) + r.u2 * (max(ys) - min(ys))))
    for k, d in draws.items():
        assert drawn[k].median == pytest.approx(np.median(d)) and drawn[k].contact_pct == pytest.approx(100 * np.mean(np.array(d) < 3))
    test = P.randomness_test(P.random_nearest(A, B, 10.0, 12, 3.0, seed=7)).first()
    assert test.p_median == 0 and test.p_contact == 0 and test.contact_low <= test.contact_random <= test.contact_high < test.contact_pct
