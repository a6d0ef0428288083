"""Every query against its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from cellweave.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


def plain(x):
    if hasattr(x, "quantize"):
        x = float(x)
    return round(x, 6) + 0.0 if isinstance(x, float) else x


def close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    found = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want, strict=True) if not all(map(close, a, b))] == []


#: What the queries without SQL return on sf0.001: rows, and a column that no two rows share or that is never null.
SHAPES = {
    "b4_marker_table": (80, ["cluster", "gene"]), "b5_polygon_features": (None, ["cell_id"]), "d15_sampled_windows": (None, []),
    "e16_adaptive_expansion": (None, ["row", "col"]), "e20_polygon_fill": (None, ["row", "col"]), "e24_stitched_tiles": (None, ["row", "col"]),
    "h7_seeded_sample": (200, ["event_id"]), "k13_panel_scores": (None, ["cell_id", "panel"]), "k2_grouped_mann_whitney_p": (None, []),
    "k6_randomness_test": (1, []), "l10_resolution_search": (1, []), "l11_kmeans": (500, ["id"]), "l1_dispersion_genes": (200, ["gene_id"]), "l1_regularised_genes": (200, ["gene_id"]),
    "l4_pca_scores": (500, ["id"]), "l9_graph_clusters": (1000, ["resolution", "id"]), "n3_ensemble_merge": (None, ["tile", "row", "col"]),
    "n5_density_seeds": (None, ["row", "col"]), "n8_contours": (None, ["cell_id"]),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_agrees_over_partitions(spark, small, name):
    """Queries without SQL: the shape of their result, and the same result however the rows are dealt.  Values are tested with the operators."""
    rows, key = SHAPES[name]
    found = []
    for parts in ("4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found.append([{k: str(plain(v)) if not isinstance(v, float) else round(v, 5) for k, v in r.asDict().items()} for r in QUERIES[name](spark, small).collect()])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] and (rows is None or len(found[0]) == rows)
    assert not key or len({tuple(r[k] for k in key) for r in found[0]}) == len(found[0])
    if name not in ("l4_pca_scores",):  # an axis may come with either sign
        assert sorted(map(repr, found[0])) == sorted(map(repr, found[1]))


def test_gene_filter_takes_all_cells(spark, tmp_path):
    rows = [(c, g, 1.0 + c) for g in range(8) for c in range(8 + g)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.gene_id: (r.n_cells, r.total) for r in QUERIES["d5_gene_filter"](spark, str(tmp_path)).collect()}
    assert got == {g: (8 + g, sum(1.0 + c for c in range(8 + g))) for g in range(4, 8)}


def test_shifted_polygons_round_like_their_sql(spark, tmp_path):
    rows = [(k, cents / 100, "BUILDING") for k, cents in enumerate([*range(-200, 200), *range(98000, 102600, 7)])] + [(5000, None, None), (5001, -0.0, "X")]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = dict(con.execute(ORACLE_SQL["c7_shifted_polygons"]).fetchall())
    assert {r.cell_id: r.ring for r in QUERIES["c7_shifted_polygons"](spark, str(tmp_path)).collect()} == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
