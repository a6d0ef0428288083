from __future__ import annotations

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import export as E
from cellweave.sources import tables as S
from cellweave.streaming import ingest


def test_positions_and_boundaries(spark, tmp_path):
    spark.createDataFrame([("a", 1, 1.0, 2.0), ("b", 0, 3.0, 4.0)], S.POSITIONS).write.parquet(f"{tmp_path}/p")
    p = S.positions(spark, f"{tmp_path}/p")
    assert [r.barcode for r in p.collect()] == ["a"]
    counts = spark.createDataFrame([("a", "g", 2.0), ("c", "g", 1.0)], "barcode string, gene string, value double")
    assert [(r.x, r.y) for r in S.with_positions(counts, p).collect()] == [(2.0, 1.0)]
    spark.createDataFrame([("c1", 0.0, 0.0), ("c1", 9.0, 9.0), ("c2", 9.0, 9.0)], S.BOUNDARIES).write.parquet(f"{tmp_path}/b")
    assert S.boundaries_in(spark, f"{tmp_path}/b", (-1, -1, 1, 1)).count() == 2


def test_matrix_market_npy_and_geojson(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% x\n3 3 2\n1 2 5\n3 1 1.5\n")
    assert sorted(tuple(r) for r in S.matrix_market(spark, f"{tmp_path}/m.mtx").collect()) == [(1, 2, 5.0), (3, 1, 1.5)]
    a = np.zeros((4, 5), np.int32)
    a[1, 2] = 7
    np.save(tmp_path / "a.npy", a)
    assert [tuple(r)[1:] for r in S.npy_raster(spark, f"{tmp_path}/a.npy").collect()] == [(1, 2, 7)]
    feature = {"type": "Feature", "id": "cell_3", "geometry": {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]]}, "properties": {}}
    with gzip.open(tmp_path / "f.json.gz", "wt") as f:
        json.dump({"type": "FeatureCollection", "features": [feature]}, f)
    r = S.geojson(spark, f"{tmp_path}/f.json.gz").first()
    assert r.cell_id == 3 and len(r.ring) == 4


def test_log_discovery_config(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"score": 0.4, "approach": "a"}\n{broken\n{"score": 0.2}\n')
    assert S.experiments(spark, f"{tmp_path}/log.jsonl").count() == 2
    root = tmp_path / "root" / "x"
    root.mkdir(parents=True)
    (root / "big.tif").write_bytes(b"0" * 50)
    (root / "small.btf").write_bytes(b"0" * 5)
    assert S.discover(spark, str(tmp_path / "root")).where("kind = 'image'").first().path.endswith("small.btf")
    (tmp_path / "profiles").mkdir()
    (tmp_path / "profiles" / "crc.json").write_text('{"qc": {"a": 1, "b": 2}}')
    (tmp_path / "project.json").write_text('{"qc": {"b": 3}}')
    assert S.load_config(str(tmp_path), "crc", {"x": None, "y": 5}) == {"qc": {"a": 1, "b": 3}, "y": 5}
    with pytest.raises(ValueError):
        S.load_config(str(tmp_path), "../etc")
    assert S.first_existing(spark, [f"{tmp_path}/none", f"{tmp_path}/project.json"]).endswith("project.json")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r", 1), ("s", 2)], "roi string, n int")
    assert E.write_table(df, f"{tmp_path}/t", ["roi"]).count() == 2
    assert E.write_table(df.limit(1), f"{tmp_path}/t", ["roi"], if_exists="reuse").count() == 2
    E.write_csv(df, f"{tmp_path}/c")
    E.append_json_lines(df, f"{tmp_path}/j")
    E.append_json_lines(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 4
    v = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 0), (0, 2)])], "cell_id long, ord int, x double, y double")
    f = json.loads(E.polygon_features(v, 0.5).first().feature)
    assert f["geometry"]["coordinates"] == [[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]]


def test_stream_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    (tmp_path / "in").mkdir()
    events.coalesce(1).sortWithinPartitions("ts").write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream = ingest.windowed(ingest.read_folder(spark, f"{tmp_path}/in", events.schema), "1 day")
    q = ingest.write_folder(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    assert ingest.progress(q)["status"] == "stopped"
    got = {(r.event_type, r.start): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.event_type, r.window.start): r.n for r in ingest.windowed(events, "1 day").collect()}
    last = max(t for _, t in want)
    assert got and all(want[k] == n for k, n in got.items()) and set(want) - set(got) <= {k for k in want if k[1] >= last}
    assert events.where(F.col("ts").isNull()).count() == 0


def test_stage_report(spark, tmp_path):
    for name in ("roi/b/he_crop.tif", "roi/a/he_crop.tif", "roi/a/cellpose_cells.h5ad", "qc_preprocessed.h5ad", "roi/.hidden/segmentation_masks.npy"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {r.stage: (r.done, r.regions) for r in S.stage_report(spark, str(tmp_path)).collect()}
    assert got == {"roi": (True, ["a", "b"]), "segmentation": (False, []), "count": (True, ["a"]), "proseg_rna": (False, []), "analysis": (True, [])}
