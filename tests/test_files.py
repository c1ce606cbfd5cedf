import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuegrid.params import GraphParams, Params
from tissuegrid.pipeline import Inference
from tissuegrid.sources import files
from tissuegrid.sources.delimited import PREDICTION
from tissuegrid.streaming.lines import separate_lines, windowed


def test_params():
    nested = '{"graph_params": {"n_neighbors": 7, "bcq_IQR": [0.1, 0.9]}, "run_params": {"n_iter": 3}}'
    p = Params.from_json(nested)
    assert (p.graph.n_neighbors, p.graph.bcq_IQR, p.run.n_iter, p.run.write_freq) == (7, (0.1, 0.9), 3, 10)
    assert Params.from_json('{"n_iter": 3, "conn_key": "a"}').run.conn_key == "a" and Params.from_json(p.to_json()) == p
    for bad in ('{"is_rawCounts": true}', '{"run_params": {"typo": 1}}'):
        with pytest.raises(ValueError):
            Params.from_json(bad)
    with pytest.raises(AttributeError):
        Params().graph.n_neighbors = 3
    assert GraphParams().snn_threshold == 0.1


def test_csv_and_lists(spark, tmp_path):
    (tmp_path / "f.csv").write_text("label,x,y,mean_gray\n1,2.5,3.5,7\n2,1,1,\n")
    f = files.read_features(spark, str(tmp_path / "f.csv"), ["mean_gray"])
    assert [tuple(r) for r in f.orderBy("label").collect()] == [(1, 2.5, 3.5, 7.0), (2, 1.0, 1.0, None)]
    other = spark.createDataFrame([(1, 9.0, "z")], "label long, x double, kind string")
    assert files.join_external(f, other).columns == ["label", "x_default", "y", "mean_gray", "x_external", "kind"]
    (tmp_path / "genes.txt").write_text("A1\n\nB2 \n")
    assert {r.gene for r in files.read_gene_list(spark, str(tmp_path / "genes.txt")).collect()} == {"A1", "B2"}
    (tmp_path / "n.csv").write_text("ObjectNumber,AreaShape_Center_X,AreaShape_Center_Y,Other\n4,1.5,2.5,x\n")
    assert tuple(files.read_nuclei(spark, str(tmp_path / "n.csv")).first()) == (4, 1.5, 2.5)


def test_wide_tables(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("chrom\tabspos\tc.1\tc.2\n1\t10\t0.5\t-1\n1\t20\t0\tNA\n")
    long = files.read_wide(spark, str(tmp_path / "w.tsv"), 2)
    assert {(r.abspos, r.cell): r.value for r in long.collect()} == {("10", "c.1"): 0.5, ("10", "c.2"): -1.0, ("20", "c.1"): 0.0, ("20", "c.2"): None}
    files.write_wide(long.withColumn("cell", F.translate("cell", ".", "_")), str(tmp_path / "out"), ["chrom", "abspos"], ["c_1", "c_2"])
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).count() == 2


def test_predictions_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("cell.names\tlabel\nx-1\tdiploid\nshort\n")
    got = files.read_predictions(spark, str(tmp_path / "a.txt"))
    assert [(r.cell_id, r.cell_type) for r in got.collect()] == [("x-1", "diploid")]
    files.write_predictions(got, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "p"), sep="\t", header=True).first().cell_type == "diploid"


def test_matrix_market(spark, tmp_path):
    e = spark.createDataFrame([("c2", "g1", 3.0), ("c1", "g2", 1.5), ("c1", "g1", 0.0), ("c3", "g3", 2.0)], "cell string, gene string, value double")
    files.write_matrix_market(e, str(tmp_path / "m"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "m/matrix").glob("part-*"))).splitlines()
    assert text[:2] == ["%%MatrixMarket matrix coordinate real general", "3 3 3"] and set(text[2:]) == {"2 1 1.5", "1 2 3.0", "3 3 2.0"}
    assert {tuple(r) for r in files.read_matrix_market(spark, str(tmp_path / "m/matrix")).collect()} == {(2, 1, 1.5), (1, 2, 3.0), (3, 3, 2.0)}


def test_arrays(spark, tmp_path):
    a = np.zeros((5, 4), np.int32)
    a[1, 2], a[4, 0] = 7, 9
    np.save(tmp_path / "a.npy", a)
    assert {(r.row, r.col, r.value) for r in files.read_arrays(spark, str(tmp_path / "a.npy")).collect()} == {(1, 2, 7.0), (4, 0, 9.0)}
    np.savez(tmp_path / "s.npz", data=np.array([1.0, 0.0, 3.0]), indices=np.array([0, 1, 2]), indptr=np.array([0, 2, 2, 3]), shape=np.array([3, 3]))
    assert {(r.row, r.col, r.value) for r in files.read_arrays(spark, str(tmp_path / "s.npz")).collect()} == {(0, 0, 1.0), (2, 2, 3.0)}


def test_frames(spark, tmp_path):
    frame = spark.createDataFrame([(1, "g", 2.0)], "cell long, gene string, value double")
    files.write_frames({10: frame, 20: frame.withColumn("value", F.lit(3.0))}, str(tmp_path / "frames"))
    assert files.read_frame(spark, str(tmp_path / "frames"), 20).first().value == 3.0


def small_run(spark, **values):
    cells = spark.createDataFrame([(k, float(k % 7), float(k // 7), float(k * 37 % 11), float(k * 17 % 5)) for k in range(42)], "cell long, x double, y double, a double, b double")
    spots = spark.createDataFrame([(s, float(s % 3) * 2.5 + 1, float(s // 3) * 2.5 + 1) for s in range(6)], "spot long, x double, y double")
    expression = spark.createDataFrame([(s, g, float((s + 1) * (k + 1) % 7)) for s in range(6) for k, g in enumerate("pqr")], "spot long, gene string, value double")
    return Inference(cells, spots, expression, ["a", "b"], 5.0, params=Params().changed(**values))


def test_inference(spark):
    run = small_run(spark, n_iter=4, write_freq=2)
    got = run.predict()
    assert set(got) == {2, 4} and got[4].count() == 42 * 3
    assert {r.gene for r in run.predict(["p"])[2].select("gene").distinct().collect()} == {"p"}
    raw = small_run(spark, n_iter=1, write_freq=1, is_rawCount=True, adjust_cell_network_by_transcriptome_scale=1, burn_in_steps=1, smooth_predicted_expression_steps=2).predict()[1]
    assert raw.schema["value"].dataType.simpleString() == "int" and raw.count() == 126
    assert small_run(spark, n_iter=1, write_freq=1, geom_constraint=2.0, inflation_percentage=0.0, regulate_expression_mean=True, balance_cell_quality=True).predict()[1].count() == 126


def test_streams(spark, tmp_path):
    good = "ACGTACGTACGTACGT-1\tdiploid\t0.5\tn"
    spark.createDataFrame([(1, good), (2, "bad")], "line_id long, raw_line string").write.parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema("line_id long, raw_line string").parquet(str(tmp_path / "in"))
    separate_lines(lines, "raw_line", PREDICTION, ["line_id"], str(tmp_path / "ok"), str(tmp_path / "no"), str(tmp_path / "check")).awaitTermination()
    assert [r.line_id for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == [1]
    assert [(r.line_id, r.reason) for r in spark.read.parquet(str(tmp_path / "no")).collect()] == [(2, "columns")]
    spark.createDataFrame([("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 00:00:50", "a", 3.0), ("2024-01-01 02:00:00", "a", 9.0)], "ts string, kind string, v double").selectExpr("cast(ts as timestamp) ts", "kind", "v").write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema("ts timestamp, kind string, v double").parquet(str(tmp_path / "ev"))
    q = windowed(events, "ts", ["kind"], "v", "1 minute", "10 minutes").writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert [(r.n, r.total, r.most) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, 4.0, 3.0)]


def test_matrix_market_keeps_every_entry(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "part-0").write_text("%%MatrixMarket matrix coordinate real general\n% note\n1 1 1\n1 1 1\n")
    assert [tuple(r) for r in files.read_matrix_market(spark, str(tmp_path / "a")).collect()] == [(1, 1, 1.0)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "part-0").write_text("%%MatrixMarket matrix coordinate real general\n3 3 4\n3 3 4\n")
    (tmp_path / "b" / "part-1").write_text("1 2 0.5\n2 1\n\n3  3   4e0\n")
    got = sorted(tuple(r) for r in files.read_matrix_market(spark, str(tmp_path / "b")).collect())
    assert got == [(1, 2, 0.5), (2, 1, 1.0), (3, 3, 4.0), (3, 3, 4.0)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "part-0").write_text("% nothing\n")
    assert files.read_matrix_market(spark, str(tmp_path / "c")).count() == 0


def test_predictions_have_any_header(spark, tmp_path):
    (tmp_path / "one.txt").write_text("cell.names\tcopykat.pred\nA-1\tdiploid\nB-1\n\nC-1\taneuploid\tmore\n")
    (tmp_path / "two.txt").write_text("names\tpred\ncell.names\tdiploid\n\"D\tdiploid\n")
    got = sorted((r.cell_id, r.cell_type) for r in files.read_predictions(spark, str(tmp_path)).collect())
    assert got == [('"D', "diploid"), ("A-1", "diploid"), ("C-1", "aneuploid"), ("cell.names", "diploid")]


def test_parameters_work_or_raise(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "cell long, x double, y double, f double")
    spots = spark.createDataFrame([("a", 0.0, 0.0)], "spot string, x double, y double")
    expression = spark.createDataFrame([("a", "g", 1.0, "raw"), ("a", "g", 2.0, "log")], "spot string, gene string, value double, layer string")
    make = lambda expression, **p: Inference(cells, spots, expression, ["f"], 5.0, params=Params().changed(**p))
    assert [r.value for r in make(expression, layer="log").expression.collect()] == [2.0]
    plain = expression.drop("layer")
    for given, p in ((expression, {}), (plain, {"layer": "log"}), (plain, {"conn_csr_matrix": "x"}), (plain, {"initialize": False}), (plain, {"out_prefix": "z"}), (plain, {"node_features_obs_list": ("q",)})):
        with pytest.raises(ValueError):
            make(given, **p)


def test_cell_lists(spark, tmp_path):
    (tmp_path / "cells.txt").write_text("c1\textra\n\n\tnothing\nc2\nc1\n")
    assert sorted(r.cell for r in files.read_cell_list(spark, str(tmp_path / "cells.txt")).collect()) == ["c1", "c1", "c2"]
