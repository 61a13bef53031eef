"""Read-outs, sheets and settings."""

import math

import pytest
from pyspark.sql import functions as F

from assayer import config
from assayer.operators import study
from assayer.sources.catalogue import candidate_folds


def test_config(tmp_path):
    (tmp_path / "default.yaml").write_text("a: {b: 1, c: 2}\nd: x\n")
    (tmp_path / "one.yaml").write_text("a: {c: 3}\n")
    got = config.load_experiment("one.yaml", tmp_path, ["a.b=0.5", "e.f=[1, 2]", "d=plain text"])
    assert got == {"a": {"b": 0.5, "c": 3}, "d": "plain text", "e": {"f": [1, 2]}}
    assert config.load(tmp_path / "default.yaml") == {"a": {"b": 1, "c": 2}, "d": "x"}
    with pytest.raises(ValueError):
        config.load(tmp_path / "default.yaml", overrides=["nothing"])
    with pytest.raises(FileNotFoundError):
        config.load_experiment("none.yaml", tmp_path)


def test_sheet_is_blind(spark):
    design = spark.createDataFrame([(1, 7, 0.5, 1, "x")], "display_order int, case_id long, margin_db double, label int, clinic string")
    assert tuple(study.rating_sheet(design).columns) == study.SHEET
    with pytest.raises(ValueError, match="case_id"):
        study.rating_sheet(design.drop("case_id"))


def test_expressions(spark):
    row = spark.range(1).select(
        study.join_key(F.lit("a/b__c__d.png")).alias("key"), study.loss_weight(F.lit(None).cast("double"), "margin").alias("unmeasured"), study.loss_weight(F.lit(12.0), "margin").alias("best"),
        study.loss_weight(F.lit(12.0), "inverse").alias("inverse"), study.spearman_brown(F.lit(0.5), 3).alias("sb"), study.spearman_brown(F.lit(-0.1), 3).alias("none"),
    ).first()
    assert row["key"] == "d.png" and row["unmeasured"] == 0.25 and row["best"] == 1.0 and row["inverse"] == 0.25 and row["sb"] == 0.75 and row["none"] is None
    with pytest.raises(ValueError):
        study.loss_weight(F.lit(1.0), "nope")


def test_least_detectable_auc_falls_with_size():
    a, b = study.least_detectable_auc(20, 20), study.least_detectable_auc(200, 200)
    assert 0.5 < b < a < 1


def test_weighted_agreement_rare_event(spark):
    rows = [(True, False, 1.0), (False, True, 1.0)] + [(False, False, 1.0)] * 98
    got = study.weighted_agreement(spark.createDataFrame(rows, "a boolean, b boolean, w double"), "a", "b", "w").first()
    assert got["agreement"] == 0.98 and got["kappa"] < 0.8 and got["ac1"] > 0.95 and got["caught"] == 0 and got["missed"] == 1
    none = study.weighted_agreement(spark.createDataFrame([], "a boolean, b boolean, w double"), "a", "b", "w").first()
    assert none["agreement"] is None and none["kappa"] is None


def test_gates_fail_without_values(spark):
    schema = "wedge_rmse double, sigma double, edge_sigma double, spread double, violations double, discs_n double"
    assert [r["passes"] for r in study.recapture_gates(spark.createDataFrame([], schema)).collect()] == [False] * 4
    good = spark.createDataFrame([(0.01, 1.0, 1.1, 0.01, 0.0, 30.0)], schema)
    assert all(r["passes"] for r in study.recapture_gates(good).collect())


def test_arms(spark):
    rows = [("base", 4.0), ("base", 4.0), ("x", 3.0), ("best", 2.0), ("best", math.nan)]
    s = study.arm_summary(spark.createDataFrame(rows, "arm string, m double"), ["m"], "arm")
    got = study.against(s, ["m"], "base", "best").collect()
    assert [(r["arm"], r["d_m"], r["closed_m"]) for r in got] == [("x", -1.0, 0.5)]


def test_archives(spark):
    rows = candidate_folds(spark).collect()
    assert [r["key"] for r in rows] == ["nitrd_da", "nitrd_db", "tbx11k", "vindr_cxr", "padchest"] and rows[2]["unverified"] == ["institution"]
