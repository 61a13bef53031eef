"""Designs, sources and sinks: properties, boundary cases and errors."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.imaging.pixels import luma, resized
from assayer.operators import design, montecarlo
import assayer.registry  # noqa: F401  fills the plans
from assayer.plans.designs import paired_intervals, sample_design, separability
from assayer.plans.views import Views
from assayer.sources import tables

SF = "/root/testdata/sf0.001"


def test_design_is_balanced_weighted_and_repeated(spark):
    v = Views(spark, SF)
    rows = sample_design(v).collect()
    drawn, twice = [r for r in rows if not r.is_repeat], [r for r in rows if r.is_repeat]
    cells = {}
    for r in drawn:
        cells.setdefault(r.cell, []).append(r)
    assert len({r.film for r in drawn}) == len(drawn) and max(map(len, cells.values())) - min(map(len, cells.values())) <= 1
    assert sum(r.weight for r in drawn) == pytest.approx(v.predictions.count())
    assert len(twice) == round(0.1 * len(drawn)) and all(r.weight == 0 and r.case_id.endswith("R") and r.case_id[:-1] in {x.case_id for x in drawn} for r in twice)
    assert sorted(r.display_order for r in rows) == list(range(1, len(rows) + 1))
    assert {c for c in cells if c.startswith("mA")} and sorted(map(tuple, rows)) == sorted(map(tuple, sample_design(v).collect()))


def test_missing_rating_is_an_error(spark):
    key = spark.range(3).select(F.col("id").alias("case_id"))
    ratings = spark.createDataFrame([(0, 1), (1, 5)], "case_id long, score int")
    assert [r.score for r in design.aligned(key.where("case_id < 2"), ratings, "case_id").orderBy("case_id").collect()] == [1, 5]
    with pytest.raises(Exception, match="missing rating of 2"):
        design.aligned(key, ratings, "case_id").collect()


def test_scramble_keeps_severity_and_moves_every_value(spark):
    df = spark.range(50).select(F.col("id").alias("case_id"), F.expr("id % 3 * 0.5D").alias("severity"), F.col("id").cast("double").alias("x"))
    rows = design.scrambled(df, "case_id", "x", "severity", 1).collect()
    assert len(rows) == 50 and all(r.scrambled % 3 * 0.5 == r.severity and r.scrambled != r.x for r in rows)
    assert sorted(r.scrambled for r in rows) == sorted(r.x for r in rows)
    assert design.scrambled(df.limit(1), "case_id", "x", "severity", 1).first().scrambled == df.first().x


def test_maps_methods_and_families(spark):
    df = spark.createDataFrame([(0.1, "a"), (0.3, "a"), (0.2, "b")], "u double, g string")
    out = {r.u: r.confidence for r in design.frozen_confidence(df, df.withColumn("u", F.col("u") + 0.1), "u", "g").collect()}
    assert sorted(out.values()) == pytest.approx([0.0, 0.5, 0.5]) and max(out) == pytest.approx(0.4)
    with pytest.raises(ValueError, match="unknown uncertainty method"):
        design.methods_available(df, ["entropy"])
    with pytest.raises(ValueError, match="no column"):
        design.family(df, "verdict_", "g")
    assert design.records(df, "u").first().record == '{"g":"a"}'


def test_gate_without_usable_conditions_does_not_hold(spark):
    df = spark.createDataFrame([(float("nan"), 1, False, False, True), (-1.0, 1, False, False, True), (1.0, 2, True, False, True)], "ratio double, seed int, degenerate boolean, unphysical boolean, passes boolean")
    r = design.gate_report(df).first()
    assert r.n_conditions == 3 and r.n_usable == 0 and r.median is None and r.holds is False


def test_intervals_and_separability(spark):
    runs = spark.createDataFrame([(a, s, 0.5 + d + 0.01 * s) for a, d in (("base", 0.0), ("better", 0.3), ("same", 0.0)) for s in range(6)] + [("once", 0, 1.0)], "arm string, seed int, score double")
    rows = {r.arm: r for r in design.paired_intervals(runs, "base", 500).collect()}
    assert rows["better"].separates and rows["better"].delta == pytest.approx(0.3) and not rows["same"].separates
    assert rows["once"].low is None and rows["once"].separates is False
    assert paired_intervals(Views(spark, SF)).count() > 0 and separability(Views(spark, SF)).first().folds == 5
    rng = np.random.default_rng(1)
    two = spark.createDataFrame([(i, i % 2, float(rng.normal(3 * (i % 2))), float(rng.normal())) for i in range(400)], "id long, label int, a double, b double")
    assert design.separability(two, ["a", "b"], "label").first()["mean"] > 0.85
    told = montecarlo.source_confound(two, ["a", "b"], "label").first()
    assert told.verdict == "confounded" and told.coefficients[0] > abs(told.coefficients[1])
    assert montecarlo.source_confound(two, ["b"], "label").first().verdict == "clean"


def test_epochs_are_functions_of_seed_epoch_and_id(spark, tmp_path):
    ids = spark.range(20)
    one = sorted(map(tuple, design.epoch_draws(ids, 3, 1).collect()))
    assert one == sorted(map(tuple, design.epoch_draws(ids.repartition(5), 3, 1).collect())) != sorted(map(tuple, design.epoch_draws(ids, 3, 2).collect()))
    spark.createDataFrame([(1,), (2,)], "epoch long").write.parquet(f"{tmp_path}/in")
    q = design.epoch_stream(ids, spark.readStream.schema("epoch long").parquet(f"{tmp_path}/in"), 3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 40 and sorted(map(tuple, got.where("epoch = 1").collect())) == one


def png(pixels):
    """A PNG of grey or colour bytes, one filter byte (none) a row."""
    h, w = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    body = zlib.compress(b"".join(b"\0" + row.tobytes() for row in pixels))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def test_images_are_decoded_grey_and_resized(spark, tmp_path):
    rng = np.random.default_rng(5)
    grey, colour = rng.integers(0, 256, (12, 20), np.uint8), rng.integers(0, 256, (16, 16, 3), np.uint8)
    (tmp_path / "grey.png").write_bytes(png(grey))
    (tmp_path / "colour.png").write_bytes(png(colour))
    (tmp_path / "broken.png").write_bytes(b"no image")
    rows = {r.path.rsplit("/", 1)[1]: r for r in tables.read_images(spark, str(tmp_path), 16).collect()}
    assert set(rows) == {"grey.png", "colour.png"} and (rows["grey.png"].height, rows["grey.png"].width) == (12, 20)
    assert np.allclose(np.reshape(rows["colour.png"].px, (16, 16)), colour @ np.array([0.299, 0.587, 0.114]), atol=1e-6)
    assert np.allclose(np.reshape(rows["grey.png"].px, (16, 16)), resized(grey.astype(float), 16))
    assert np.allclose(resized(np.full((7, 5), 9.0), 4), 9.0) and luma(bytes([1, 2, 3, 4]), 2, 2, 1).tolist() == [[1, 2], [3, 4]]


def test_logs_findings_caches_and_sinks(spark, tmp_path):
    (tmp_path / "log.csv").write_text("capture_path,role,phone_model,condition,angle_deg,distance_frac,room_light,focus,notes\na.jpg,Reference,p,c,1.5,0.5,on,ok,\nb.jpg,test,p,c,steep,0.5,on,ok,\n,test,p,c,1,0.5,on,ok,\n")
    good, bad = tables.split_recapture_log(spark, f"{tmp_path}/log.csv")
    assert [(r.capture_path, r.is_reference) for r in good.collect()] == [("a.jpg", True)] and bad.count() == 2
    (tmp_path / "f.yaml").write_text("findings:\n  - {key: n, delta_d: 0.1, size_mm: 5}\n  - {key: m, name: M, delta_d: 0.2, size_mm: 6, note: x}\n")
    assert [(r.key, r.name, r.delta_d_sigma, r.note) for r in tables.read_findings(spark, f"{tmp_path}/f.yaml").orderBy("key").collect()] == [("m", "M", 0.0, "x"), ("n", "n", 0.0, "")]
    (tmp_path / "e.yaml").write_text("[]")
    with pytest.raises(ValueError, match="no findings"):
        tables.read_findings(spark, f"{tmp_path}/e.yaml")
    cache = spark.range(6).select(tables.cache_key(F.concat(F.lit("d/x"), "id", F.lit(".png")), F.col("id") % 2 / 2).alias("key"), (F.col("id") % 2 / 2).alias("severity"), "id")
    tables.write_cache(cache, f"{tmp_path}/cache")
    wanted = spark.createDataFrame([("x1__s050",), ("x2__s000",), ("no",)], "key string")
    assert {r.id for r in tables.read_cache(spark, f"{tmp_path}/cache", wanted).collect()} == {1, 2} and [r.id for r in tables.read_cache(spark, f"{tmp_path}/cache", wanted, 0.5).collect()] == [1]
    sink = tables.PartialSink(spark, f"{tmp_path}/sweep")
    for run in ("a", "b", "a"):
        sink.add(run, spark.range(3))
    assert {r.run for r in sink.done().collect()} == {"a", "b"}
    sink.close()
    assert spark.read.parquet(f"{tmp_path}/sweep").count() == 6
    design.save_json(cache, f"{tmp_path}/json")
    assert sorted(map(tuple, design.load_json(spark, f"{tmp_path}/json", "key string, severity double, id long").collect())) == sorted(map(tuple, cache.collect()))
