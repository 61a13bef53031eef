"""DICOM files written here and read by Spark; metrics that merge, table functions, models."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import hooks
from assayer.sources import dicom


def element(tag, kind, value):
    value += b"\0" * (len(value) % 2)
    head = struct.pack("<HH", *tag) + kind
    return head + (b"\0\0" + struct.pack("<I", len(value)) if kind in dicom.LONG else struct.pack("<H", len(value))) + value


def sequence(tag, undefined=True):
    """A sequence of two items, one of unknown length, that hold elements and a sequence of their own."""
    inner = element((8, 0x60), b"CS", b"XX")
    item = struct.pack("<HHI", *dicom.ITEM, dicom.UNDEFINED) + inner + struct.pack("<HH", 8, 0x1140) + b"SQ\0\0" + struct.pack("<I", dicom.UNDEFINED)
    item += struct.pack("<HHI", *dicom.ITEM, len(inner)) + inner + struct.pack("<HHI", *dicom.SEQUENCE_END, 0) + struct.pack("<HHI", *dicom.ITEM_END, 0)
    item += struct.pack("<HHI", *dicom.ITEM, len(inner)) + inner
    if not undefined:
        return element(tag, b"SQ", item)
    return struct.pack("<HH", *tag) + b"SQ\0\0" + struct.pack("<I", dicom.UNDEFINED) + item + struct.pack("<HHI", *dicom.SEQUENCE_END, 0)


def written(px, photometric=b"MONOCHROME2", syntax=b"1.2.840.10008.1.2.1", more=b"", signed=0, samples=1):
    us = lambda tag, n: element(tag, b"US", struct.pack("<H", n))
    bits = px.dtype.itemsize * 8
    body = element(dicom.SYNTAX, b"UI", syntax) + element(dicom.MODALITY, b"CS", b"DX") + sequence((8, 0x1111)) + sequence((8, 0x1112), False) + us(dicom.SAMPLES, samples) + element(dicom.PHOTOMETRIC, b"CS", photometric)
    body += us(dicom.ROWS, px.shape[0]) + us(dicom.COLUMNS, px.shape[1]) + us(dicom.BITS, bits) + us(dicom.SIGNED, signed) + more + element(dicom.PIXELS, b"OW", px.tobytes())
    return b"\0" * 128 + b"DICM" + body


@pytest.fixture
def source(spark):
    from assayer.sources.tables import importable

    importable(spark)
    spark.dataSource.register(dicom.DicomSource)


def test_files_and_damaged_files_are_rows(spark, source, tmp_path):
    rng = np.random.default_rng(0)
    small, large = rng.integers(0, 255, (5, 7), np.uint8), rng.integers(-900, 900, (3, 4), np.int16)
    scale = element(dicom.INTERCEPT, b"DS", b"-10") + element(dicom.SLOPE, b"DS", b"2.5 ")
    files = {
        "a.dcm": written(small), "sub/b.DCM": written(large, signed=1, more=scale), "c.dcm": written(small, b"MONOCHROME1"), "d.dicom": written(small.astype("<u2")),
        "cut.dcm": written(small)[:-9], "gone.dcm": written(small)[:150], "none.dcm": b"", "text.dcm": b"no image at all" * 40,
        "jpeg.dcm": written(small, syntax=b"1.2.840.10008.1.2.4.50"), "colour.dcm": written(small, samples=3), "short.dcm": written(small).replace(struct.pack("<H", 7), struct.pack("<H", 70), 1), "other.txt": b"x",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    df = spark.read.format("dicom").load(f"file://{tmp_path}")
    assert df.schema.simpleString() == spark.createDataFrame([], dicom.SCHEMA).schema.simpleString()
    rows = {r.path.split("/")[-1]: r for r in df.collect()}
    assert set(rows) == {n.split("/")[-1] for n in files} - {"other.txt"}
    good = {n: r for n, r in rows.items() if r.error is None}
    assert set(good) == {"a.dcm", "b.DCM", "c.dcm", "d.dicom"}
    assert good["a.dcm"].px == small.ravel().tolist() and (good["a.dcm"].height, good["a.dcm"].width, good["a.dcm"].bits, good["a.dcm"].modality) == (5, 7, 8, "DX")
    assert good["b.DCM"].px == (large.ravel() * 2.5 - 10).tolist()
    assert good["c.dcm"].px == (int(small.max()) + int(small.min()) - small.astype(float)).ravel().tolist()
    assert "transfer syntax" in rows["jpeg.dcm"].error and all(rows[n].px is None for n in rows if n not in good)
    assert spark.read.format("dicom").load(f"{tmp_path}/a.dcm").count() == 1
    assert spark.read.format("dicom").option("suffixes", ".none").load(f"file://{tmp_path}").count() == 0


def test_a_user_metric_merges_as_one_pass_does(spark, monkeypatch):
    """Many partitions, a null group, more groups than a task keeps, rows without a label; the largest error as a metric of one's own."""
    monkeypatch.setattr(hooks, "FAN", 2)
    monkeypatch.setattr(hooks, "GROUPS", 3)
    worst = hooks.Metric(lambda: np.array([-1.0]), lambda s, y, p: np.maximum(s, np.abs(y - p).max()), np.maximum, lambda s: float(s[0]))
    rng = np.random.default_rng(1)
    rows = [(None if i % 7 == 0 else f"g{i % 11}", None if i % 50 == 3 else int(rng.random() < 0.4), float(rng.random())) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, label int, prob double").repartition(13)
    got = {r.g: (r.worst, r.loss) for r in hooks.grouped_metrics(df, {"worst": worst, "loss": hooks.LOG_LOSS}, "g").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        y, p = (np.array(x) for x in zip(*((r[1], r[2]) for r in rows if r[0] == g and r[1] is not None)))
        want[g] = (pytest.approx(np.abs(y - p).max()), pytest.approx(-np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))))
    assert got == want
    assert hooks.grouped_metrics(df.limit(0), {"loss": hooks.LOG_LOSS}, "g").collect() == []


def test_table_functions_from_sql(spark):
    hooks.register_tables(spark)
    rows = spark.sql("select * from capacity_table(0D, 12D, 6D)").collect()
    assert [r.bits for r in rows] == pytest.approx([0.5 * np.log2(1 + 10 ** (db / 10)) for db in (0, 6, 12)])
    with pytest.raises(Exception, match="risk_coverage takes"):
        spark.sql("select * from risk_coverage(TABLE(select 1 as x))").collect()


def test_models_keep_the_contract(spark, tmp_path):
    np.savez(tmp_path / "m.npz", weights=np.arange(5.0), bias=1.0)
    df = spark.createDataFrame([(1, [1.0, 0.0, 2.0, 0.0, 1.0]), (2, None), (3, [0.0] * 5)], "id int, x array<double>")
    got = {r.id: r for r in hooks.scored(df, f"file://{tmp_path}/m.npz", hooks.linear_model, "x", 4).collect()}
    assert got[1].logit == 9 and got[1].features == [1, 0, 2, 0] and got[1].uncertainty == 0.1
    assert got[2].logit is None and got[2].features is None and got[2].uncertainty is None and got[3].logit == 1
    with pytest.raises(Exception, match="one logit, 3 features"):
        hooks.scored(df, f"file://{tmp_path}/m.npz", hooks.linear_model, "x", 3).collect()
    with pytest.raises(Exception, match="a model gives logit, features and uncertainty, not"):
        hooks.scored(df, f"file://{tmp_path}/m.npz", lambda path: lambda x: {"logit": x[:, 0]}, "x", 4).collect()
