"""Readers of tables and files with declared schemas."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = "path string, clinic string, label int, split string, degradation_severity double, uncertainty_target double"
RECAPTURE_SCHEMA = "capture_path string, role string, phone_model string, condition string, angle_deg double, distance_frac double, room_light string, focus string, notes string"
RATING_SCHEMA = "display_order int, case_id string, refer_1_to_5 int, adequacy string, reason_code string, note string"
FINDING_SCHEMA = "key string, name string, delta_d double, delta_d_sigma double, size_mm double, size_sigma_mm double, note string, source string"


def importable(spark: SparkSession) -> None:
    """Python workers started from now on look for this package where the driver found it, if it is there for them."""
    paths, root = spark.sparkContext.environment.get("PYTHONPATH", ""), str(Path(__file__).resolve().parents[2])
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}".rstrip(":")


_own_folder: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a temporary one only where that is unset. It goes at exit."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="assayer-"))
            atexit.register(shutil.rmtree, _own_folder[0].removeprefix("file://"), True)
        folder = _own_folder[0]
    path = f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    atexit.register(_gone, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _gone(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session may have ended before the interpreter
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df written under the shared folder and read again: later plans start there, on any executor, also after losses."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).csv(path, header=True)


def read_recapture_log(spark: SparkSession, path: str) -> DataFrame:
    """With is_reference: roles that begin with `ref` in any case."""
    return spark.read.schema(RECAPTURE_SCHEMA).csv(path, header=True).withColumn("is_reference", F.lower("role").like("ref%"))


def split_recapture_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The log's readable rows, and the lines that don't fit the schema: they are collected, not fatal."""
    fields = [x.split() for x in RECAPTURE_SCHEMA.split(", ")]
    rows = spark.read.schema(", ".join(f"{n} string" for n, _ in fields)).csv(path, header=True)
    bad = F.col("capture_path").isNull()
    for name, kind in fields:
        if kind != "string":
            bad = bad | (F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull())
    good = rows.where(~bad).select(*(F.col(n).try_cast(k).alias(n) for n, k in fields)).withColumn("is_reference", F.lower("role").like("ref%"))
    return good, rows.where(bad).select(F.concat_ws(",", *(F.coalesce(n, F.lit("")) for n, _ in fields)).alias("line"))


def read_ratings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One sheet a reader; the file's name is the reader."""
    return spark.read.schema(RATING_SCHEMA).csv(paths, header=True).withColumn("reader", F.regexp_extract(F.input_file_name(), r"([^/]*)\.csv$", 1))


def _yaml_findings(spark: SparkSession, path: str) -> DataFrame:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("findings in YAML need the yaml module") from e
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    found = yaml.safe_load(text) or []
    found = found.get("findings", []) if isinstance(found, dict) else found
    names = [x.split()[0] for x in FINDING_SCHEMA.split(", ")]
    numbers = {x.split()[0] for x in FINDING_SCHEMA.split(", ") if x.endswith("double")}
    rows = [tuple(None if row.get(n) is None else float(row[n]) if n in numbers else str(row[n]) for n in names) for row in found]
    return spark.createDataFrame(rows, FINDING_SCHEMA)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """CSV, or YAML by its suffix (a list of mappings); optional columns get their defaults; an empty file is an error."""
    if path.endswith((".yaml", ".yml")):
        df = _yaml_findings(spark, path)
    else:
        df = spark.read.schema(FINDING_SCHEMA).csv(path, header=True)
    if df.isEmpty():
        raise ValueError(f"no findings in {path}")
    return df.withColumns({"delta_d_sigma": F.coalesce("delta_d_sigma", F.lit(0.0)), "size_sigma_mm": F.coalesce("size_sigma_mm", F.lit(0.0)), "note": F.coalesce("note", F.lit("")), "source": F.coalesce("source", F.lit("")), "name": F.coalesce("name", "key")})


def label_of_path(path: Column, labels: dict[str, int]) -> Column:
    """The label of the first part of a path that names one, else -1."""
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    named = F.filter(F.split(F.lower(path), "/"), lambda part: F.map_contains_key(table, part))
    return F.coalesce(F.try_element_at(table, F.try_element_at(named, F.lit(1))), F.lit(-1))


def scan_directory(spark: SparkSession, root: str, labels: dict[str, int]) -> DataFrame:
    """(path, label) of the images under root, in order; the files' contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return files.where(F.lower("path").rlike(r"\.(png|jpg|jpeg|bmp)$")).withColumn("label", label_of_path(F.col("path"), labels)).orderBy("path")


def remaining(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Jobs whose key is not done: resume after an interruption."""
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def write_report(df: DataFrame, path: str) -> None:
    """CSV with nested columns as JSON text."""
    nested = {f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() in ("struct", "map", "array")}
    df.withColumns(nested).write.mode("overwrite").csv(path, header=True)


def write_cache(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("severity").parquet(path)


def cache_key(path: Column, severity: Column) -> Column:
    """The file's stem and the severity in hundredths: stem__s050."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat(stem, F.lit("__s"), F.lpad(F.bround(severity * 100).cast("int").cast("string"), 3, "0"))


def read_cache(spark: SparkSession, path: str, keys: DataFrame, severity: float | None = None) -> DataFrame:
    """The cache's rows of the keys, of one severity's folder only where one is given."""
    cache = spark.read.parquet(path)
    return (cache if severity is None else cache.where(F.col("severity") == severity)).join(keys.select("key").distinct(), "key", "left_semi")


class PartialSink:
    """Rows flushed after each run beside the final place, which is written once, from all runs, at the end."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.partial = spark, path, f"{path.rstrip('/')}.partial"

    def add(self, run: str, df: DataFrame) -> None:
        """A run that is repeated takes the place of its former rows."""
        df.write.mode("overwrite").parquet(f"{self.partial}/run={run}")

    def done(self) -> DataFrame:
        """Runs that are there, for a resumed sweep."""
        return self.spark.read.parquet(self.partial).select(F.col("run").cast("string").alias("run")).distinct()

    def close(self) -> None:
        self.spark.read.parquet(self.partial).write.mode("overwrite").parquet(self.path)


def read_images(spark: SparkSession, paths: str | list[str], size: int) -> DataFrame:
    """(path, height, width, px): images as size x size grey values of 0 to 255; what can't be decoded is left out.

    The JVM decodes (PNG, JPEG, BMP, GIF); a worker turns one image after the other to grey and resizes it.
    """
    importable(spark)
    rows = spark.read.format("image").option("dropInvalid", True).load(paths).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return rows.mapInPandas(_grey(size), "path string, height int, width int, px array<double>")


def _grey(size: int):
    def grey(batches):
        import pandas as pd

        from assayer.imaging.pixels import luma, resized

        for pdf in batches:
            px = [resized(luma(data, h, w, c), size).ravel() for data, h, w, c in zip(pdf["data"], pdf["height"], pdf["width"], pdf["nChannels"])]
            yield pd.DataFrame({"path": pdf["origin"], "height": pdf["height"], "width": pdf["width"], "px": px})

    return grey
