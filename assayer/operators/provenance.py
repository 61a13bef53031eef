"""Manifests and splits: where rows come from, and which rows train, tune and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalars import clip
from assayer.operators.ranking import shuffled_rank

# The known clinics by number; anything else gets the number after the last.
CLINICS = {"montgomery": 0, "shenzhen": 1, "niaid": 2, "rsna": 3, "belarus": 4}
UNKNOWN = 5
# Fixed values: (clinic, how its files' names begin, what its paths hold), in the order in which they are tried.
SOURCES = (("montgomery", "mcucxr", ("montgomery",)), ("shenzhen", "chncxr", ("shenzhen", "china")), ("niaid", None, ("niaid", "tbportal")), ("rsna", None, ("rsna",)), ("belarus", None, ("belarus",)))


def clinic_index(clinic: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in CLINICS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(clinic))), F.lit(UNKNOWN))


def uncertainty_target(severity: Column) -> Column:
    return clip(0.05 + 0.95 * severity, 0.0, 1.0)


def clinic_of_path(path: Column) -> Column:
    """The first source whose mark begins the file's name or lies in the path, in any case."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    out = F
    for clinic, start, parts in SOURCES:
        marks = [low.contains(x) for x in parts] + ([name.startswith(start)] if start else [])
        fits = marks[0]
        for m in marks[1:]:
            fits = fits | m
        out = out.when(fits, clinic)
    return out.otherwise("unknown")


def label_of_name(path: Column, label: Column) -> Column:
    """The suffix _1 or _0 of the file's stem, only where there is no label yet."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.when(label < 0, F.when(stem.endswith("_1"), 1).when(stem.endswith("_0"), 0).otherwise(label)).otherwise(label)


def build_manifest(df: DataFrame) -> DataFrame:
    """The six columns, missing ones with their defaults."""
    have = set(df.columns)
    split = F.coalesce("split", F.lit("unassigned")) if "split" in have else F.lit("unassigned")
    severity = F.coalesce("degradation_severity", F.lit(0.0)) if "degradation_severity" in have else F.lit(0.0)
    target = F.coalesce("uncertainty_target", uncertainty_target(severity)) if "uncertainty_target" in have else uncertainty_target(severity)
    return df.select("path", "clinic", "label", split.alias("split"), severity.alias("degradation_severity"), target.alias("uncertainty_target"))


def class_balance(m: DataFrame) -> DataFrame:
    """Counts by clinic; the total leaves unlabelled rows out."""
    c = m.groupBy("clinic").agg(F.count_if(F.col("label") == 0).alias("normal"), F.count_if(F.col("label") == 1).alias("positive"))
    total = F.col("normal") + F.col("positive")
    return c.withColumns({"total": total, "positive_share": F.floor(F.col("positive") / F.greatest(total, F.lit(1)) * 1000 + 0.5) / 1000})


def _size(n: Column, fraction: float) -> Column:
    """n * fraction, halves to even."""
    return F.bround(n * F.lit(fraction)).cast("int")


def split_leave_one_out(m: DataFrame, holdout: str, val_fraction: float = 0.2, seed: int = 7) -> DataFrame:
    """The holdout's rows test; of the others each (clinic, label) gives a fraction to val. Unlabelled rows go."""
    d = shuffled_rank(m.where("label >= 0"), ["clinic", "label"], seed, "path", "_r", "_n")
    return d.withColumn("split", F.when(F.col("clinic") == holdout, "test").when(F.col("_r") <= _size(F.col("_n"), val_fraction), "val").otherwise("train")).drop("_r", "_n")


def split_random(m: DataFrame, val_fraction: float = 0.2, test_fraction: float = 0.2, seed: int = 7) -> DataFrame:
    if not (0 < val_fraction < 1 and 0 < test_fraction < 1 and val_fraction + test_fraction < 1):
        raise ValueError("fractions must lie between 0 and 1, and so must their sum")
    d, n, r = shuffled_rank(m.where("label >= 0"), ["label"], seed, "path", "_r", "_n"), F.col("_n"), F.col("_r")
    return d.withColumn("split", F.when(r <= _size(n, test_fraction), "test").when(r <= _size(n, test_fraction) + _size(n, val_fraction), "val").otherwise("train")).drop("_r", "_n")


def split_summary(m: DataFrame) -> DataFrame:
    return m.groupBy("split").agg(F.count_if(F.col("label") == 0).alias("normal"), F.count_if(F.col("label") == 1).alias("positive"), F.count("*").alias("total"))


def two_class_groups(m: DataFrame) -> DataFrame:
    return m.where("label >= 0").groupBy("clinic").agg(F.countDistinct("label").alias("labels"), F.count("*").alias("n")).where("labels >= 2").select("clinic", "n")


def check_fold(m: DataFrame, holdout: str) -> None:
    """Raises for an unknown fold, and for one of a single class."""
    row = m.where((F.col("clinic") == holdout) & (F.col("label") >= 0)).agg(F.countDistinct("label")).first()
    if m.where(F.col("clinic") == holdout).isEmpty():
        raise ValueError(f"unknown holdout {holdout}")
    if row[0] < 2:
        raise ValueError(f"holdout {holdout} has only class rows of {row[0]} label")


def split(m: DataFrame, mode: str, **options) -> DataFrame:
    if mode == "loco":
        check_fold(m, options["holdout"])
        return split_leave_one_out(m, **options)
    if mode == "random":
        return split_random(m, **options)
    raise ValueError(f"unknown split mode {mode}")


def stratified_sample(m: DataFrame, fraction: float, *by: str, seed: int = 3) -> DataFrame:
    return shuffled_rank(m, list(by), seed, "path", "_r", "_n").where(F.col("_r") <= _size(F.col("_n"), fraction)).drop("_n", "_r")
