"""A reader study's read-out, the blinded sheet it starts from, and summaries of arms against a baseline."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalars import clip, ratio
from assayer.operators.quantiles import summary

#: Columns of a rating sheet; all else stays in the key.
SHEET = ("display_order", "case_id", "refer_1_to_5", "adequacy", "reason_code", "note")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    return df


def constant_columns(df: DataFrame) -> DataFrame:
    """(column, n_distinct) of the columns with at most one distinct value besides null: they inform no one. One pass."""
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "struct", "array")]
    counts = df.agg(*(F.count_distinct(F.col(n)).alias(n) for n in plain))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("column"), F.col(n).alias("n_distinct")) for n in plain)))).where("n_distinct <= 1")


def rating_sheet(design: DataFrame) -> DataFrame:
    """What readers see: order and case, empty answers, nothing of the model's or the truth."""
    empty = {"refer_1_to_5": F.lit(None).cast("int"), "adequacy": F.lit(""), "reason_code": F.lit(""), "note": F.lit("")}
    return require_columns(design, ["display_order", "case_id"]).select("display_order", "case_id").withColumns(empty).select(*SHEET)


def join_key(path: Column) -> Column:
    """The part of a file's name after its last double underscore."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.element_at(F.split(name, "__"), -1)


def loss_weight(margin_db: Column, mode: str) -> Column:
    """A training row's weight of 0.25 to 1: by margin, or against it; an unmeasured margin counts as the worst."""
    w = F.coalesce(clip((margin_db + 12) / 24, 0.0, 1.0), F.lit(0.0))
    if mode not in ("none", "margin", "inverse"):
        raise ValueError(f"unknown weight mode {mode!r}")
    return F.lit(1.0) if mode == "none" else 0.25 + 0.75 * (w if mode == "margin" else 1 - w)


def spearman_brown(r: Column, k: Column | int) -> Column:
    """Reliability of the mean of k readers from that of one; null where one's isn't positive."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(r > 0, k * r / (1 + (k - 1) * r))


def least_detectable_auc(positives: int, negatives: int, power: float = 0.8, alpha: float = 0.05) -> float:
    """The AUC that a study of this size tells from chance with that power, by bisection on Hanley and McNeil's error."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)

    def error(a: float) -> float:
        q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
        return max(0.0, (a * (1 - a) + (positives - 1) * (q1 - a * a) + (negatives - 1) * (q2 - a * a)) / (positives * negatives)) ** 0.5

    low, high = 0.5, 1.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if middle - 0.5 >= z * error(middle) else (middle, high)
    return high


def weighted_agreement(df: DataFrame, a: str, b: str, weight: str, *by: str) -> DataFrame:
    """Of two boolean columns: weighted shares, kappa and AC1, what b's cases a caught and what a flagged beyond them."""
    w, x, y = F.col(weight).cast("double"), F.col(a), F.col(b)
    part = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    g = df.groupBy(*by).agg(F.sum(w).alias("w"), part(x == y).alias("same"), part(x).alias("wa"), part(y).alias("wb"), part(x & y).alias("wab"))
    po, pa, pb = ratio(F.col("same"), F.col("w")), ratio(F.col("wa"), F.col("w")), ratio(F.col("wb"), F.col("w"))
    pe, pi = pa * pb + (1 - pa) * (1 - pb), (pa + pb) / 2
    pg = 2 * pi * (1 - pi)
    return g.select(
        *by, po.alias("agreement"), pa.alias("rate_a"), pb.alias("rate_b"), ratio(po - pe, 1 - pe).alias("kappa"), ratio(po - pg, 1 - pg).alias("ac1"),
        ratio(F.col("wab"), F.col("wb")).alias("caught"), ratio(F.col("wb") - F.col("wab"), F.col("wb")).alias("missed"),
        ratio(F.col("wa") - F.col("wab"), F.col("w") - F.col("wb")).alias("needless"),
    )


def arm_summary(df: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """Per arm the number and each metric's median over its finite values."""
    return summary(df, list(by), {m: (F.when(~F.isnan(m), F.col(m)), 0.5) for m in metrics}, F.count("*").alias("n"))


def against(summary: DataFrame, metrics: list[str], base: str, best: str) -> DataFrame:
    """Each arm's difference from the base, and the share that it closes of the gap between base and best; null for a gap of none."""
    named = lambda arm, tag: F.broadcast(summary.where(F.col("arm") == arm).select(*(F.col(m).alias(f"_{tag}_{m}") for m in metrics)))
    d = summary.where(~F.col("arm").isin(base, best)).crossJoin(named(base, "base")).crossJoin(named(best, "best"))
    gap = lambda m: F.col(f"_base_{m}") - F.col(f"_best_{m}")
    closed = lambda m: F.when(F.abs(gap(m)) > 1e-9, (F.col(f"_base_{m}") - F.col(m)) / gap(m))
    return d.select("arm", *(c for m in metrics for c in ((F.col(m) - F.col(f"_base_{m}")).alias(f"d_{m}"), closed(m).alias(f"closed_{m}"))))


# What photographs of the test sheet must keep within.
GATES = {"tone_rmse_od": 0.05, "blur_ratio": (0.5, 2.0), "reference_spread_od": 0.03, "violation_rate": 0.05}


def recapture_gates(scores: DataFrame) -> DataFrame:
    """(gate, value, passes) over scored photographs (wedge_rmse, sigma, edge_sigma, spread, violations, discs_n); no value fails."""
    m = summary(
        scores, [], {"tone": ("wedge_rmse", 0.5), "blur": (F.col("sigma") / F.nullif("edge_sigma", F.lit(0.0)), 0.5)},
        F.max("spread").alias("spread"), ratio(F.sum("violations"), F.sum("discs_n")).alias("rate"),
    )
    low, high = GATES["blur_ratio"]
    gates = [("tone", F.col("tone"), F.col("tone") <= GATES["tone_rmse_od"]), ("blur", F.col("blur"), F.col("blur").between(low, high)),
             ("spread", F.col("spread"), F.col("spread") <= GATES["reference_spread_od"]), ("violations", F.col("rate"), F.col("rate") <= GATES["violation_rate"])]
    return m.select(F.inline(F.array(*(F.struct(F.lit(n).alias("gate"), v.alias("value"), F.coalesce(p, F.lit(False)).alias("passes")) for n, v, p in gates))))
