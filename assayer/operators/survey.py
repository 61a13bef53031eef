"""Survey statistics: strata and weights, weighted AUC, agreement, paired comparisons, summaries with medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.scalars import ratio, share
from assayer.operators.quantiles import quantiles, summary
from assayer.operators.ranking import group_rank


def quantile_stratum(df: DataFrame, column: str, k: int, name: str) -> DataFrame:
    """How many of the k - 1 inner quantiles lie below the value; -1 for null."""
    edges = quantiles(df, [], {"_edges": (column, [i / k for i in range(1, k)])})
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(column).isNull(), -1).otherwise(F.size(F.filter("_edges", lambda e: e < F.col(column))))).drop("_edges")


def stratum_weights(df: DataFrame, per_cell: int, *by: str) -> DataFrame:
    """Cells with their population, what is drawn of each, and the weight of a drawn row."""
    c = df.groupBy(*by).agg(F.count("*").alias("population"))
    drawn = F.least(F.col("population"), F.lit(per_cell))
    return c.withColumns({"drawn": drawn, "weight": F.col("population") / drawn})


def referral_score(df: DataFrame) -> DataFrame:
    """The negated margin; what was not measured ranks one unit beyond the worst."""
    worst = df.agg(F.min("margin_db").alias("_worst"))
    return df.crossJoin(F.broadcast(worst)).withColumn("referral", -F.coalesce("margin_db", F.col("_worst") - 1)).drop("_worst")


def weighted_auc(df: DataFrame, score: str, weight: str, *by: str) -> DataFrame:
    """The weight of pairs in order, ties half, by sums over distinct scores in order."""
    c = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.when(F.col("label") == 1, F.col(weight)).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("label") == 0, F.col(weight)).otherwise(0.0)).alias("n"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0.0)))
    return c.groupBy(*by).agg(ratio(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def hanley_mcneil(auc: Column, positives: Column, negatives: Column) -> Column:
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    return F.sqrt((auc * (1 - auc) + (positives - 1) * (q1 - auc * auc) + (negatives - 1) * (q2 - auc * auc)) / (positives * negatives))


def agreement(pairs: DataFrame, *by: str) -> DataFrame:
    """Cohen's kappa and Gwet's AC1 of two readers' decisions a and b (0 or 1)."""
    g = pairs.groupBy(*by).agg(F.count("*").alias("n"), share(F.col("a") == F.col("b")).alias("po"), F.avg("a").alias("pa"), F.avg("b").alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    pi = (F.col("pa") + F.col("pb")) / 2
    pg = 2 * pi * (1 - pi)
    return g.select(*by, "n", "po", ratio(F.col("po") - pe, 1 - pe).alias("kappa"), ratio(F.col("po") - pg, 1 - pg).alias("ac1"))


def reader_pairs(ratings: DataFrame, refer_from: int = 4) -> DataFrame:
    r = ratings.select("case_id", "reader", (F.col("score") >= refer_from).cast("int").alias("x"))
    a, b = r.select("case_id", F.col("reader").alias("reader_a"), F.col("x").alias("a")), r.select("case_id", F.col("reader").alias("reader_b"), F.col("x").alias("b"))
    return a.join(b, "case_id").where("reader_a < reader_b")


def icc(ratings: DataFrame) -> DataFrame:
    """ICC(2,1), from sums of squares by case and reader."""
    total = ratings.agg(F.countDistinct("case_id").alias("n"), F.countDistinct("reader").alias("k"), F.avg("score").alias("m"), F.sum(F.col("score") * F.col("score")).alias("ss"))
    rows = ratings.groupBy("case_id").agg(F.avg("score").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("rr"))
    cols = ratings.groupBy("reader").agg(F.avg("score").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("cc"))
    d = total.crossJoin(rows).crossJoin(cols)
    n, k, m = F.col("n"), F.col("k"), F.col("m")
    sr, sc = k * (F.col("rr") - n * m * m), n * (F.col("cc") - k * m * m)
    se = F.col("ss") - n * k * m * m - sr - sc
    d = d.select("n", "k", (sr / (n - 1)).alias("msr"), (sc / (k - 1)).alias("msc"), (se / ((n - 1) * (k - 1))).alias("mse"))
    value = ratio(F.col("msr") - F.col("mse"), F.col("msr") + (k - 1) * F.col("mse") + k * (F.col("msc") - F.col("mse")) / n)
    return d.select("n", "k", value.alias("icc")).withColumn("averaged", F.when(F.col("icc") > 0, F.col("k") * F.col("icc") / (1 + (F.col("k") - 1) * F.col("icc"))))


def majority(ratings: DataFrame, refer_from: int = 4) -> DataFrame:
    return ratings.groupBy("case_id").agg(F.avg((F.col("score") >= refer_from).cast("double")).alias("share")).select("case_id", (F.col("share") > 0.5).alias("refer"))


def paired_summary(runs: DataFrame, reference: str) -> DataFrame:
    """Each arm's mean and spread, and its mean difference from the reference over shared seeds."""
    ref = runs.where(F.col("arm") == reference).select("seed", F.col("score").alias("ref"))
    j = runs.join(ref, "seed", "left")
    return j.groupBy("arm").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.avg(F.col("score") - F.col("ref")).alias("delta"), F.count("ref").alias("shared"))


def median_and_spread(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Median and median absolute deviation, in two passes."""
    m = summary(df, list(by), {"median": (column, 0.5)}, F.count(column).alias("n"))
    d = df.join(m, list(by))
    return quantiles(d, [*by, "median", "n"], {"mad": (F.abs(F.col(column) - F.col("median")), 0.5)})


def falsification_gate(df: DataFrame, value: str, *by: str, most_spread: float = 2.0) -> DataFrame:
    """Medians by group, their largest over smallest, and whether that passes."""
    m = quantiles(df.where(F.col(value) > 0), list(by), {"m": (value, 0.5)})
    return m.agg(F.count("*").alias("groups"), F.min("m").alias("least"), F.max("m").alias("most"), (F.max("m") / F.min("m")).alias("spread"), (F.max("m") / F.min("m") <= most_spread).alias("passes"))


def latency(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Mean, median, the element at 95 % of the sorted values (counted from their number, cut down, less one), extremes."""
    d = group_rank(df.where(F.col(column).isNotNull()), list(by), column, None, "rn", "n")
    p95 = F.max(F.when(F.col("rn") == F.greatest(F.floor(F.col("n") * 0.95), F.lit(1)), F.col(column))).alias("p95")
    return summary(d, list(by), {"median": (column, 0.5)}, F.avg(column).alias("mean"), p95, F.min(column).alias("least"), F.max(column).alias("most"))


def discordance(df: DataFrame, share_flagged: float = 0.2) -> DataFrame:
    """Two signals cut at the same quantile: the shares of the four quadrants, among measured rows."""
    d = df.where("margin_db is not null")
    cut = quantiles(d, [], {"a": ("margin_db", share_flagged), "b": ("mc_std", 1 - share_flagged)})
    low, unsure = F.col("margin_db") <= F.col("a"), F.col("mc_std") >= F.col("b")
    return d.crossJoin(F.broadcast(cut)).agg(share(low & unsure).alias("both"), share(low & ~unsure).alias("physics_only"), share(~low & unsure).alias("learned_only"), share(~low & ~unsure).alias("neither"))
