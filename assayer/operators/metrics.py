"""Point metrics, calibration, conformal prediction and forecast verification over predictions (clinic, label, prob, ...).

All take the columns to group by; undefined values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.scalars import edge_bin, ratio, share
from assayer.operators.ranking import average_ranks, group_rank


def linspace(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * i / n for i in range(n + 1)]


def confusion(df: DataFrame, *by: str, threshold: float = 0.5) -> DataFrame:
    said, is_ = F.col("prob") >= threshold, F.col("label") == 1
    return df.groupBy(*by).agg(
        F.count_if(said & is_).alias("tp"), F.count_if(~said & ~is_).alias("tn"), F.count_if(said & ~is_).alias("fp"), F.count_if(~said & is_).alias("fn")
    )


def rates(c: DataFrame) -> DataFrame:
    """sensitivity, specificity and accuracy beside a confusion."""
    return c.withColumns(
        {
            "sensitivity": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "specificity": ratio(F.col("tn"), F.col("tn") + F.col("fp")),
            "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
        }
    )


def roc_auc(df: DataFrame, *by: str, score: str = "prob") -> DataFrame:
    """By ranks of value counts: one row a distinct score is ranked, so that ties and large groups cost little."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = counts.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return below.groupBy(*by).agg(ratio(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)), F.sum("p") * F.sum("n")).alias("auc"))


def brier(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col("prob") - F.col("label")) * (F.col("prob") - F.col("label"))).alias("brier"), F.count("*").alias("n"))


def with_confidence(df: DataFrame) -> DataFrame:
    return df.withColumns({"confidence": F.greatest("prob", 1 - F.col("prob")), "correct": ((F.col("prob") >= 0.5) == (F.col("label") == 1)).cast("double")})


def _found_bins(df: DataFrame, *by: str, bins: int) -> DataFrame:
    d = with_confidence(df).withColumn("bin", edge_bin(F.col("confidence"), linspace(0.5, 1.0, bins)))
    return d.groupBy(*by, "bin").agg(F.avg("confidence").alias("mean_confidence"), F.avg("correct").alias("accuracy"), F.count("*").alias("n"))


def reliability(df: DataFrame, *by: str, bins: int = 15) -> DataFrame:
    """Mean confidence, accuracy and count of each bin of confidence on [0.5, 1]; empty bins have null means and count 0."""
    found = _found_bins(df, *by, bins=bins)
    grid = df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))) if by else df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(found, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(df: DataFrame, *by: str, bins: int = 15) -> DataFrame:
    """From the bins that hold cases; groups may have null keys."""
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence"))
    return _found_bins(df, *by, bins=bins).groupBy(*by).agg(ratio(F.sum(F.col("n") * gap), F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def per_clinic(df: DataFrame) -> DataFrame:
    return rates(confusion(df, "clinic")).join(calibration_error(df, "clinic"), "clinic").select("clinic", (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("n"), "accuracy", "sensitivity", "specificity", "ece", "mce")


def negative_log_likelihood(temperature: Column) -> Column:
    s = (2 * F.col("label") - 1) * F.col("logit") / temperature
    return F.avg(F.log1p(F.exp(-F.abs(s))) + F.greatest(-s, F.lit(0.0)))


def temperature_grid(df: DataFrame, temperatures: list[float], *by: str) -> DataFrame:
    """All temperatures in one pass, as columns that are turned into rows."""
    wide = df.groupBy(*by).agg(*(negative_log_likelihood(F.lit(t)).alias(f"t{i}") for i, t in enumerate(temperatures)))
    rows = F.array(*(F.struct(F.lit(t).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(temperatures)))
    return wide.select(*by, F.inline(rows))


def fit_temperature(df: DataFrame, temperatures: list[float], *by: str) -> DataFrame:
    """The temperature of least loss, the first if several, null without a loss; 1 where only one label occurs."""
    least = F.min(F.when(F.col("nll").isNotNull(), F.struct("nll", "temperature")))
    best = temperature_grid(df, temperatures, *by).groupBy(*by).agg(least["temperature"].alias("temperature"))
    both = df.groupBy(*by).agg(F.countDistinct("label").alias("labels"))
    joined = best.join(both, list(by)) if by else best.crossJoin(F.broadcast(both))
    return joined.select(*by, F.when(F.col("labels") < 2, 1.0).otherwise(F.col("temperature")).alias("temperature"))


def conformal_quantile(df: DataFrame, alpha: float, *by: str) -> DataFrame:
    """The order statistic ceil((n + 1)(1 - alpha)) of 1 - p(true label); 1 and not attainable beyond n."""
    s = df.withColumn("score", F.when(F.col("label") == 1, 1 - F.col("prob")).otherwise(F.col("prob")))
    ranked = group_rank(s, list(by), "score", "case_id", "rn", "n")
    rank = F.ceil((F.col("n") + 1) * (1 - alpha))
    return ranked.groupBy(*by).agg(F.max("n").alias("n_cal"), F.coalesce(F.max(F.when(F.col("rn") == rank, F.col("score"))), F.lit(1.0)).alias("q"), (F.max(rank) <= F.max("n")).alias("attainable"))


def conformal_sets(df: DataFrame, fit: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Which labels are plausible at the fitted q: the set's size, the decision, and whether it covers."""
    d = df.join(fit.select(*by, "q"), by) if by else df.crossJoin(F.broadcast(fit.select("q")))
    one, zero = F.col("prob") >= 1 - F.col("q"), (1 - F.col("prob")) >= 1 - F.col("q")
    d = d.withColumns({"size": one.cast("int") + zero.cast("int"), "covered": F.when(F.col("label") == 1, one).otherwise(zero), "says": F.when(one, 1).otherwise(0)})
    return d.withColumn("decision", F.when(F.col("size") == 1, F.lit("report")).when(F.col("size") == 2, "ambiguous").otherwise("no_plausible_label"))


def conformal_summary(sets: DataFrame, alpha: float, *by: str) -> DataFrame:
    return sets.groupBy(*by).agg(
        F.count("*").alias("n"),
        share(F.col("covered")).alias("coverage"),
        F.greatest(F.lit(0.0), 1 - alpha - share(F.col("covered"))).alias("shortfall"),
        share(F.col("size") != 1).alias("abstention"),
        share(F.col("size") == 1).alias("singleton"),
        share(F.col("size") == 2).alias("ambiguous"),
        share(F.col("size") == 0).alias("empty"),
        F.avg(F.when(F.col("size") == 1, (F.col("says") == F.col("label")).cast("double"))).alias("selective_accuracy"),
        F.avg("size").alias("mean_size"),
    )


def brier_skill(df: DataFrame, *by: str) -> DataFrame:
    return brier(df, *by).join(df.groupBy(*by).agg(F.avg("label").alias("base")), list(by)).select(*by, (1 - ratio(F.col("brier"), F.col("base") * (1 - F.col("base")))).alias("skill"))


def murphy(df: DataFrame, *by: str, bins: int = 10) -> DataFrame:
    """Reliability, resolution and uncertainty of the Brier score over bins of probability."""
    d = df.withColumn("bin", edge_bin(F.col("prob"), linspace(0.0, 1.0, bins)))
    b = d.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("prob").alias("p"), F.avg("label").alias("o"), F.sum((F.col("prob") - F.col("label")) * (F.col("prob") - F.col("label"))).alias("se"))
    t = b.groupBy(*by).agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("o")) / F.sum("n")).alias("base"))
    j = b.join(t, list(by)) if by else b.crossJoin(F.broadcast(t))
    sq = lambda x: x * x
    out = j.groupBy(*by).agg(
        (F.sum(F.col("n") * sq(F.col("p") - F.col("o"))) / F.first("total")).alias("reliability"),
        (F.sum(F.col("n") * sq(F.col("o") - F.col("base"))) / F.first("total")).alias("resolution"),
        (F.first("base") * (1 - F.first("base"))).alias("uncertainty"),
        (F.sum("se") / F.first("total")).alias("actual"),
    )
    return out.withColumn("reconstructed", F.col("reliability") - F.col("resolution") + F.col("uncertainty"))


def sharpness(df: DataFrame, *by: str, bins: int = 10) -> DataFrame:
    d = df.withColumn("bin", edge_bin(F.col("prob"), linspace(0.0, 1.0, bins)))
    return d.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("prob").alias("mean"), F.stddev_pop("prob").alias("std"))


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """By average ranks of counted values, whose mean is known; null for fewer than two rows or a constant side."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("_n"))
    keys = list(by)
    d = pairs
    for value, rank in ((x, "rx"), (y, "ry")):
        ranks = average_ranks(pairs, keys, value, "_n", rank)
        d = d.join(ranks, [*keys, value])
    n = d.groupBy(*by).agg(F.sum("_n").alias("n"))
    d = d.join(n, keys) if by else d.crossJoin(F.broadcast(n))
    a, b, w = F.col("rx") - (F.col("n") + 1) / 2, F.col("ry") - (F.col("n") + 1) / 2, F.col("_n")
    g = d.groupBy(*by, "n").agg(F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"))
    return g.select(*by, F.when((F.col("n") >= 2) & (F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("rho"), "n")
