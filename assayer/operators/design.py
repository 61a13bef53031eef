"""Drawn designs, aligned and scrambled pairings, frozen confidence maps, gates and medians of experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.scalars import clip, share
from assayer.operators.metrics import confusion, rates
from assayer.operators.montecarlo import assigned, out_of_fold
from assayer.operators.quantiles import quantiles, summary
from assayer.operators.ranking import shuffled_rank
from assayer.operators.survey import quantile_stratum

# Uncertainty methods and the columns that they need; none means that confidence comes from the probability.
METHODS = {"confidence": None, "mc_dropout": "mc_std", "head": "head", "ensemble": "ensemble_std"}
#: The worst floor that a cache holds.
FLOOR_CLIP = 1.0
LEAST_FLOOR = 1e-6


def family(df: DataFrame, prefix: str, key: str, name: str = "name", value: str = "value") -> DataFrame:
    """The columns whose names begin with prefix, one to a row, their names without it."""
    columns = [c for c in df.columns if c.startswith(prefix)]
    if not columns:
        raise ValueError(f"no column begins with {prefix!r}")
    return df.select(key, *(F.col(c).alias(c.removeprefix(prefix)) for c in columns)).unpivot(key, [c.removeprefix(prefix) for c in columns], name, value)


def records(df: DataFrame, *leave: str) -> DataFrame:
    """Each row as one JSON record of all columns but those to leave."""
    return df.select(F.to_json(F.struct(*(c for c in df.columns if c not in leave)), {"ignoreNullFields": "false"}).alias("record"))


def rewritten(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Several columns at once where the condition holds; all are judged on the row as it was."""
    return df.withColumns({name: F.when(condition, x).otherwise(F.col(name)) for name, x in values.items()})


def refer_unsure(triaged: DataFrame, cut: float) -> DataFrame:
    """Adequate captures that the model is unsure of are referred: a retake would show the same."""
    unsure = (F.col("action") == "report") & (F.greatest("prob", 1 - F.col("prob")) < cut)
    return rewritten(triaged, unsure, action=F.lit("refer"), reason=F.lit("model_uncertain_adequate_capture"), gain_db=F.lit(0.0))


def last_by(df: DataFrame, key: str, order: list[str], *payload: str) -> DataFrame:
    """Of the rows of each key the last by `order`, with its payload."""
    last = F.max_by(F.struct(*payload), F.struct(*order))
    return df.groupBy(key).agg(last.alias("_last"), F.count("*").alias("n")).select(key, *(F.col(f"_last.{c}").alias(c) for c in payload), "n")


def aligned(key: DataFrame, ratings: DataFrame, *on: str, value: str = "score") -> DataFrame:
    """Every drawn case's rating; a missing one is an error."""
    missing = F.raise_error(F.concat(F.lit("missing rating of "), F.concat_ws("|", *on)))
    out = key.join(ratings.select(*on, value), list(on), "left")
    return out.withColumn(value, F.when(F.col(value).isNull(), missing.cast(ratings.schema[value].dataType)).otherwise(F.col(value)))


def scrambled(df: DataFrame, key: str, value: str, by: str, epoch: int) -> DataFrame:
    """Each row with the value of another of the same `by`, the next in an order that the epoch shuffles; alone, its own."""
    ranked = shuffled_rank(df.select(key, by, value), [by], epoch, key, "_r", "_n")
    other = ranked.select(F.col(by).alias("_by"), F.pmod(F.col("_r") - 2, F.col("_n")).alias("_at"), F.col(value).alias("scrambled"))
    met = ranked.join(other, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_r") - 1 == F.col("_at")))
    return met.select(key, by, value, "scrambled")


def fixed_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows, the same in each run: those whose keys have the least digests."""
    return df.withColumn("_digest", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))).orderBy("_digest", key).limit(n).drop("_digest")


def sample_design(df: DataFrame, n_cases: int = 120, strata: int = 3, repeats: float = 0.1, seed: int = 0, film: str = "film", case: str = "case_id") -> DataFrame:
    """A balanced draw over the cells of margin and uncertainty: display_order, case_id, film, cell, weight, is_repeat.

    Each cell gets n_cases // cells films, a film in one cell only; a drawn case weighs its cell's population by what is drawn
    of it. A share of the drawn is shown twice, with weight 0 and R after its id. Of a film's cases in its cell the least counts.
    """
    d = quantile_stratum(quantile_stratum(df, "margin_db", strata, "_m"), "mc_std", strata, "_u")
    d = d.withColumn("cell", F.concat(F.lit("m"), F.when(F.col("_m") < 0, "A").otherwise(F.col("_m").cast("string")), F.lit("u"), F.col("_u").cast("string")))
    population = d.groupBy("cell").agg(F.count("*").alias("population"))
    cells = population.count()
    drawn = assigned(d, film, "cell", max(1, n_cases // max(1, cells)))
    allocated = drawn.groupBy("cell").agg(F.count("*").alias("allocated"))
    cases = d.select(F.col(film).cast("string").alias(film), "cell", F.col(case).cast("string").alias("case_id"), F.col(case).alias("_case")).join(drawn, [film, "cell"])
    shown = cases.groupBy(film, "cell").agg(F.min_by("case_id", "_case").alias("case_id")).join(population, "cell").join(allocated, "cell")
    shown = shuffled_rank(shown, [], seed, "case_id", "_r", "_n").withColumn("weight", F.col("population") / F.col("allocated"))
    once = shown.select("case_id", film, "cell", "weight", F.lit(False).alias("is_repeat"))
    twice = shown.where(F.col("_r") <= F.bround(F.col("_n") * F.lit(repeats))).select(F.concat("case_id", F.lit("R")).alias("case_id"), film, "cell", F.lit(0.0).alias("weight"), F.lit(True).alias("is_repeat"))
    return shuffled_rank(once.unionByName(twice), [], seed + 1, "case_id", "display_order").select("display_order", "case_id", film, "cell", "weight", "is_repeat")


def frozen_confidence(fit: DataFrame, df: DataFrame, uncertainty: str, *by: str) -> DataFrame:
    """Uncertainty as confidence by the bounds of `fit`, cut to [0, 1]; bounds that tell nothing apart give 0.5, a group without bounds null."""
    bounds = fit.groupBy(*by).agg(F.min(uncertainty).alias("_low"), F.max(uncertainty).alias("_high"))
    d = df.join(bounds, list(by), "left") if by else df.crossJoin(F.broadcast(bounds))
    wide = F.col("_high") - F.col("_low")
    value = F.when(wide < 1e-12, 0.5).otherwise(clip(1 - (F.col(uncertainty) - F.col("_low")) / F.nullif(wide, F.lit(0.0)), 0.0, 1.0))
    return d.withColumn("confidence", value).drop("_low", "_high")


def methods_available(df: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """(method, available): a method is there if its column is and holds a number; an unknown method is an error."""
    methods = list(METHODS) if methods is None else methods
    if unknown := [m for m in methods if m not in METHODS]:
        raise ValueError(f"unknown uncertainty method {unknown[0]!r}; expected one of {list(METHODS)}")
    there = lambda c: F.count_if(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))) > 0
    found = df.agg(*((F.lit(True) if METHODS[m] is None else there(METHODS[m]) if METHODS[m] in df.columns else F.lit(False)).alias(m) for m in methods), F.count("*").alias("_n"))
    return found.select(F.inline(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("available")) for m in methods))))


def feature_summary(features: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Mean and spread of each feature in each group, one to a row."""
    g = features.groupBy(group).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
    return g.select(group, F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"mean_{c}").alias("mean"), F.col(f"std_{c}").alias("std")) for c in columns))))


def separability(features: DataFrame, columns: list[str], label: str, folds: int = 5) -> DataFrame:
    """Accuracy, its mean and spread over folds, with which a linear model tells two groups apart."""
    said, _ = out_of_fold(features, columns, label, folds)
    each = said.groupBy("fold").agg(share((F.col("prob") >= 0.5) == (F.col("label") == 1)).alias("accuracy"))
    return each.agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"), F.count("*").cast("int").alias("folds"))


def rolled(df: DataFrame, by: str, wanted: dict, *aggs: Column, flag: str = "overall") -> DataFrame:
    """summary() by group and over all, where `flag` is true."""
    each = summary(df, [by], wanted, *aggs).withColumn(flag, F.lit(False))
    return each.unionByName(summary(df, [], wanted, *aggs).withColumns({by: F.lit(None).cast(df.schema[by].dataType), flag: F.lit(True)}))


def rolled_medians(df: DataFrame, by: str, *columns: str) -> DataFrame:
    """Medians by group and over all (`overall`)."""
    return rolled(df, by, {c: (c, 0.5) for c in columns}, F.count("*").alias("n"))


def rolled_rates(df: DataFrame, by: str) -> DataFrame:
    """Accuracy, sensitivity and specificity by group and pooled."""
    pooled = rates(confusion(df)).select(F.lit(None).cast(df.schema[by].dataType).alias(by), F.lit(True).alias("pooled"), "accuracy", "sensitivity", "specificity")
    return rates(confusion(df, by)).select(by, F.lit(False).alias("pooled"), "accuracy", "sensitivity", "specificity").unionByName(pooled)


def arm_coverage(df: DataFrame, error: str, sigma: str, *by: str) -> DataFrame:
    """How often an arm's quoted interval of two deviations holds the truth, with the medians of both."""
    e = F.abs(F.col(error))
    return summary(df, list(by), {"error": (e, 0.5), "sigma": (sigma, 0.5)}, F.count("*").alias("n"), share(e <= 2 * F.col(sigma)).alias("coverage"))


def cache_stats(df: DataFrame, pixels: str, margin: str) -> DataFrame:
    """The range of log floors between their 1 % and 99 % quantiles, the share abstained, and the median margin."""
    log = F.log10(F.greatest(F.lit(LEAST_FLOOR), F.least(F.lit(FLOOR_CLIP), F.col("_x").cast("double"))))
    range_ = quantiles(df.select(F.explode(pixels).alias("_x")), [], {"log_lo": (log, 0.01), "log_hi": (log, 0.99)})
    rest = summary(df, [], {"margin_median": (margin, 0.5)}, F.count("*").alias("n"), share(F.col(margin).isNull()).alias("abstain_rate"))
    return range_.crossJoin(F.broadcast(rest))


CHANNELS = ("none", "channel", "scramble", "severity")


def fourth_channel(df: DataFrame, mode: str, key: str, floor: str, severity: str, low: float, high: float, epoch: int) -> DataFrame:
    """key, severity and what a model gets as its fourth channel: nothing, the log floor between training's bounds, another case's at the same severity, or the severity."""
    if mode not in CHANNELS:
        raise ValueError(f"unknown channel {mode!r}; expected one of {list(CHANNELS)}")
    if mode in ("none", "severity"):
        return df.select(key, severity, (F.lit(None).cast("double") if mode == "none" else F.col(severity).cast("double")).alias("channel"))
    rows = scrambled(df, key, floor, severity, epoch).withColumn(floor, F.col("scrambled")) if mode == "scramble" else df
    log = F.log10(F.greatest(F.lit(LEAST_FLOOR), F.least(F.lit(FLOOR_CLIP), F.col(floor).cast("double"))))
    return rows.select(key, severity, clip((log - low) / max(high - low, 1e-9), 0.0, 1.0).alias("channel"))


def gate_report(df: DataFrame, ratio: str = "ratio", seed: str = "seed", band: tuple[float, float] = (0.5, 2.0), most_spread: float = 2.0, most_degenerate: float = 0.2) -> DataFrame:
    """The falsification gate over conditions (ratio, seed, degenerate, unphysical, passes): counts, quartiles, spread over seeds, verdict.

    Only finite positive ratios of conditions that are neither degenerate nor unphysical are usable.
    """
    r = F.col(ratio)
    usable = r.isNotNull() & ~F.isnan(r) & (r > 0) & (r < float("inf")) & ~F.col("degenerate") & ~F.col("unphysical")
    whole = summary(
        df, [], {n: (F.when(usable, r), q) for n, q in (("median", 0.5), ("low", 0.25), ("high", 0.75))},
        F.count("*").alias("n_conditions"), F.count_if(usable).alias("n_usable"), F.count_if(F.col("degenerate")).alias("n_degenerate"), F.count_if(F.col("unphysical")).alias("n_unphysical"),
        share(F.col("degenerate")).alias("degenerate_share"), share(F.col("passes")).alias("pass_share"),
    )
    seeds = quantiles(df.where(usable), [seed], {"m": (r, 0.5)}).agg((F.max("m") / F.min("m")).alias("spread"))
    d = whole.crossJoin(F.broadcast(seeds))
    ok = F.col("median").between(*band) & (F.col("spread") <= most_spread) & (F.col("degenerate_share") <= most_degenerate) & (F.col("n_unphysical") == 0)
    return d.withColumn("holds", F.coalesce(ok, F.lit(False)))


def paired_intervals(runs: DataFrame, reference: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Each arm's mean difference from the reference over shared seeds, its bootstrap interval, and whether that leaves out 0.

    An arm's differences, one a seed, are drawn anew `draws` times by hashes; fewer than two give no interval.
    """
    ref = runs.where(F.col("arm") == reference).select("seed", F.col("score").alias("_ref"))
    each = runs.join(ref, "seed").groupBy("arm").agg(F.transform(F.array_sort(F.collect_list(F.struct("seed", (F.col("score") - F.col("_ref")).alias("d")))), lambda x: x["d"]).alias("d"))
    drawn = each.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    mean = F.expr(f"aggregate(sequence(0, size(d) - 1), 0D, (a, i) -> a + d[cast(pmod(xxhash64({seed}, arm, b, i), size(d)) as int)]) / size(d)")
    spread = drawn.groupBy("arm", "d").agg(F.percentile(mean, 0.025).alias("low"), F.percentile(mean, 0.975).alias("high"))
    enough = F.size("d") > 1
    mean_d = F.expr("aggregate(d, 0D, (a, x) -> a + x) / size(d)")
    return spread.select("arm", F.size("d").alias("shared"), mean_d.alias("delta"), F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"), (enough & ((F.col("low") > 0) | (F.col("high") < 0))).alias("separates"))


def epoch_draws(ids: DataFrame, seed: int, epoch: Column | int, key: str = "id") -> DataFrame:
    """Each row's augmentation of an epoch, a function of (seed, epoch, id) alone: severity in [0, 1), flip, and shift of up to 8.

    The draws are digits of the digest of all three: eight each.
    """
    e = F.lit(epoch) if isinstance(epoch, int) else epoch
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), e.cast("string"), F.col(key).cast("string")))
    u = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("double") / float(1 << 32)
    return ids.select(key, e.cast("long").alias("epoch"), u(0).alias("severity"), (u(1) < 0.5).alias("flip"), F.floor(u(2) * 17 - 8).cast("int").alias("shift"))


def epoch_stream(ids: DataFrame, epochs: DataFrame, seed: int) -> DataFrame:
    """The draws of each epoch as it arrives on the stream epochs (epoch): the ids are joined to it, nothing is kept as state."""
    return epoch_draws(epochs.select("epoch").crossJoin(ids), seed, F.col("epoch"))


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
