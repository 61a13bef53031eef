"""Selective prediction: risk against coverage, thresholds, deferral policies, severity response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.scalars import clip, correlation, ratio, share
from assayer.operators.metrics import with_confidence
from assayer.operators.quantiles import quantiles, summary
from assayer.operators.ranking import global_rank, group_rank

GRID = [i / 50 for i in range(51)]


def risk_coverage(df: DataFrame, confidence: str, *by: str) -> DataFrame:
    """At each distinct of 51 quantiles of confidence, what is kept.

    Rows are counted by the last threshold that they reach, in one aggregation; sums over the thresholds from the top answer all of them.
    """
    cuts = summary(df, list(by), {"q": (confidence, GRID)}, F.count("*").alias("total"))
    cuts = cuts.withColumn("q", F.array_distinct("q"))
    said, is_ = F.col("prob") >= 0.5, F.col("label") == 1
    joined = df.join(cuts, list(by)) if by else df.crossJoin(F.broadcast(cuts))
    reached = F.size(F.filter("q", lambda t: F.col(confidence) >= t - 1e-12))
    counts = joined.groupBy(*by, reached.alias("i")).agg(F.count("*").alias("n"), F.count_if(said & is_).alias("tp"), F.count_if(~said & ~is_).alias("tn"), F.count_if(is_).alias("p"))
    each = cuts.select(*by, "total", F.posexplode("q").alias("i", "threshold")).withColumn("i", F.col("i") + 1)
    w = Window.partitionBy(*by).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    kept = each.join(counts, [*by, "i"], "left").select(*by, "total", "threshold", *(F.coalesce(F.sum(x).over(w), F.lit(0)).alias(x) for x in ("n", "tp", "tn", "p")))
    n, p = F.col("n"), F.col("p")
    return kept.select(*by, "threshold", (n / F.col("total")).alias("coverage"), ratio(F.col("tp") + F.col("tn"), n).alias("accuracy"), ratio(F.col("tp"), p).alias("sensitivity"), ratio(F.col("tn"), n - p).alias("specificity"), n.alias("n_kept"))


def aurc(curve: DataFrame, *by: str) -> DataFrame:
    """Trapezoids of 1 - accuracy over coverage; one point gives its error."""
    w = Window.partitionBy(*by).orderBy("coverage", F.col("threshold").desc())
    step = (F.col("coverage") - F.lag("coverage").over(w)) * ((1 - F.col("accuracy")) + (1 - F.lag("accuracy").over(w))) / 2
    d = curve.where("n_kept > 0").withColumn("step", step)
    return d.groupBy(*by).agg(F.when(F.count("*") == 1, 1 - F.first("accuracy")).otherwise(F.sum("step")).alias("aurc"))


def tune_threshold(curve: DataFrame, target: float, least_coverage: float, *by: str) -> DataFrame:
    """The least feasible threshold that reaches the accuracy, else the one of the highest accuracy, the first if several."""
    w = Window.partitionBy(*by)
    d = curve.withColumn("feasible", F.col("coverage") >= least_coverage).withColumn("any", F.max("feasible").over(w)).where("feasible or not any")
    reached = F.min(F.when(F.col("accuracy") >= target, F.col("threshold")))
    best = F.max(F.struct("accuracy", (-F.col("threshold")).alias("t")))
    return d.groupBy(*by).agg(F.coalesce(reached, -best["t"]).alias("threshold"), reached.isNotNull().alias("reached"))


def human_rescue(df: DataFrame, threshold: float, *by: str) -> DataFrame:
    d = with_confidence(df)
    low = F.col("confidence") < threshold
    return d.groupBy(*by).agg(F.count_if(low).alias("n_deferred"), ratio(F.count_if(low & (F.col("correct") == 0)), F.count_if(low)).alias("would_correct"))


def physics_confidence(margin: Column) -> Column:
    """Logistic in the margin, on a scale of 12 dB; nothing measured is no confidence at all."""
    return F.coalesce(1 / (1 + F.exp(-margin / 12.0)), F.lit(0.0))


def policies(df: DataFrame) -> DataFrame:
    """Each case under three policies: learned, physics, and learned where the margin suffices."""
    learned = 1 - clip(F.col("mc_std") / 0.2, 0.0, 1.0)
    gated = F.when(F.coalesce(F.col("margin_db"), F.lit(-1.0)) <= 0, 0.0).otherwise(learned)
    each = F.array(*(F.struct(F.lit(n).alias("policy"), c.alias("confidence")) for n, c in (("learned", learned), ("physics", physics_confidence(F.col("margin_db"))), ("gated", gated))))
    return df.select("*", F.inline(each))


def operating_points(df: DataFrame, quantile: float = 0.2) -> DataFrame:
    """Each policy's figures with the confidence's quantile as threshold."""
    cut = quantiles(df, ["policy"], {"t": ("confidence", quantile)})
    d = df.join(F.broadcast(cut), "policy").withColumn("kept", F.col("confidence") >= F.col("t")).withColumn("right", (F.col("prob") >= 0.5) == (F.col("label") == 1))
    k = F.col("kept")
    return d.groupBy("policy").agg(share(k).alias("coverage"), F.avg(F.when(k, F.col("right").cast("double"))).alias("accuracy"), F.count_if(~k).alias("n_deferred"), F.count_if(~k & ~F.col("right")).alias("deferred_wrong"), F.count_if(k & ~F.col("right")).alias("kept_wrong"))


def complementarity(df: DataFrame, share_flagged: float = 0.2) -> DataFrame:
    """The k worst cases by each of two signals: their overlap, and errors that each catches."""
    d = df.withColumns({"learned": 1 - F.col("mc_std") / 0.2, "physics": physics_confidence(F.col("margin_db")), "wrong": ((F.col("prob") >= 0.5) != (F.col("label") == 1))})
    n = d.agg(F.greatest(F.lit(1), F.bround(F.count("*") * share_flagged).cast("int")).alias("k"))
    d = d.crossJoin(F.broadcast(n))
    d = global_rank(global_rank(d, "learned", "case_id", "ra"), "physics", "case_id", "rb")
    d = d.select("wrong", "learned", "physics", (F.col("ra") <= F.col("k")).alias("a"), (F.col("rb") <= F.col("k")).alias("b"))
    A, B, w = F.col("a"), F.col("b"), F.col("wrong")
    return d.agg(ratio(F.count_if(A & B), F.count_if(A | B)).alias("jaccard"), correlation("learned", "physics").alias("pearson"), F.count_if(w).alias("errors"), F.count_if(w & A).alias("by_learned"), F.count_if(w & B).alias("by_physics"), F.count_if(w & (A | B)).alias("by_either"), F.count_if(w & A & B).alias("by_both"))


def severity_thirds(df: DataFrame) -> DataFrame:
    """Mean uncertainty in the cleanest and the most degraded third of each group."""
    d = group_rank(df, ["clinic"], "severity", "case_id", "rn", "n").withColumn("k", F.greatest(F.floor(F.col("n") / 3), F.lit(1)))
    return d.groupBy("clinic").agg(F.avg(F.when(F.col("rn") <= F.col("k"), F.col("mc_std"))).alias("cleanest"), F.avg(F.when(F.col("rn") > F.col("n") - F.col("k"), F.col("mc_std"))).alias("most_degraded"))


def severity_response(df: DataFrame) -> DataFrame:
    """Ordinal-rank and linear correlation of margin with severity; null for fewer than three rows."""
    d = group_rank(df.where("margin_db is not null"), ["clinic"], "severity", "case_id", "ra")
    d = group_rank(d, ["clinic"], "margin_db", "case_id", "rb")
    enough = F.count("*") >= 3
    r = d.groupBy("clinic").agg(F.count("*").alias("n"), F.when(enough, correlation("ra", "rb")).alias("spearman"), F.when(enough, correlation("severity", "margin_db")).alias("pearson"))
    return r.join(df.groupBy("clinic").agg(share(F.col("margin_db").isNull()).alias("abstain")), "clinic").withColumn("as_expected", F.col("spearman") < 0)


def verdict(margin: Column) -> Column:
    return F.when(margin.isNull(), "abstain").when(margin >= 3, "detectable").when(margin <= 0, "insufficient").otherwise("marginal")


# What limits a capture, and what can be done about it; other causes cannot be put right by a retake.
FIXABLE = {"veil": "glare", "veil_fit": "glare", "blur": "blur", "quantization": "exposure", "sensor_noise": "exposure"}
CAUSES = (*FIXABLE, "grain")


def limiting(case_id: Column) -> Column:
    """The limiting cause of the canonical view's cases, which have none of their own; place 0, of ids below 0, has none either."""
    place = (case_id % len(CAUSES) + 1).cast("int")
    return F.when(place != 0, F.element_at(F.array(*map(F.lit, CAUSES)), place))


def triage(df: DataFrame, most_std: float = 0.1) -> DataFrame:
    """Abstain: retake. Short of a clear verdict: retake where the limiting cause can be put right, else refer. Clear but unsure: refer."""
    category = F.try_element_at(F.create_map(*(F.lit(x) for kv in FIXABLE.items() for x in kv)), limiting(F.col("case_id")))
    v = verdict(F.col("margin_db"))
    short = v.isin("insufficient", "marginal")
    action = F.when(v == "abstain", "retake").when(short, F.when(category.isNull(), "refer").otherwise("retake")).when(F.col("mc_std") > most_std, "refer").otherwise("report")
    reason = F.when(v == "abstain", "not_measured").when(short, F.coalesce(category, F.lit("not_fixable"))).when(F.col("mc_std") > most_std, "model_unsure").otherwise("adequate")
    gain = F.when((action == "retake") & (v != "abstain"), -20 * F.log10(F.greatest(1 - clip((F.col("case_id") % 10) / 10.0, 0.0, 0.95), F.lit(0.05)))).otherwise(0.0)
    return df.withColumns({"verdict": v, "action": action, "reason": reason, "gain_db": gain})


def triage_value(t: DataFrame) -> DataFrame:
    wrong = (F.col("prob") >= 0.5) != (F.col("label") == 1)
    total = t.agg(F.count("*").alias("total"))
    g = t.groupBy("action").agg(F.count("*").alias("n"), share(wrong).alias("error_rate"), F.count_if(F.col("label") == 1).alias("positives"))
    return g.crossJoin(F.broadcast(total)).select("action", (F.col("n") / F.col("total")).alias("rate"), "error_rate", "positives")


def triage_summary(t: DataFrame) -> DataFrame:
    return t.groupBy("action", "reason").agg(F.count("*").alias("n"), F.avg("gain_db").alias("mean_gain"))


def certificate_sweep(t: DataFrame) -> DataFrame:
    """By severity: shares of verdicts and actions, and the median margin."""
    is_ = lambda c, v: share(F.col(c) == v)
    shares = [*(is_("verdict", v).alias(v) for v in ("abstain", "insufficient", "marginal", "detectable")), is_("action", "retake").alias("retake"), is_("action", "refer").alias("refer")]
    return summary(t, ["severity"], {"median_margin": ("margin_db", 0.5)}, *shares)
