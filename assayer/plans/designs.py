"""Registered queries of drawn designs, aligned and scrambled pairs, frozen maps, gates and medians, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import audit, design, matching, selective, survey
from assayer.plans.catalogue import FEATURES, RIGHT, TRIAGE, R, rounded
from assayer.plans.views import Views
from assayer.registry import query

_SAYS = "case when {0} is null then 'abstain' when {0} >= 3 then 'detectable' when {0} <= 0 then 'insufficient' else 'marginal' end"
FINDINGS = {"nodule": "margin_db", "effusion": "margin_db - 2", "cavity": "margin_db + 1"}


@query(" union all ".join(f"select case_id, '{n}' as finding, {_SAYS.format(f'({m})')} as verdict from predictions" for n, m in FINDINGS.items()))
def verdict_family(v: Views) -> DataFrame:
    wide = v.predictions.select("case_id", "label", *(selective.verdict(F.expr(m)).alias(f"verdict_{n}") for n, m in FINDINGS.items()))
    return design.family(wide, "verdict_", "case_id", "finding", "verdict")


@query(f"""with {TRIAGE}, u as (select *, action = 'report' and greatest(prob, 1 - prob) < 0.8 as unsure from t)
select case_id, case when unsure then 'refer' else action end as action, case when unsure then 'model_uncertain_adequate_capture' else reason end as reason, {R('case when unsure then 0.0::double else gain_db end')} as gain_db from u""")
def triage_rewrite(v: Views) -> DataFrame:
    return rounded(design.refer_unsure(selective.triage(v.predictions), 0.8).select("case_id", "action", "reason", "gain_db"))


@query("select cast(to_json({'path': path, 'label': label}) as varchar) as record from manifest")
def manifest_records(v: Views) -> DataFrame:
    return design.records(v.manifest.select("path", "clinic", "label"), "clinic")


@query("select film, arg_max(case_id, (severity, case_id)) as case_id, floor(arg_max(prob, (severity, case_id)) * 1e6 + 0.5) / 1e6 as prob, count(*) as n from predictions where film in (select c_custkey from customer) group by film")
def last_capture(v: Views) -> DataFrame:
    """The last case of each film in the order of severity, for the films that are known."""
    last = design.last_by(v.predictions, "film", ["severity", "case_id"], "case_id", "prob")
    return rounded(last.join(v.table("customer").select(F.col("c_custkey").alias("film")), "film", "left_semi").select("film", "case_id", "prob", "n"))


@query("select c.c_custkey as case_id, r.reader, r.score from customer c left join ratings r on r.case_id = c.c_custkey")
def aligned_ratings(v: Views) -> DataFrame:
    key = v.table("customer").select(F.col("c_custkey").alias("case_id")).withColumn("reader", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    return design.aligned(key, v.ratings, "case_id", "reader").select("case_id", "reader", "score")


@query(f"""with o as (select case_id, severity, mc_std, row_number() over (partition by severity order by md5('4|' || case_id), case_id) as r, count(*) over (partition by severity) as n from predictions)
select a.case_id, a.severity, {R('a.mc_std')} as mc_std, {R('b.mc_std')} as scrambled from o a join o b on a.severity = b.severity and b.r = a.r % a.n + 1""")
def scrambled_pairing(v: Views) -> DataFrame:
    return rounded(design.scrambled(v.predictions, "case_id", "mc_std", "severity", 4))


@query(f"select film, {', '.join(f'{R(f"max(margin_db) filter (severity = {s})")} as s{int(s * 100)}' for s in (0.0, 0.25, 0.5, 0.75, 1.0))} from predictions group by film")
def pivot_margins(v: Views) -> DataFrame:
    d = v.predictions.withColumn("at", F.concat(F.lit("s"), (F.col("severity") * 100).cast("int").cast("string")))
    return rounded(d.groupBy("film").pivot("at", ["s0", "s25", "s50", "s75", "s100"]).agg(F.max("margin_db")))


@query("select case_id, clinic from predictions order by md5('0|' || case_id), case_id limit 200")
def fixed_sample(v: Views) -> DataFrame:
    return design.fixed_sample(v.predictions.select("case_id", "clinic"), 200, "case_id")


@query()
def sample_design(v: Views) -> DataFrame:
    return design.sample_design(v.predictions)


@query("select clinic, n as population, w.drawn as drawn from (select clinic, count(*) as n from predictions group by clinic), lateral (select least(n, 50) as drawn) w")
def stratum_allocation(v: Views) -> DataFrame:
    return survey.stratum_weights(v.predictions, 50, "clinic").select("clinic", "population", "drawn")


@query(f"""with b as (select clinic, min(mc_std) as lo, max(mc_std) as hi from predictions where severity <= 0.25 group by clinic)
select case_id, clinic, {R('case when hi - lo < 1e-12 then 0.5::double else least(1, greatest(0, 1 - (mc_std - lo) / nullif(hi - lo, 0))) end')} as confidence from predictions join b using (clinic) where severity > 0.25""")
def frozen_confidence(v: Views) -> DataFrame:
    p = v.predictions
    return rounded(design.frozen_confidence(p.where("severity <= 0.25"), p.where("severity > 0.25"), "mc_std", "clinic").select("case_id", "clinic", "confidence"))


@query("select 'confidence' as method, true as available union all select 'mc_dropout', count(mc_std) > 0 from predictions union all select 'head', false union all select 'ensemble', false")
def method_availability(v: Views) -> DataFrame:
    """The view has no ensemble, and a head that is not a number anywhere."""
    return design.methods_available(v.predictions.withColumn("head", F.lit(float("nan"))))


@query(f"""with {FEATURES} select clinic, 'mean' as feature, {R('avg(mean)')} as mean, {R('stddev_pop(mean)')} as std from features group by clinic
union all select clinic, 'std', {R('avg(std)')}, {R('stddev_pop(std)')} from features group by clinic union all select clinic, 'roughness', {R('avg(roughness)')}, {R('stddev_pop(roughness)')} from features group by clinic""")
def feature_summary(v: Views) -> DataFrame:
    return rounded(design.feature_summary(audit.capture_features(v.images), "clinic", ["mean", "std", "roughness"]))


@query()
def separability(v: Views) -> DataFrame:
    d = audit.capture_features(v.images).withColumn("label", (F.col("clinic") == "e0").cast("int"))
    return design.separability(d, ["mean", "std", "low", "high", "roughness"], "label")


@query(f"""with u as (select severity, mc_std as annulus, abs(logit) as interior, abs(logit) - mc_std as penalty from predictions where margin_db is not null)
select severity, cast(grouping(severity) as boolean) as overall, count(*) as n, {R('quantile_cont(annulus, 0.5)')} as annulus, {R('quantile_cont(interior, 0.5)')} as interior, {R('quantile_cont(penalty, 0.5)')} as penalty from u group by rollup (severity)""")
def glare_medians(v: Views) -> DataFrame:
    """Of captures that were measured: errors at the rim and inside, and what continuing inwards costs, by severity and overall."""
    u = v.predictions.where("margin_db is not null").select("severity", F.col("mc_std").alias("annulus"), F.abs("logit").alias("interior"), (F.abs("logit") - F.col("mc_std")).alias("penalty"))
    return rounded(design.rolled_medians(u, "severity", "annulus", "interior", "penalty"))


_RATES = f"{R(f'avg({RIGHT}::double)')} as accuracy, {R('count(*) filter (prob >= 0.5 and label = 1) / nullif(count(*) filter (label = 1), 0)')} as sensitivity, {R('count(*) filter (prob < 0.5 and label = 0) / nullif(count(*) filter (label = 0), 0)')} as specificity"


@query(f"select severity, false as pooled, {_RATES} from predictions group by severity union all select null, true, {_RATES} from predictions")
def pooled_and_by_severity(v: Views) -> DataFrame:
    return rounded(design.rolled_rates(v.predictions, "severity"))


@query(f"""with a as (select case case_id % 4 when 0 then 'baseline' when 1 then 'wedge' when 2 then 'ruler' else 'oracle' end as arm, logit, 0.5::double + mc_std * 5 as sigma from predictions)
select arm, count(*) as n, {R('quantile_cont(abs(logit), 0.5)')} as error, {R('quantile_cont(sigma, 0.5)')} as sigma, {R('avg((abs(logit) <= 2 * sigma)::double)')} as coverage from a group by arm""")
def arm_coverage(v: Views) -> DataFrame:
    a = v.predictions.select(F.expr("case case_id % 4 when 0 then 'baseline' when 1 then 'wedge' when 2 then 'ruler' else 'oracle' end").alias("arm"), "logit", F.expr("0.5D + mc_std * 5").alias("sigma"))
    return rounded(design.arm_coverage(a, "logit", "sigma", "arm"))


@query(f"""with x as (select log10(greatest(1e-6, least(1.0::double, x::double))) as v from (select unnest(px) as x from images)), q as (select quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.99) as hi from x)
select {R('any_value(lo)')} as log_lo, {R('any_value(hi)')} as log_hi, count(*) as n, {R('avg((m is null)::double)')} as abstain_rate, {R('quantile_cont(m, 0.5)')} as margin_median
from (select case when id % 9 <> 0 then px[1]::double end as m from images), q""")
def cache_stats(v: Views) -> DataFrame:
    d = v.images.select("px", F.expr("case when id % 9 <> 0 then cast(px[0] as double) end").alias("margin_db"))
    return rounded(design.cache_stats(d, "px", "margin_db"))


@query(f"""with g as (select clinic, count(*) filter (label = 1) p, count(*) filter (label = 0) n, sum(case when label = 1 then rk end) s from
  (select clinic, label, rank() over (partition by clinic order by prob) + (count(*) over (partition by clinic, prob) - 1) / 2.0::double as rk from predictions) group by clinic),
a as (select *, (s - p * (p + 1) / 2.0::double) / nullif(cast(p * n as double), 0) as auc from g)
select clinic, {R('auc')} as auc, {R('sqrt((auc * (1 - auc) + (p - 1) * (auc / (2 - auc) - auc * auc) + (n - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / nullif(p * n, 0))')} as se from a""")
def auc_standard_error(v: Views) -> DataFrame:
    from assayer.operators.metrics import roc_auc

    n = v.predictions.groupBy("clinic").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    a = roc_auc(v.predictions, "clinic").join(n, "clinic")
    return rounded(a.select("clinic", "auc", F.when((F.col("p") > 0) & (F.col("n") > 0), survey.hanley_mcneil(F.col("auc"), F.col("p"), F.col("n"))).alias("se")))


_CONDITIONS = "select exp(logit / 4) as ratio, case_id % 5 as seed, case_id % 17 = 3 as degenerate, case_id % 5003 = 1 as unphysical, label = 1 as passes from predictions"
_USABLE = "filter (ratio > 0 and not degenerate and not unphysical)"


@query(f"""with d as ({_CONDITIONS}), s as (select max(m) / min(m) as spread from (select seed, quantile_cont(ratio, 0.5) {_USABLE} as m from d group by seed)),
w as (select count(*) as n_conditions, count(*) {_USABLE} as n_usable, count(*) filter (degenerate) as n_degenerate, count(*) filter (unphysical) as n_unphysical, avg(degenerate::double) as degenerate_share, avg(passes::double) as pass_share,
  quantile_cont(ratio, 0.5) {_USABLE} as median, quantile_cont(ratio, 0.25) {_USABLE} as low, quantile_cont(ratio, 0.75) {_USABLE} as high from d)
select n_conditions, n_usable, n_degenerate, n_unphysical, {R('degenerate_share')} as degenerate_share, {R('pass_share')} as pass_share, {R('median')} as median, {R('low')} as low, {R('high')} as high, {R('spread')} as spread,
  coalesce(median between 0.5 and 2 and spread <= 2 and degenerate_share <= 0.2 and n_unphysical = 0, false) as holds from w, s""")
def gate_report(v: Views) -> DataFrame:
    d = v.predictions.select(F.exp(F.col("logit") / 4).alias("ratio"), (F.col("case_id") % 5).alias("seed"), F.expr("case_id % 17 = 3").alias("degenerate"), F.expr("case_id % 5003 = 1").alias("unphysical"), F.expr("label = 1").alias("passes"))
    return rounded(design.gate_report(d))


@query()
def paired_intervals(v: Views) -> DataFrame:
    return design.paired_intervals(v.runs, "3-MEDIUM")


_CHANNEL = "least(1, greatest(0, (log10(greatest(1e-6, least(1.0::double, {0}))) + 2.0::double) / 1.5::double))"


@query(f"""with o as (select case_id, severity, mc_std, row_number() over (partition by severity order by md5('4|' || case_id), case_id) as r, count(*) over (partition by severity) as n from predictions)
select 'channel' as mode, a.case_id, {R(_CHANNEL.format('a.mc_std'))} as channel from o a union all select 'scramble', a.case_id, {R(_CHANNEL.format('b.mc_std'))} from o a join o b on a.severity = b.severity and b.r = a.r % a.n + 1
union all select 'severity', case_id, severity from predictions union all select 'none', case_id, null from predictions""")
def fourth_channels(v: Views) -> DataFrame:
    """Of each case, what each mode selects: mc_std stands for the floor, between bounds of 0.01 and about 0.3."""
    each = [design.fourth_channel(v.predictions, m, "case_id", "mc_std", "severity", -2.0, -0.5, 4).select(F.lit(m).alias("mode"), "case_id", "channel") for m in design.CHANNELS]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return rounded(out)


_U = "('0x' || substr(md5('7|2|' || c_custkey), {}, 8))::bigint / 4294967296::double"


@query(f"select c_custkey as id, 2 as epoch, {R(_U.format(1))} as severity, {_U.format(9)} < 0.5 as flip, cast(floor({_U.format(17)} * 17 - 8) as int) as shift from customer")
def epoch_ids(v: Views) -> DataFrame:
    """What an epoch draws for each row."""
    ids = v.table("customer").select(F.col("c_custkey").alias("id"))
    return rounded(design.epoch_draws(ids, 7, 2).withColumn("epoch", F.col("epoch").cast("int")))


@query("select l_partkey as part, least(2, count(distinct l_orderkey)) as n from lineitem group by l_partkey")
def matched_orders(v: Views) -> DataFrame:
    """Orders matched to the parts that they hold, each order once and each part twice: there are orders enough for all."""
    found = matching.matched(v.table("lineitem").select(F.col("l_orderkey").alias("film"), F.col("l_partkey").alias("part")), "film", "part", 2)
    return found.groupBy("part").agg(F.count("*").alias("n"))


@query("select 'data/' || source || '/' || doc_id || '.png' as path, doc_id || '__s' || lpad(cast((doc_id % 5) * 25 as varchar), 3, '0') as key from documents")
def cache_keys(v: Views) -> DataFrame:
    from assayer.sources.tables import cache_key

    d = v.table("documents").select(F.expr("concat('data/', source, '/', doc_id, '.png')").alias("path"), F.expr("(doc_id % 5) * 0.25D").alias("severity"))
    return d.select("path", cache_key(F.col("path"), F.col("severity")).alias("key"))
