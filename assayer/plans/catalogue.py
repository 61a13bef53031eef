"""The registered queries: operators over the canonical views, each with DuckDB SQL of its own for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.scalars import correlation, r6
from assayer.operators import audit, design, metrics, nearhash, provenance, quantiles, selective, survey
from assayer.operators.ranking import shuffled_rank
from assayer.plans.views import Views
from assayer.registry import query
from assayer.streaming import monitor


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six decimals, for comparison between engines."""
    return df.select(*(r6(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields))


def R(sql: str) -> str:
    return f"floor(({sql}) * 1e6 + 0.5) / 1e6"


RIGHT = "((prob >= 0.5) = (label = 1))"
CONFUSION = "count(*) filter (prob >= 0.5 and label = 1) as tp, count(*) filter (prob < 0.5 and label = 0) as tn, count(*) filter (prob >= 0.5 and label = 0) as fp, count(*) filter (prob < 0.5 and label = 1) as fn"
EDGES15 = "[" + ", ".join(f"{e!r}::double" for e in metrics.linspace(0.5, 1.0, 15)) + "]"
EDGES10 = "[" + ", ".join(f"{e!r}::double" for e in metrics.linspace(0.0, 1.0, 10)) + "]"
BINNED = f"""binned as (select *, greatest(prob, 1 - prob) as conf, cast({RIGHT} as double) as correct,
    cast(least(14, greatest(0, len(list_filter({EDGES15}, lambda e: e <= greatest(prob, 1 - prob))) - 1)) as int) as bin from predictions)"""


@query(f"""with {BINNED},
b as (select clinic, bin, avg(conf) c, avg(correct) a, count(*) n from binned group by all),
e as (select clinic, sum(n * abs(a - c)) / sum(n) as ece, max(abs(a - c)) as mce from b group by clinic),
t as (select clinic, {CONFUSION} from predictions group by clinic)
select clinic, tp + tn + fp + fn as n, {R('(tp + tn) / (tp + tn + fp + fn)')} as accuracy, {R('tp / nullif(tp + fn, 0)')} as sensitivity,
  {R('tn / nullif(tn + fp, 0)')} as specificity, {R('ece')} as ece, {R('mce')} as mce from t join e using (clinic)""")
def per_clinic_table(v: Views) -> DataFrame:
    return rounded(metrics.per_clinic(v.predictions))


@query(f"select clinic, {CONFUSION} from predictions group by clinic")
def confusion_by_clinic(v: Views) -> DataFrame:
    return metrics.confusion(v.predictions, "clinic")


@query(f"""with r as (select clinic, label, rank() over (partition by clinic order by prob) + (count(*) over (partition by clinic, prob) - 1) / 2.0::double as rk from predictions),
g as (select clinic, sum(case when label = 1 then rk end) s, count(*) filter (label = 1) p, count(*) filter (label = 0) n from r group by clinic)
select clinic, {R('(s - p * (p + 1) / 2.0::double) / nullif(cast(p * n as double), 0)')} as auc from g""")
def roc_auc_by_clinic(v: Views) -> DataFrame:
    return rounded(metrics.roc_auc(v.predictions, "clinic"))


@query(f"select clinic, {R('avg((prob - label) * (prob - label))')} as brier, count(*) as n from predictions group by clinic")
def brier_summary(v: Views) -> DataFrame:
    return rounded(metrics.brier(v.predictions, "clinic"))


@query(f"""with {BINNED},
b as (select clinic, bin, avg(conf) c, avg(correct) a, count(*) n from binned group by all),
grid as (select clinic, cast(i as int) as bin from (select distinct clinic from predictions), range(15) t(i))
select clinic, bin, {R('c')} as mean_confidence, {R('a')} as accuracy, coalesce(n, 0) as n from grid left join b using (clinic, bin)""")
def reliability_bins(v: Views) -> DataFrame:
    return rounded(metrics.reliability(v.predictions, "clinic"))


@query(f"""with {BINNED}, b as (select severity, bin, avg(conf) c, avg(correct) a, count(*) n from binned group by all)
select severity, {R('sum(n * abs(a - c)) / sum(n)')} as ece, {R('max(abs(a - c))')} as mce from b group by severity""")
def ece_mce(v: Views) -> DataFrame:
    return rounded(metrics.calibration_error(v.predictions, "severity"))


TEMPERATURES = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 5.0]
GRID_SQL = f"""select clinic, t as temperature, avg(ln(1 + exp(-abs((2 * label - 1) * logit / t))) + greatest(-(2 * label - 1) * logit / t, 0)) as nll
    from predictions, (select unnest([{', '.join(f'{t}::double' for t in TEMPERATURES)}]) as t) group by all"""


@query(f"select clinic, temperature, {R('nll')} as nll from ({GRID_SQL})")
def temperature_grid(v: Views) -> DataFrame:
    return rounded(metrics.temperature_grid(v.predictions, TEMPERATURES, "clinic"))


@query(f"""with f as (select clinic, case when (select count(distinct label) from predictions p where p.clinic = g.clinic) < 2 then 1.0::double else arg_min(temperature, nll) end as temperature from ({GRID_SQL}) g group by clinic)
select clinic, temperature, {R('avg(1 / (1 + exp(-logit / temperature)))')} as mean_prob from predictions join f using (clinic) group by all""")
def temperature_fit_apply(v: Views) -> DataFrame:
    fit = metrics.fit_temperature(v.predictions, TEMPERATURES, "clinic")
    d = v.predictions.join(fit, "clinic")
    return rounded(d.groupBy("clinic", "temperature").agg(F.avg(1 / (1 + F.exp(-F.col("logit") / F.col("temperature")))).alias("mean_prob")))


ALPHA = 0.1
CALIBRATE = f"""fit as (select clinic, any_value(n) as n_cal, coalesce(max(s) filter (rn = rk), 1.0::double) as q, any_value(rk) <= any_value(n) as attainable from
  (select clinic, s, row_number() over (partition by clinic order by s, case_id) rn, count(*) over (partition by clinic) n, cast(ceil((count(*) over (partition by clinic) + 1) * (1 - {ALPHA}::double)) as bigint) rk
   from (select *, case when label = 1 then 1 - prob else prob end as s from predictions where case_id % 2 = 0)) group by clinic)"""
SETS = f"""{CALIBRATE}, sets as (select p.*, cast(prob >= 1 - q as int) + cast(1 - prob >= 1 - q as int) as size, case when label = 1 then prob >= 1 - q else 1 - prob >= 1 - q end as covered, cast(prob >= 1 - q as int) as says
  from predictions p join fit using (clinic) where case_id % 2 = 1)"""


def _conformal(v: Views) -> tuple[DataFrame, DataFrame]:
    fit = metrics.conformal_quantile(v.predictions.where("case_id % 2 = 0"), ALPHA, "clinic")
    return fit, metrics.conformal_sets(v.predictions.where("case_id % 2 = 1"), fit, ["clinic"])


@query(f"with {CALIBRATE} select clinic, n_cal, {R('q')} as q, attainable from fit")
def conformal_calibrate(v: Views) -> DataFrame:
    return rounded(_conformal(v)[0])


@query(f"with {SETS} select clinic, case size when 1 then 'report' when 2 then 'ambiguous' else 'no_plausible_label' end as decision, count(*) as n from sets group by all")
def conformal_decide(v: Views) -> DataFrame:
    return _conformal(v)[1].groupBy("clinic", "decision").agg(F.count("*").alias("n"))


@query(f"""with {SETS} select clinic, count(*) as n, {R('avg(covered::double)')} as coverage, {R(f'greatest(0, 1 - {ALPHA}::double - avg(covered::double))')} as shortfall, {R('avg((size <> 1)::double)')} as abstention,
  {R('avg((size = 1)::double)')} as singleton, {R('avg((size = 2)::double)')} as ambiguous, {R('avg((size = 0)::double)')} as empty, {R('avg(case when size = 1 then (says = label)::double end)')} as selective_accuracy, {R('avg(size)')} as mean_size from sets group by clinic""")
def conformal_evaluate(v: Views) -> DataFrame:
    return rounded(metrics.conformal_summary(_conformal(v)[1], ALPHA, "clinic"))


@query(f"""with half as (select *, row_number() over (partition by clinic order by md5('5|' || case_id), case_id) <= count(*) over (partition by clinic) // 2 as fitted from predictions),
f as (select clinic, coalesce(max(s) filter (rn = rk), 1.0::double) as q from (select clinic, s, row_number() over (partition by clinic order by s, case_id) rn, cast(ceil((count(*) over (partition by clinic) + 1) * (1 - {ALPHA}::double)) as bigint) rk
  from (select *, case when label = 1 then 1 - prob else prob end as s from half where fitted)) group by clinic)
select clinic, {R('avg((case when label = 1 then prob >= 1 - q else 1 - prob >= 1 - q end)::double)')} as coverage from half join f using (clinic) where not fitted group by clinic""")
def coverage_gap(v: Views) -> DataFrame:
    ranked = shuffled_rank(v.predictions, ["clinic"], 5, "case_id", "_r", "_n")
    half = ranked.withColumn("fitted", F.col("_r") <= F.floor(F.col("_n") / 2)).drop("_r", "_n")
    fit = metrics.conformal_quantile(half.where("fitted"), ALPHA, "clinic")
    return rounded(metrics.conformal_summary(metrics.conformal_sets(half.where("not fitted"), fit, ["clinic"]), ALPHA, "clinic").select("clinic", "coverage"))


CURVE = f"""c as (select *, greatest(prob, 1 - prob) as conf from predictions),
cuts as (select clinic, count(*) as total, unnest(list_distinct(quantile_cont(conf, [{', '.join(str(q) for q in selective.GRID)}]))) as threshold from c group by clinic),
curve as (select clinic, threshold, count(*) / any_value(total) as coverage, avg({RIGHT}::double) as accuracy, count(*) filter (label = 1 and prob >= 0.5) / nullif(count(*) filter (label = 1), 0) as sensitivity,
  count(*) filter (label = 0 and prob < 0.5) / nullif(count(*) filter (label = 0), 0) as specificity, count(*) as n_kept from cuts join c using (clinic) where conf >= threshold - 1e-12 group by clinic, threshold)"""


def _curve(v: Views) -> DataFrame:
    return selective.risk_coverage(v.predictions.withColumn("conf", F.greatest("prob", 1 - F.col("prob"))), "conf", "clinic")


@query(f"with {CURVE} select clinic, {R('threshold')} as threshold, {R('coverage')} as coverage, {R('accuracy')} as accuracy, {R('sensitivity')} as sensitivity, {R('specificity')} as specificity, n_kept from curve")
def risk_coverage_curve(v: Views) -> DataFrame:
    return rounded(_curve(v))


@query(f"""with {CURVE}, s as (select clinic, (coverage - lag(coverage) over w) * ((1 - accuracy) + (1 - lag(accuracy) over w)) / 2 as step from curve window w as (partition by clinic order by coverage, threshold desc))
select clinic, {R('sum(step)')} as aurc from s group by clinic""")
def aurc_by_clinic(v: Views) -> DataFrame:
    return rounded(selective.aurc(_curve(v), "clinic"))


@query(f"""with {CURVE}, f as (select *, coverage >= 0.3 as ok, max(coverage >= 0.3) over (partition by clinic) as any_ok from curve)
select clinic, {R('coalesce(min(threshold) filter (accuracy >= 0.8), arg_max(threshold, (accuracy, -threshold)))')} as threshold, coalesce(min(threshold) filter (accuracy >= 0.8) is not null, false) as reached from f where ok or not any_ok group by clinic""")
def tune_threshold(v: Views) -> DataFrame:
    return rounded(selective.tune_threshold(_curve(v), 0.8, 0.3, "clinic"))


@query(f"select clinic, count(*) filter (greatest(prob, 1 - prob) < 0.7) as n_deferred, {R(f'count(*) filter (greatest(prob, 1 - prob) < 0.7 and not {RIGHT}) / nullif(count(*) filter (greatest(prob, 1 - prob) < 0.7), 0)')} as would_correct from predictions group by clinic")
def human_rescue_rate(v: Views) -> DataFrame:
    return rounded(selective.human_rescue(v.predictions, 0.7, "clinic"))


@query(f"with a as (select clinic, avg({RIGHT}::double) as acc from predictions group by clinic) select clinic, floor(((select max(acc) from a) - acc) * 10000 + 0.5) / 10000 as gap from a")
def generalization_gap(v: Views) -> DataFrame:
    a = metrics.rates(metrics.confusion(v.predictions, "clinic")).select("clinic", "accuracy")
    top = a.agg(F.max("accuracy").alias("top"))
    return a.crossJoin(F.broadcast(top)).select("clinic", (F.floor((F.col("top") - F.col("accuracy")) * 10000 + 0.5) / 10000).alias("gap")).orderBy(F.desc("gap"), "clinic")


@query(f"""with {BINNED}, b as (select clinic, severity, bin, avg(conf) c, avg(correct) a, count(*) n from binned group by all)
select clinic, severity, {R('sum(n * abs(a - c)) / sum(n)')} as ece, {R('sum(n * a) / sum(n)')} as accuracy from b group by all""")
def calibration_heatmap(v: Views) -> DataFrame:
    acc = metrics.rates(metrics.confusion(v.predictions, "clinic", "severity")).select("clinic", "severity", "accuracy")
    return rounded(metrics.calibration_error(v.predictions, "clinic", "severity").select("clinic", "severity", "ece").join(acc, ["clinic", "severity"]))


@query(f"select clinic, {R('1 - avg((prob - label) * (prob - label)) / nullif(avg(label) * (1 - avg(label)), 0)')} as skill from predictions group by clinic")
def brier_skill(v: Views) -> DataFrame:
    return rounded(metrics.brier_skill(v.predictions, "clinic"))


@query(f"""with b as (select clinic, bin, count(*) n, avg(prob) p, avg(label) o, sum((prob - label) * (prob - label)) se from (select *, least(9, greatest(0, len(list_filter({EDGES10}, lambda e: e <= prob)) - 1)) as bin from predictions) group by all),
t as (select clinic, sum(n) as total, sum(n * o) / sum(n) as base from b group by clinic),
m as (select clinic, sum(n * (p - o) * (p - o)) / any_value(total) as rel, sum(n * (o - base) * (o - base)) / any_value(total) as res, any_value(base * (1 - base)) as unc, sum(se) / any_value(total) as actual from b join t using (clinic) group by clinic)
select clinic, {R('rel')} as reliability, {R('res')} as resolution, {R('unc')} as uncertainty, {R('actual')} as actual, {R('rel - res + unc')} as reconstructed from m""")
def murphy_decomposition(v: Views) -> DataFrame:
    return rounded(metrics.murphy(v.predictions, "clinic"))


@query(f"select clinic, bin, count(*) as n, {R('avg(prob)')} as mean, {R('stddev_pop(prob)')} as std from (select *, cast(least(9, greatest(0, len(list_filter({EDGES10}, lambda e: e <= prob)) - 1)) as int) as bin from predictions) group by all")
def sharpness_histogram(v: Views) -> DataFrame:
    return rounded(metrics.sharpness(v.predictions, "clinic"))


@query(f"""with d as (select clinic, rank() over (partition by clinic order by severity) + (count(*) over (partition by clinic, severity) - 1) / 2.0::double rx, rank() over (partition by clinic order by mc_std) + (count(*) over (partition by clinic, mc_std) - 1) / 2.0::double ry from predictions)
select clinic, {R('corr(rx, ry)')} as rho, count(*) as n from d group by clinic""")
def spearman_severity(v: Views) -> DataFrame:
    return rounded(metrics.spearman(v.predictions, "severity", "mc_std", "clinic"))


@query(f"""with d as (select *, row_number() over (partition by clinic order by severity, case_id) rn, count(*) over (partition by clinic) n from predictions)
select clinic, {R('avg(mc_std) filter (rn <= greatest(n // 3, 1))')} as cleanest, {R('avg(mc_std) filter (rn > n - greatest(n // 3, 1))')} as most_degraded from d group by clinic""")
def severity_thirds(v: Views) -> DataFrame:
    return rounded(selective.severity_thirds(v.predictions))


@query(f"""with d as (select *, row_number() over (partition by clinic order by severity, case_id) ra, row_number() over (partition by clinic order by margin_db, case_id) rb from predictions where margin_db is not null),
a as (select clinic, avg((margin_db is null)::double) as abstain from predictions group by clinic)
select clinic, count(*) as n, {R('corr(ra, rb)')} as spearman, {R('corr(severity, margin_db)')} as pearson, {R('any_value(abstain)')} as abstain, corr(ra, rb) < 0 as as_expected from d join a using (clinic) group by clinic""")
def severity_response(v: Views) -> DataFrame:
    return rounded(selective.severity_response(v.predictions))


LEARNED, PHYSICS = "1 - least(1, greatest(0, mc_std / 0.2::double))", "coalesce(1 / (1 + exp(-margin_db / 12.0::double)), 0)"


@query(f"""with p as (select *, 'learned' as policy, {LEARNED} as conf from predictions union all select *, 'physics', {PHYSICS} from predictions
  union all select *, 'gated', case when coalesce(margin_db, -1) <= 0 then 0 else {LEARNED} end from predictions),
t as (select policy, quantile_cont(conf, 0.2) as t from p group by policy)
select policy, {R('avg((conf >= t)::double)')} as coverage, {R(f'avg({RIGHT}::double) filter (conf >= t)')} as accuracy, count(*) filter (conf < t) as n_deferred, count(*) filter (conf < t and not {RIGHT}) as deferred_wrong, count(*) filter (conf >= t and not {RIGHT}) as kept_wrong from p join t using (policy) group by policy""")
def compare_policies(v: Views) -> DataFrame:
    return rounded(selective.operating_points(selective.policies(v.predictions)))


@query(f"""with d as (select *, 1 - mc_std / 0.2::double as l, {PHYSICS} as ph, not {RIGHT} as w, greatest(1, cast(round_even(count(*) over () * 0.2::double, 0) as int)) as k from predictions),
r as (select *, row_number() over (order by l, case_id) <= k as a, row_number() over (order by ph, case_id) <= k as b from d)
select {R('count(*) filter (a and b) / nullif(count(*) filter (a or b), 0)')} as jaccard, {R('corr(l, ph)')} as pearson, count(*) filter (w) as errors, count(*) filter (w and a) as by_learned, count(*) filter (w and b) as by_physics, count(*) filter (w and (a or b)) as by_either, count(*) filter (w and a and b) as by_both from r""")
def complementarity(v: Views) -> DataFrame:
    return rounded(selective.complementarity(v.predictions))


VERDICT = "case when margin_db is null then 'abstain' when margin_db >= 3 then 'detectable' when margin_db <= 0 then 'insufficient' else 'marginal' end"
CAUSE = "['veil', 'veil_fit', 'blur', 'quantization', 'sensor_noise', 'grain'][case_id % 6 + 1]"
CATEGORY = "['glare', 'glare', 'blur', 'exposure', 'exposure', null][case_id % 6 + 1]"
TRIAGE = f"""v as (select *, {VERDICT} as verdict, {CATEGORY} as category from predictions),
triage as (select *, case when verdict = 'abstain' then 'retake' when verdict in ('insufficient', 'marginal') then (case when category is null then 'refer' else 'retake' end) when mc_std > 0.1 then 'refer' else 'report' end as action,
  case when verdict = 'abstain' then 'not_measured' when verdict in ('insufficient', 'marginal') then coalesce(category, 'not_fixable') when mc_std > 0.1 then 'model_unsure' else 'adequate' end as reason from v),
t as (select *, case when action = 'retake' and verdict <> 'abstain' then -20 * log10(greatest(1 - least(0.95::double, greatest(0, (case_id % 10) / 10.0::double)), 0.05::double)) else 0.0::double end as gain_db from triage)"""


@query(f"with {TRIAGE} select case_id, verdict, action, reason, {R('gain_db')} as gain_db from t")
def triage_decide(v: Views) -> DataFrame:
    return rounded(selective.triage(v.predictions).select("case_id", "verdict", "action", "reason", "gain_db"))


@query(f"with {TRIAGE} select action, {R('count(*) / (select count(*) from t)')} as rate, {R(f'avg((not {RIGHT})::double)')} as error_rate, count(*) filter (label = 1) as positives from t group by action")
def triage_value(v: Views) -> DataFrame:
    return rounded(selective.triage_value(selective.triage(v.predictions)))


@query(f"with {TRIAGE} select action, reason, count(*) as n, {R('avg(gain_db)')} as mean_gain from t group by all")
def triage_summary(v: Views) -> DataFrame:
    return rounded(selective.triage_summary(selective.triage(v.predictions)))


def _is(column: str, value: str) -> str:
    return R(f"avg(({column} = '{value}')::double)")


@query(f"with {TRIAGE} select severity, {', '.join(f'{_is("verdict", x)} as {x}' for x in ('abstain', 'insufficient', 'marginal', 'detectable'))}, {R('quantile_cont(margin_db, 0.5)')} as median_margin, {_is('action', 'retake')} as retake, {_is('action', 'refer')} as refer from t group by severity")
def certificate_sweep(v: Views) -> DataFrame:
    return rounded(selective.certificate_sweep(selective.triage(v.predictions)))


@query(f"select case_id, {VERDICT} as verdict from predictions")
def certificate_verdict(v: Views) -> DataFrame:
    return v.predictions.select("case_id", selective.verdict(F.col("margin_db")).alias("verdict"))


# Provenance and splits.

@query("""select path, clinic, label, 'unassigned' as split, 0.0::double as degradation_severity, 0.05::double as uncertainty_target from manifest""")
def manifest_build(v: Views) -> DataFrame:
    return provenance.build_manifest(v.manifest)


@query("""select clinic, count(*) filter (label = 0) as normal, count(*) filter (label = 1) as positive, count(*) filter (label in (0, 1)) as total, floor(count(*) filter (label = 1) / greatest(count(*) filter (label in (0, 1)), 1) * 1000 + 0.5) / 1000 as positive_share from manifest group by clinic""")
def class_balance(v: Views) -> DataFrame:
    return provenance.class_balance(v.manifest)


SPLIT_LOCO = """split as (select *, case when clinic = 'src0' then 'test' when row_number() over (partition by clinic, label order by md5('7|' || path), path) <= cast(round_even(count(*) over (partition by clinic, label) * 0.2::double, 0) as int) then 'val' else 'train' end as split from manifest where label >= 0)"""


@query(f"with {SPLIT_LOCO} select path, clinic, label, split from split")
def split_loco(v: Views) -> DataFrame:
    return provenance.split(v.manifest, "loco", holdout="src0")


@query(f"with {SPLIT_LOCO} select path, clinic, label from split where split = 'test'")
def split_filter(v: Views) -> DataFrame:
    """The rows of one split."""
    return provenance.split(v.manifest, "loco", holdout="src0").where("split = 'test'").select("path", "clinic", "label")


@query(f"with {SPLIT_LOCO} select split, count(*) filter (label = 0) as normal, count(*) filter (label = 1) as positive, count(*) as total from split group by split")
def split_summary(v: Views) -> DataFrame:
    return provenance.split_summary(provenance.split(v.manifest, "loco", holdout="src0"))


@query("""with d as (select *, row_number() over (partition by label order by md5('7|' || path), path) as r, cast(round_even(count(*) over (partition by label) * 0.2::double, 0) as int) as k from manifest where label >= 0)
select path, clinic, label, case when r <= k then 'test' when r <= 2 * k then 'val' else 'train' end as split from d""")
def split_random(v: Views) -> DataFrame:
    return provenance.split(v.manifest, "random")


@query("select clinic, count(*) as n from manifest where label >= 0 group by clinic having count(distinct label) >= 2")
def two_class_folds(v: Views) -> DataFrame:
    return provenance.two_class_groups(v.manifest)


@query("""select path, clinic, label from (select *, row_number() over (partition by clinic, label order by md5('3|' || path), path) as r, count(*) over (partition by clinic, label) as n from manifest) where r <= cast(round_even(n * 0.25::double, 0) as int)""")
def stratified_fraction_sample(v: Views) -> DataFrame:
    return provenance.stratified_sample(v.manifest, 0.25, "clinic", "label")


@query("""select path, case when regexp_matches(lower(path), '(^|/)mcucxr[^/]*$|montgomery') then 'montgomery' when regexp_matches(lower(path), '(^|/)chncxr[^/]*$|shenzhen|china') then 'shenzhen' when regexp_matches(lower(path), 'niaid|tbportal') then 'niaid' when lower(path) like '%rsna%' then 'rsna' when lower(path) like '%belarus%' then 'belarus' else 'unknown' end as clinic,
  case when label < 0 then (case when path like '%\\_1.png' escape '\\' then 1 when path like '%\\_0.png' escape '\\' then 0 else label end) else label end as label
from (select (['x/RSNA/a', 'MCUCXR_000', 'China/CHNCXR_', 'mcucxr/Belarus_'])[doc_id % 4 + 1] || doc_id || '_' || (doc_id % 3) || '.png' as path, -1 as label from documents)""")
def provenance_rules(v: Views) -> DataFrame:
    d = v.table("documents").select(F.expr("concat(array('x/RSNA/a', 'MCUCXR_000', 'China/CHNCXR_', 'mcucxr/Belarus_')[doc_id % 4], doc_id, '_', doc_id % 3, '.png') as path"), F.lit(-1).alias("label"))
    return d.select("path", provenance.clinic_of_path(F.col("path")).alias("clinic"), provenance.label_of_name(F.col("path"), F.col("label")).alias("label"))


@query("select clinic, 5 as clinic_index from (select distinct clinic from manifest) union all select * from (values (' Montgomery ', 0), ('RSNA', 3))")
def clinic_numbers(v: Views) -> DataFrame:
    more = v.spark.createDataFrame([(" Montgomery ",), ("RSNA",)], "clinic string")
    return v.manifest.select("clinic").distinct().unionByName(more).select("clinic", provenance.clinic_index(F.col("clinic")).alias("clinic_index"))


# Audits over images.

HASH = "hashes as (select id, clinic, cast(list_sum(list_transform(range(63), lambda i: case when px[i + 2] > px[i + 1] then (1::bigint << i) else 0 end)) as bigint) as hash from images)"
MOST_BITS = 14
PAIRS = f"{HASH}, pairs as (select a.id as id_a, b.id as id_b, a.clinic as clinic_a, b.clinic as clinic_b, cast(bit_count(xor(a.hash, b.hash)) as int) as bits from hashes a join hashes b on a.id < b.id and bit_count(xor(a.hash, b.hash)) <= {MOST_BITS})"


def _pairs(v: Views) -> DataFrame:
    h = audit.difference_hash(v.images)
    return audit.near_pairs(h, h, MOST_BITS)


@query(f"with {HASH} select id, clinic, hash from hashes")
def dhash_bits(v: Views) -> DataFrame:
    return audit.difference_hash(v.images)


@query(f"with {PAIRS} select * from pairs")
def near_duplicates_banded(v: Views) -> DataFrame:
    return _pairs(v)


@query(f"with {PAIRS} select clinic_a as clinic, count(*) as pairs from pairs where clinic_a = clinic_b group by clinic_a")
def self_duplicates(v: Views) -> DataFrame:
    return audit.self_pairs(audit.pair_counts(audit.difference_hash(v.images), MOST_BITS))


@query(f"""with {PAIRS}, pairs2 as (select id_a, clinic_a, clinic_b from pairs union all select id_b, clinic_b, clinic_a from pairs), s as (select clinic as clinic_a, count(*) as size from images group by clinic)
select clinic_a, clinic_b, count(*) as pairs, count(distinct id_a) as n_a, {R('count(distinct id_a) / any_value(size)')} as fraction, case when count(distinct id_a) / any_value(size) <= 0.01 then 'suspect' else 'overlapping' end as verdict from pairs2 join s using (clinic_a) group by clinic_a, clinic_b""")
def overlap_verdict(v: Views) -> DataFrame:
    return rounded(audit.overlap(audit.pair_counts(audit.difference_hash(v.images), MOST_BITS), v.images))


@query(f"with {PAIRS} select max(bits) filter (clinic_a = clinic_b) as pos_max, min(bits) filter (clinic_a <> clinic_b) as neg_min, quantile_cont(bits, 0.5) filter (clinic_a = clinic_b) as pos_median, quantile_cont(bits, 0.5) filter (clinic_a <> clinic_b) as neg_median, min(bits) filter (clinic_a <> clinic_b) - max(bits) filter (clinic_a = clinic_b) as gap, cast(case when min(bits) filter (clinic_a <> clinic_b) - max(bits) filter (clinic_a = clinic_b) > 1 then (max(bits) filter (clinic_a = clinic_b) + min(bits) filter (clinic_a <> clinic_b)) // 2 end as int) as threshold from pairs")
def hash_calibration(v: Views) -> DataFrame:
    return audit.hash_calibration(audit.pair_counts(audit.difference_hash(v.images), MOST_BITS), "clinic_a = clinic_b")


WIDE = """films as (select 2 * id as id, clinic, list_transform(px, lambda x: x::double) as px from images union all select 2 * id + 1, 'copies', list_transform(px, lambda x: floor(x::double * 64) / 64) from images),
wide as (select id, clinic, list_transform(range(1, 5), lambda s: cast(list_sum(list_transform(range(64), lambda i: case when px[(i + s) % 64 + 1] > px[i + 1] then (case when i = 63 then -9223372036854775808 else 1::bigint << i end) else 0 end)) as bigint)) as hash from films),
pairs as (select * from (select a.id as id_a, b.id as id_b, a.clinic as clinic_a, b.clinic as clinic_b, cast(list_sum(list_transform(range(1, 5), lambda w: bit_count(xor(a.hash[w], b.hash[w])))) as int) as bits from wide a join wide b on a.id < b.id) where bits <= 14)"""


def _wide(v: Views) -> DataFrame:
    """Hashes of 256 bits of the images, and of copies that were stored more coarsely."""
    px = F.transform("px", lambda x: x.cast("double"))
    films = v.images.select((F.col("id") * 2).alias("id"), "clinic", px.alias("px"))
    copies = v.images.select((F.col("id") * 2 + 1).alias("id"), F.lit("copies").alias("clinic"), F.transform(px, lambda x: F.floor(x * 64) / 64).alias("px"))
    return nearhash.gradient_words(films.unionByName(copies))


@query(f"with {WIDE} select * from pairs")
def near_pairs_wide(v: Views) -> DataFrame:
    return nearhash.near_images(_wide(v), MOST_BITS)


@query(f"""with {WIDE}, pairs2 as (select id_a, clinic_a, clinic_b from pairs union all select id_b, clinic_b, clinic_a from pairs), s as (select clinic as clinic_a, count(*) as size from films group by clinic)
select clinic_a, clinic_b, count(*) as pairs, count(distinct id_a) as n_a, {R('count(distinct id_a) / any_value(size)')} as fraction, case when count(distinct id_a) / any_value(size) <= 0.01 then 'suspect' else 'overlapping' end as verdict from pairs2 join s using (clinic_a) group by clinic_a, clinic_b""")
def overlap_wide(v: Views) -> DataFrame:
    h = _wide(v)
    return rounded(audit.overlap(audit.pair_counts(h, MOST_BITS), h))


@query(f"with {WIDE}, p as (select bits, id_a // 2 = id_b // 2 as same from pairs) select max(bits) filter (same) as pos_max, min(bits) filter (not same) as neg_min, quantile_cont(bits, 0.5) filter (same) as pos_median, count(*) filter (same) as n from p")
def calibration_wide(v: Views) -> DataFrame:
    """Of an image and its coarser copy, how many bits differ where the copy is found; of other pairs, the least, if any is near."""
    same = F.expr("id_a div 2 = id_b div 2")
    return nearhash.near_images(_wide(v), MOST_BITS).agg(F.max(F.when(same, F.col("bits"))).alias("pos_max"), F.min(F.when(~same, F.col("bits"))).alias("neg_min"), F.percentile(F.when(same, F.col("bits")), 0.5).alias("pos_median"), F.count_if(same).alias("n"))


FEATURES = "features as (select id, clinic, list_avg(p) as mean, sqrt(list_avg(list_transform(p, lambda x: (x - list_avg(p)) * (x - list_avg(p))))) as std, list_min(p) as low, list_max(p) as high, list_avg(list_transform(range(1, len(p)), lambda i: abs(p[i + 1] - p[i]))) as roughness from (select *, list_transform(px, lambda x: x::double) as p from images))"


@query(f"with {FEATURES} select id, clinic, {', '.join(f'{R(x)} as {x}' for x in ('mean', 'std', 'low', 'high', 'roughness'))} from features")
def image_features(v: Views) -> DataFrame:
    return rounded(audit.capture_features(v.images))


@query(f"with {FEATURES} select clinic, count(*) as n, {R('quantile_cont(mean, 0.5)')} as median, {R('avg(mean)')} as brightness, {R('avg(std)')} as contrast from features group by clinic")
def shift_table(v: Views) -> DataFrame:
    return rounded(audit.shift_table(audit.capture_features(v.images)))


@query("""with c as (select clinic, count(*) filter (label = 0) as neg, count(*) filter (label = 1) as pos from manifest group by clinic)
select a.clinic as negatives_of, a.neg, b.clinic as positives_of, b.pos, a.neg + b.pos as n from c a join c b on a.clinic <> b.clinic where a.neg >= 2 and b.pos >= 2""")
def hybrid_cohorts(v: Views) -> DataFrame:
    return audit.hybrid_cohorts(v.manifest, 2)


@query("select a.clinic as clinic_a, b.clinic as clinic_b from (select distinct clinic from manifest) a join (select distinct clinic from manifest) b on a.clinic < b.clinic")
def pairwise_clinics(v: Views) -> DataFrame:
    c = v.manifest.select("clinic").distinct()
    return c.select(F.col("clinic").alias("clinic_a")).join(c.select(F.col("clinic").alias("clinic_b")), F.col("clinic_a") < F.col("clinic_b"))


# Joins, sets and reshaping.

@query("select case_id, clinic, e.event_type, p.prob >= 0.5 as said from predictions p left join (select event_id, event_type from events) e on e.event_id = p.case_id")
def left_join_meta(v: Views) -> DataFrame:
    meta = v.table("events").select(F.col("event_id").alias("case_id"), "event_type")
    return v.predictions.join(meta, "case_id", "left").select("case_id", "clinic", "event_type", (F.col("prob") >= 0.5).alias("said"))


@query("select d.doc_id, d.source, l.quality, l.toxic from documents d left join labels l on l.doc_id = d.doc_id")
def left_join_labels(v: Views) -> DataFrame:
    """The whole of both tables, where some documents have no label."""
    labels = v.table("labels").select("doc_id", "quality", "toxic")
    return v.table("documents").select("doc_id", "source").join(labels, "doc_id", "left")


@query(f"select film, arg_max(case_id, (severity, case_id)) as case_id, arg_max(clinic, (severity, case_id)) as clinic, {R('arg_max(prob, (severity, case_id))')} as prob, count(*) as n from predictions group by film")
def dedup_last_wins(v: Views) -> DataFrame:
    """The last case of each film in the order of severity and case, with what it holds."""
    from assayer.operators.design import last_by

    return rounded(last_by(v.predictions, "film", ["severity", "case_id"], "case_id", "clinic", "prob"))


@query("select case_id, film from predictions p where exists (select 1 from customer c where c.c_custkey = p.film and c.c_acctbal > 0)")
def semi_join_wanted(v: Views) -> DataFrame:
    wanted = v.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("film"))
    return v.predictions.join(wanted, "film", "left_semi").select("case_id", "film")


@query("select case_id from predictions p where not exists (select 1 from predictions d where d.case_id = p.case_id and d.severity <= 0.5)")
def anti_join_resume(v: Views) -> DataFrame:
    from assayer.sources.tables import remaining

    return remaining(v.predictions.select("case_id"), v.predictions.where("severity <= 0.5"), "case_id")


@query("select id, s as severity from images, (values (0.0::double), (0.25::double), (0.5::double), (0.75::double), (1.0::double)) t(s)")
def cross_severity(v: Views) -> DataFrame:
    return v.images.select("id", F.explode(F.array(*(F.lit(x / 4) for x in range(5)))).alias("severity"))


@query(f"select 'c0' as fold, clinic, count(*) as n from predictions where clinic = 'c0' group by clinic union all select 'c1', clinic, count(*) from predictions where clinic = 'c1' group by clinic union all select 'rest', clinic, count(*) from predictions where clinic not in ('c0', 'c1') group by clinic")
def union_folds(v: Views) -> DataFrame:
    part = lambda fold, cond: v.predictions.where(cond).groupBy("clinic").agg(F.count("*").alias("n")).select(F.lit(fold).alias("fold"), "clinic", "n")
    return part("c0", "clinic = 'c0'").unionByName(part("c1", "clinic = 'c1'")).unionByName(part("rest", "clinic not in ('c0', 'c1')"))


@query("select seed from runs where arm = '1-URGENT' intersect select seed from runs where arm = '2-HIGH'")
def intersect_seeds(v: Views) -> DataFrame:
    seeds = lambda arm: v.runs.where(F.col("arm") == arm).select("seed")
    return seeds("1-URGENT").intersect(seeds("2-HIGH"))


@query("select arm from runs except select * from (values ('1-URGENT'), ('5-LOW'))")
def except_arms(v: Views) -> DataFrame:
    return v.runs.select("arm").exceptAll(v.runs.select("arm").where("arm in ('1-URGENT', '5-LOW')")).distinct()


@query(f"""with x as (select clinic, {VERDICT} as verdict from predictions)
select clinic, {', '.join(f"{R(f'''count(*) filter (verdict = '{x}') / count(*)''')} as {x}" for x in ('abstain', 'detectable', 'insufficient', 'marginal'))} from x group by clinic""")
def pivot_verdicts(v: Views) -> DataFrame:
    names = ["abstain", "detectable", "insufficient", "marginal"]
    d = v.predictions.withColumn("verdict", selective.verdict(F.col("margin_db")))
    p = d.groupBy("clinic").pivot("verdict", names).count().na.fill(0)
    total = sum((F.col(n) for n in names), F.lit(0))
    return rounded(p.select("clinic", *((F.col(n) / total).alias(n) for n in names)))


@query(f"select case_id, 'nodule' as finding, {R('margin_db')} as margin from predictions union all select case_id, 'effusion', {R('margin_db - 2')} from predictions union all select case_id, 'cavity', {R('margin_db + 1')} from predictions")
def unpivot_findings(v: Views) -> DataFrame:
    wide = v.predictions.select("case_id", r6("margin_db").alias("nodule"), r6("margin_db - 2").alias("effusion"), r6("margin_db + 1").alias("cavity"))
    return wide.unpivot("case_id", ["nodule", "effusion", "cavity"], "finding", "margin")


@query(f"select clinic, cast(grouping(clinic) as int) as whole, count(*) as n, {R('avg((margin_db is null)::double)')} as abstain, {R('quantile_cont(margin_db, 0.5)')} as median_margin from predictions group by rollup (clinic)")
def rollup_coverage(v: Views) -> DataFrame:
    from assayer.functions.scalars import share

    d = design.rolled(v.predictions, "clinic", {"median_margin": ("margin_db", 0.5)}, F.count("*").alias("n"), share(F.col("margin_db").isNull()).alias("abstain"), flag="whole")
    return rounded(d.withColumn("whole", F.col("whole").cast("int")))


@query(f"""with f as (select case_id, list_sort([(margin_db, 0), (margin_db - 2, 1), (margin_db + 1, 2)])[1] as w from predictions where margin_db is not null)
select case_id, (['nodule', 'effusion', 'cavity'])[w[2] + 1] as finding, {R('w[1]')} as margin from f""")
def worst_finding(v: Views) -> DataFrame:
    each = F.expr("array_min(array(struct(margin_db as m, 0 as i), struct(margin_db - 2 as m, 1 as i), struct(margin_db + 1 as m, 2 as i)))")
    d = v.predictions.where("margin_db is not null").select("case_id", each.alias("w"))
    return rounded(d.select("case_id", F.expr("array('nodule', 'effusion', 'cavity')[w.i] as finding"), F.col("w.m").alias("margin")))


@query(f"with g as (select clinic, {CAUSE} as cause, count(*) as n from predictions where margin_db <= 3 group by 1, 2) select clinic, cause, n from (select *, row_number() over (partition by clinic order by n desc, cause) as r from g) where r = 1")
def limiting_factor(v: Views) -> DataFrame:
    d = v.predictions.where("margin_db <= 3").groupBy("clinic", selective.limiting(F.col("case_id")).alias("cause")).agg(F.count("*").alias("n"))
    return d.groupBy("clinic").agg(F.min(F.struct((-F.col("n")).alias("m"), "cause", "n")).alias("w")).select("clinic", "w.cause", "w.n")


# Survey statistics.

@query(f"""with e as (select quantile_cont(margin_db, [0.25, 0.5, 0.75]) as m from predictions)
select case_id, case when margin_db is null then -1 else cast(len(list_filter(m, lambda q: q < margin_db)) as int) end as stratum from predictions, e""")
def quantile_strata(v: Views) -> DataFrame:
    return survey.quantile_stratum(v.predictions, "margin_db", 4, "stratum").select("case_id", "stratum")


@query(f"select clinic, severity, count(*) as population, least(count(*), 50) as drawn, {R('count(*) / least(count(*), 50)')} as weight from predictions group by all")
def stratum_weights(v: Views) -> DataFrame:
    return rounded(survey.stratum_weights(v.predictions, 50, "clinic", "severity"))


@query(f"select case_id, {R('-coalesce(margin_db, (select min(margin_db) from predictions) - 1)')} as referral from predictions")
def referral_score(v: Views) -> DataFrame:
    return rounded(survey.referral_score(v.predictions).select("case_id", "referral"))


@query(f"""with d as (select clinic, label, prob, 1 + case_id % 3 as w from predictions), c as (select clinic, prob, sum(case when label = 1 then w else 0 end) p, sum(case when label = 0 then w else 0 end) n from d group by all),
b as (select *, coalesce(sum(n) over (partition by clinic order by prob rows between unbounded preceding and 1 preceding), 0) as below from c)
select clinic, {R('sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0)')} as auc from b group by clinic""")
def weighted_auc(v: Views) -> DataFrame:
    return rounded(survey.weighted_auc(v.predictions.withColumn("w", 1.0 + F.col("case_id") % 3), "prob", "w", "clinic"))


AGREE = """x as (select case_id, reader, cast(score >= 4 as int) as x from ratings), g as (select a.reader as reader_a, b.reader as reader_b, count(*) n, avg((a.x = b.x)::double) po, avg(a.x) pa, avg(b.x) pb from x a join x b using (case_id) where a.reader < b.reader group by all),
h as (select *, pa * pb + (1 - pa) * (1 - pb) as pe, 2 * ((pa + pb) / 2) * (1 - (pa + pb) / 2) as pg from g)"""


@query(f"with {AGREE} select reader_a, reader_b, n, {R('po')} as po, {R('(po - pe) / nullif(1 - pe, 0)')} as kappa, {R('(po - pg) / nullif(1 - pg, 0)')} as ac1 from h")
def kappa_ac1(v: Views) -> DataFrame:
    return rounded(survey.agreement(survey.reader_pairs(v.ratings), "reader_a", "reader_b"))


@query(f"""with t as (select count(*) nn, count(distinct case_id) n, count(distinct reader) k, avg(score) m, sum(score * score)::double ss from ratings),
r as (select sum(x * x) rr from (select avg(score) x from ratings group by case_id)), c as (select sum(x * x) cc from (select avg(score) x from ratings group by reader)),
s as (select n, k, k * (rr - n * m * m) / (n - 1) as msr, n * (cc - k * m * m) / (k - 1) as msc, (ss - n * k * m * m - k * (rr - n * m * m) - n * (cc - k * m * m)) / ((n - 1) * (k - 1)) as mse from t, r, c),
i as (select n, k, (msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n) as icc from s)
select n, k, {R('icc')} as icc, {R('case when icc > 0 then k * icc / (1 + (k - 1) * icc) end')} as averaged from i""")
def icc21(v: Views) -> DataFrame:
    return rounded(survey.icc(v.ratings))


@query("select case_id, avg((score >= 4)::double) > 0.5 as refer from ratings group by case_id")
def majority_vote(v: Views) -> DataFrame:
    return survey.majority(v.ratings)


@query(f"""with d as (select * from predictions where margin_db is not null), c as (select quantile_cont(margin_db, 0.2) a, quantile_cont(mc_std, 0.8) b from d)
select {R('avg((margin_db <= a and mc_std >= b)::double)')} as both, {R('avg((margin_db <= a and mc_std < b)::double)')} as physics_only, {R('avg((margin_db > a and mc_std >= b)::double)')} as learned_only, {R('avg((margin_db > a and mc_std < b)::double)')} as neither from d, c""".replace(" as both", ' as "both"'))
def signal_overlap(v: Views) -> DataFrame:
    return rounded(survey.discordance(v.predictions))


@query(f"select a.arm, {R('avg(a.score)')} as mean, {R('stddev_samp(a.score)')} as sd, {R('avg(a.score - b.score)')} as delta, count(b.score) as shared from runs a left join runs b on b.arm = '3-MEDIUM' and b.seed = a.seed group by a.arm")
def paired_summary(v: Views) -> DataFrame:
    return rounded(survey.paired_summary(v.runs, "3-MEDIUM"))


@query(f"""with x as (select film, severity, max({VERDICT}) as verdict from predictions group by all)
select a.film, b.severity, a.verdict as baseline, b.verdict as arm from x a join x b using (film) where a.severity = 0 and b.severity > 0 and a.verdict <> b.verdict""")
def verdict_flips(v: Views) -> DataFrame:
    x = v.predictions.groupBy("film", "severity").agg(F.max(selective.verdict(F.col("margin_db"))).alias("verdict"))
    base = x.where("severity = 0").select("film", F.col("verdict").alias("baseline"))
    return base.join(x.where("severity > 0"), "film").where("baseline <> verdict").select("film", "severity", "baseline", F.col("verdict").alias("arm"))


@query(f"with m as (select clinic, severity, quantile_cont(mc_std, 0.5) as m from predictions where mc_std > 0 group by all) select count(*) as groups, {R('min(m)')} as least, {R('max(m)')} as most, {R('max(m) / min(m)')} as spread, max(m) / min(m) <= 2 as passes from m")
def falsification_gate(v: Views) -> DataFrame:
    return rounded(survey.falsification_gate(v.predictions, "mc_std", "clinic", "severity"))


@query(f"with m as (select clinic, quantile_cont(margin_db, 0.5) as median, count(margin_db) as n from predictions group by clinic) select clinic, {R('median')} as median, n, {R('quantile_cont(abs(margin_db - median), 0.5)')} as mad from predictions join m using (clinic) group by clinic, median, n")
def recovery_mad(v: Views) -> DataFrame:
    return rounded(survey.median_and_spread(v.predictions, "margin_db", "clinic"))


@query(f"select clinic, count(*) filter (margin_db >= 0 and label = 1) as both_detect, count(*) filter (margin_db >= 0 and label = 0) as only_predicted, count(*) filter (margin_db < 0 and label = 1) as only_observed, count(*) filter (margin_db < 0 and label = 0) as neither, count(*) filter (margin_db >= 3 and logit <= -2) as violations from predictions group by clinic")
def disc_confusion(v: Views) -> DataFrame:
    m, y = F.col("margin_db"), F.col("label")
    return v.predictions.groupBy("clinic").agg(F.count_if((m >= 0) & (y == 1)).alias("both_detect"), F.count_if((m >= 0) & (y == 0)).alias("only_predicted"), F.count_if((m < 0) & (y == 1)).alias("only_observed"), F.count_if((m < 0) & (y == 0)).alias("neither"), F.count_if((m >= 3) & (F.col("logit") <= -2)).alias("violations"))


@query(f"with r as (select clinic, film, avg(mc_std) m, stddev_samp(mc_std) s, count(*) n from predictions group by all) select clinic, {R('avg(m)')} as mean, {R('quantile_cont(s, 0.5)')} as reproducibility, cast(sum(n) as bigint) as n from r group by clinic")
def region_characterise(v: Views) -> DataFrame:
    r = v.predictions.groupBy("clinic", "film").agg(F.avg("mc_std").alias("m"), F.stddev_samp("mc_std").alias("s"), F.count("*").alias("n"))
    return rounded(quantiles.summary(r, ["clinic"], {"reproducibility": ("s", 0.5)}, F.avg("m").alias("mean"), F.sum("n").alias("n")))


@query(f"select film, count(*) as n, {R('avg(mc_std)')} as mean, arg_max(case_id, (mc_std, -case_id)) as worst_case, {R('corr(mc_std, logit)')} as corr from predictions group by film")
def worst_of_n(v: Views) -> DataFrame:
    return rounded(v.predictions.groupBy("film").agg(F.count("*").alias("n"), F.avg("mc_std").alias("mean"), (-F.max(F.struct("mc_std", (-F.col("case_id")).alias("c")))["c"]).alias("worst_case"), correlation("mc_std", "logit").alias("corr")))


@query(f"select film, {R('avg(prob)')} as mean, {R('stddev_samp(prob)')} as std, count(*) as members from predictions group by film")
def ensemble_mean_std(v: Views) -> DataFrame:
    return rounded(v.predictions.groupBy("film").agg(F.avg("prob").alias("mean"), F.stddev_samp("prob").alias("std"), F.count("*").alias("members")))


@query(f"with h as (select clinic, cast(floor(prob * 32) as int) as bin, count(*) as n from predictions group by all), d as (select *, sum(n) over w as w0, sum(n * bin) over w as s0, sum(n) over (partition by clinic) as wt, sum(n * bin) over (partition by clinic) as st from h window w as (partition by clinic order by bin)) select clinic, cast(arg_max(bin, (floor(w0 * (wt - w0) * (s0 / w0 - (st - s0) / (wt - w0)) * (s0 / w0 - (st - s0) / (wt - w0)) * 1000 + 0.5), -bin)) as int) as cut from d where w0 < wt group by clinic")
def otsu_threshold(v: Views) -> DataFrame:
    from assayer.operators.kernels import otsu

    h = v.predictions.groupBy("clinic", F.floor(F.col("prob") * 32).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return otsu(h, "clinic")


@query("select arm, seed, score from (select *, row_number() over (partition by arm order by score desc nulls last, seed) as r from runs) where r = 1")
def best_epoch(v: Views) -> DataFrame:
    from pyspark.sql import Window

    return v.runs.withColumn("r", F.row_number().over(Window.partitionBy("arm").orderBy(F.desc_nulls_last("score"), "seed"))).where("r = 1").select("arm", "seed", "score")


@query(f"with d as (select clinic, value, row_number() over (partition by clinic order by value) as r, count(*) over (partition by clinic) as n from readings) select clinic, {R('avg(value)')} as mean, {R('quantile_cont(value, 0.5)')} as median, {R('max(value) filter (r = greatest(cast(floor(n * 0.95) as bigint), 1))')} as p95, {R('min(value)')} as least, {R('max(value)')} as most from d group by clinic")
def latency_percentiles(v: Views) -> DataFrame:
    return rounded(survey.latency(v.readings, "value", "clinic"))


@query("with m as (select clinic, severity, avg(mc_std) as m from predictions group by all), d as (select clinic, m - lag(m) over (partition by clinic order by severity) as step from m) select clinic, coalesce(bool_and(step <= 1e-9), true) as falls from d group by clinic")
def monotone_check(v: Views) -> DataFrame:
    from pyspark.sql import Window

    m = v.predictions.groupBy("clinic", "severity").agg(F.avg("mc_std").alias("m"))
    d = m.withColumn("step", F.col("m") - F.lag("m").over(Window.partitionBy("clinic").orderBy("severity")))
    return d.groupBy("clinic").agg(F.coalesce(F.bool_and(F.col("step") <= 1e-9), F.lit(True)).alias("falls"))


@query(f"select case_id, {R('0.5 * log2(1 + pow(10, margin_db / 20) * pow(10, margin_db / 20))')} as bits from predictions where margin_db is not null")
def channel_capacity(v: Views) -> DataFrame:
    from assayer.operators.kernels import channel_capacity as bits

    return rounded(v.predictions.where("margin_db is not null").select("case_id", bits(F.expr("pow(10D, margin_db / 20)")).alias("bits")))


# Monitoring.

CUSUM = f"""with d as (select clinic, seq, value, sum(value - 0.2::double - 0.05::double) over w as u, sum(0.2::double - value - 0.05::double) over w as d from readings window w as (partition by clinic order by ts, seq rows unbounded preceding)),
h as (select clinic, seq, value, u - least(0, min(u) over w) as high, d - least(0, min(d) over w) as low from (select d.*, r.ts from d join readings r using (clinic, seq, value)) window w as (partition by clinic order by ts, seq rows unbounded preceding))
select clinic, seq, {R('value')} as value, {R('high')} as high, {R('low')} as low, high > 0.5 or low > 0.5 as alarm from h"""


@query(CUSUM)
def cusum_batch(v: Views) -> DataFrame:
    return rounded(monitor.cusum(v.readings, 0.2, 0.05, 0.5))


@query(f"""with p as (select film as case_id, row_number() over (partition by film order by case_id) as pass, prob from predictions),
d as (select case_id, count(*) over w as n, avg(prob) over w as mean, stddev_samp(prob) over w as sd from p window w as (partition by case_id order by pass rows unbounded preceding)),
z as (select *, case when coalesce(sd, 0) / sqrt(n) > 1e-12 then abs(mean - 0.5) / (sd / sqrt(n)) else 0 end as z from d),
g as (select case_id, min(n) filter (n >= 3 and z >= 1.96) as s, max(n) as l from z group by case_id)
select g.case_id, coalesce(s, l) as passes, {R('z.mean')} as mean, s is null as deferred from g join z on z.case_id = g.case_id and z.n = coalesce(s, l)""")
def sequential_stop(v: Views) -> DataFrame:
    from pyspark.sql import Window

    passes = v.predictions.select(F.col("film").alias("case_id"), F.row_number().over(Window.partitionBy("film").orderBy("case_id")).alias("pass"), "prob")
    return rounded(monitor.sequential_stop(passes))


@query(CUSUM)
def cusum_stream(v: Views) -> DataFrame:
    """The stream's rows once it has taken all that is there, from a folder of readings in the shared place."""
    from assayer.sources.tables import scratch

    base = scratch(v.spark, "stream")
    v.readings.write.parquet(f"{base}/in")
    rows = v.spark.readStream.schema(v.readings.schema).parquet(f"{base}/in")
    q = monitor.cusum_stream(rows, 0.2, 0.05, 0.5).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return rounded(v.spark.read.parquet(f"{base}/out"))


def bootstrap_sql(rows: str, by: str = "") -> str:
    """The interval over rows (by, x, film, label): draws by digits of digests, as the operator takes them."""
    keys = f"{by}, " if by else ""
    u = "(cast('0x' || substr(md5('1|' || film || '|' || (b // 8)), (b % 8) * 4 + 1, 4) as int) + 0.5::double) / 65536"
    count = " + ".join(f"({u} > {p}::double)::int" for p in (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582))
    q = lambda p: R(f"case when count(auc) >= 20 then quantile_cont(auc, {p}) end")
    return f"""with rows as ({rows}), c as (select {keys}x, film, (count(*) filter (label = 1))::double as p, (count(*) filter (label = 0))::double as n from rows group by all),
w as (select film, b, {count} as w from (select distinct film from rows), range(200) t(b)),
j as (select {keys}b, x, sum(w * p) as p, sum(w * n) as n from c join w using (film) group by all),
k as (select {keys}b, p, n, coalesce(sum(n) over (partition by {keys}b order by x rows between unbounded preceding and 1 preceding), 0) as below from j),
a as (select {keys}b, sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) as auc from k group by all)
select {keys}{q(0.025)} as low, {q(0.5)} as median, {q(0.975)} as high, count(auc) as draws from a {f'group by {by}' if by else ''}"""


@query(bootstrap_sql("select prob as x, film, label from predictions where prob is not null"))
def cluster_bootstrap(v: Views) -> DataFrame:
    from assayer.operators.montecarlo import cluster_bootstrap as interval

    return rounded(interval(v.predictions, "prob", "film"))


SIGNALS = {"learned": "prob", "margin": "-margin_db", "uncertainty": "mc_std"}


@query(bootstrap_sql(" union all ".join(f"select '{n}' as signal, {x} as x, film, label from predictions where {x} is not null" for n, x in SIGNALS.items()), "signal"))
def signal_intervals(v: Views) -> DataFrame:
    """Each signal's interval over films, signed so that more of it speaks for a referral."""
    from assayer.operators.montecarlo import cluster_bootstrap as interval

    each = F.array(*(F.struct(F.lit(n).alias("signal"), F.expr(x).alias("x")) for n, x in SIGNALS.items()))
    return rounded(interval(v.predictions.select("film", "label", F.inline(each)), "x", "film", by=["signal"]))


@query("""with s as (select film, count(*) as n, count(*) filter (label = 1) as positives from predictions group by film),
m as (select least(5, count(*) filter (positives > 0), count(*) filter (positives < n), sum(positives), sum(n - positives))::int as k from s),
r as (select *, positives > 0 as kind, row_number() over (partition by positives > 0 order by n desc, ('0x' || substr(md5(film::varchar), 1, 12))::bigint) - 1 as place from s),
f as (select *, case when place % (2 * k) < k then place % (2 * k) else 2 * k - 1 - place % (2 * k) end as there from r, m)
select film, case when k >= 2 then (case when kind then there else k - 1 - there end)::int end as fold, n, positives from f""")
def fold_table(v: Views) -> DataFrame:
    from assayer.operators.montecarlo import stratified_folds

    return stratified_folds(v.predictions, "film", "label")


@query()
def balanced_assignment(v: Views) -> DataFrame:
    from assayer.operators.montecarlo import assigned

    return assigned(v.predictions.select("film", F.concat_ws("|", "clinic", "severity").alias("cell")), "film", "cell", 5)


@query()
def source_confound(v: Views) -> DataFrame:
    from assayer.operators.montecarlo import source_confound as confound

    d = audit.capture_features(v.images).withColumn("label", (F.col("clinic") == "e0").cast("int"))
    return confound(d, ["mean", "std", "low", "high", "roughness"], "label")


@query()
def gaussian_blur_kernel(v: Views) -> DataFrame:
    from assayer.operators.kernels import blurred

    return blurred(v.images, 1.0)


@query()
def degrade_kernel(v: Views) -> DataFrame:
    from assayer.operators.kernels import degrade

    return degrade(v.images, 0.5)


# Contrasts, alignment and methods.


@query(f"""with f as (select id as case_id, cast(id % 20 + 1 as double) as size_mm, 0.8::double * (id % 5 + 1) / 5 as delta_rho from images)
select case_id, {R('2.0::double * 0.67::double / ln(10) * 0.19::double * delta_rho * (size_mm / 10)')} as delta_d,
  {R('sqrt(pow(1.2::double / sqrt(12) / 2.0, 2) + pow(0.33::double / sqrt(12) / 0.67, 2) + pow(0.058::double / sqrt(12) / 0.19, 2) + 0.01::double + pow(0.4::double, 2)) * 2.0::double * 0.67::double / ln(10) * 0.19::double * delta_rho * (size_mm / 10)')} as sigma from f""")
def finding_contrast(v: Views) -> DataFrame:
    from assayer.operators.physics import slab_contrast, slab_contrast_sigma

    d = v.images.select(F.col("id").alias("case_id"), F.expr("cast(id % 20 + 1 as double) as size_mm"), F.expr("0.8D * (id % 5 + 1) / 5 as delta_rho"))
    rho, size = F.col("delta_rho"), F.col("size_mm")
    return rounded(d.select("case_id", slab_contrast(rho, size).alias("delta_d"), slab_contrast_sigma(rho, rho * 0.1, size, size * 0.4).alias("sigma")))


@query(f"""with x as (select clinic, id, i, px[i]::double as x from images, range(1, 65) t(i)),
m as (select clinic, i, avg(x) as m from x group by all),
c as (select a.clinic, a.i, b.i as j, covar_samp(a.x, b.x) as c from x a join x b using (clinic, id) group by all),
mt as (select a.clinic as a, b.clinic as b, sum((a.m - b.m) * (a.m - b.m)) as t from m a join m b on a.i = b.i and a.clinic < b.clinic group by all),
ct as (select a.clinic as a, b.clinic as b, sum((a.c - b.c) * (a.c - b.c)) / (4 * 64 * 64) as t from c a join c b on a.i = b.i and a.j = b.j and a.clinic < b.clinic group by all)
select a as clinic_a, b as clinic_b, {R('mt.t + ct.t')} as distance from mt join ct using (a, b)""")
def coral_distance(v: Views) -> DataFrame:
    from assayer.operators.physics import coral

    return rounded(coral(v.images.select("clinic", F.col("px").alias("x"))))


METHODS = "m as (select case_id, label, prob, unnest([{'method': 'max_prob', 'conf': greatest(prob, 1 - prob)}, {'method': 'mc_dropout', 'conf': 1 - mc_std / 0.2::double}], recursive := true) from predictions)"


@query(f"""with {METHODS}, cuts as (select method, count(*) as total, unnest(list_distinct(quantile_cont(conf, [{', '.join(str(q) for q in selective.GRID)}]))) as threshold from m group by method),
curve as (select method, threshold, count(*) / any_value(total) as coverage, avg({RIGHT}::double) as accuracy from cuts join m using (method) where conf >= threshold - 1e-12 group by method, threshold),
s as (select method, (coverage - lag(coverage) over w) * ((1 - accuracy) + (1 - lag(accuracy) over w)) / 2 as step from curve window w as (partition by method order by coverage, threshold desc))
select method, {R('sum(step)')} as aurc from s group by method""")
def aurc_by_method(v: Views) -> DataFrame:
    each = F.array(F.struct(F.lit("max_prob").alias("method"), F.greatest("prob", 1 - F.col("prob")).alias("conf")), F.struct(F.lit("mc_dropout").alias("method"), (1 - F.col("mc_std") / 0.2).alias("conf")))
    d = v.predictions.select("case_id", "label", "prob", F.inline(each))
    return rounded(selective.aurc(selective.risk_coverage(d, "conf", "method"), "method"))
