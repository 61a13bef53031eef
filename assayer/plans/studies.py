"""Registered queries of the reader study's read-out, sheets, keys, arms and the archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import imaging, study
from assayer.plans.catalogue import R, rounded
from assayer.plans.views import Views
from assayer.registry import query
from assayer.sources.catalogue import source_registry


def decided(v: Views) -> DataFrame:
    """What the model defers and what the label would refer, weighted by severity."""
    return v.predictions.select("clinic", (F.col("mc_std") > 0.12).alias("defers"), (F.col("label") == 1).alias("refers"), (1 + F.col("severity")).alias("w"))


@query(f"""with d as (select clinic, mc_std > 0.12::double as a, label = 1 as b, 1 + severity as w from predictions),
g as (select clinic, sum(w) as w, sum(w) filter (a = b) as same, sum(w) filter (a) as wa, sum(w) filter (b) as wb, sum(w) filter (a and b) as wab from d group by clinic),
s as (select clinic, w, coalesce(wa, 0) as wa, coalesce(wb, 0) as wb, coalesce(wab, 0) as wab, coalesce(same, 0) / w as po, coalesce(wa, 0) / w as pa, coalesce(wb, 0) / w as pb from g),
e as (select *, pa * pb + (1 - pa) * (1 - pb) as pe, 2 * ((pa + pb) / 2) * (1 - (pa + pb) / 2) as pg from s)
select clinic, {R('po')} as agreement, {R('pa')} as rate_a, {R('pb')} as rate_b, {R('(po - pe) / nullif(1 - pe, 0)')} as kappa, {R('(po - pg) / nullif(1 - pg, 0)')} as ac1,
  {R('wab / nullif(wb, 0)')} as caught, {R('(wb - wab) / nullif(wb, 0)')} as missed, {R('(wa - wab) / nullif(w - wb, 0)')} as needless from e""")
def policy_readout(v: Views) -> DataFrame:
    return rounded(study.weighted_agreement(decided(v), "defers", "refers", "w", "clinic"))


@query("select row_number() over (order by (c_custkey * 7919) % 1000003, c_custkey) as display_order, c_custkey as case_id, cast(null as int) as refer_1_to_5, '' as adequacy, '' as reason_code, '' as note from customer")
def blinded_sheet(v: Views) -> DataFrame:
    from assayer.operators.ranking import global_rank

    c = v.table("customer").select(F.col("c_custkey").alias("case_id"), "c_mktsegment", F.expr("(c_custkey * 7919L) % 1000003").alias("shuffled"))
    return study.rating_sheet(global_rank(c, "shuffled", "case_id", "display_order"))


@query("select * from (select 'label' as \"column\", count(distinct label) as n_distinct from predictions union all select 'one', 1) where n_distinct <= 1")
def constant_columns(v: Views) -> DataFrame:
    return study.constant_columns(v.predictions.select("label", "prob", "logit", F.lit(1).alias("one")))


@query("select path, string_split(string_split(path, '/')[-1], '__')[-1] as key from (select 'data/' || source || '/' || source || '__' || doc_id || '.png' as path from documents)")
def join_keys(v: Views) -> DataFrame:
    d = v.table("documents").select(F.expr("concat('data/', source, '/', source, '__', doc_id, '.png')").alias("path"))
    return d.select("path", study.join_key(F.col("path")).alias("key"))


@query(f"""select case_id, {R('0.25::double + 0.75::double * w')} as margin, {R('0.25::double + 0.75::double * (1 - w)')} as inverse
from (select case_id, coalesce(least(1, greatest(0, (margin_db + 12) / 24)), 0) as w from predictions)""")
def loss_weights(v: Views) -> DataFrame:
    m = F.col("margin_db")
    return rounded(v.predictions.select("case_id", study.loss_weight(m, "margin").alias("margin"), study.loss_weight(m, "inverse").alias("inverse")))


@query(f"""with a as (select case case_id % 4 when 0 then 'baseline' when 1 then 'wedge' when 2 then 'ruler' else 'oracle' end as arm, mc_std, abs(logit) as miss from predictions),
m as (select arm, quantile_cont(mc_std, 0.5) as mc_std, quantile_cont(miss, 0.5) as miss from a group by arm),
b as (select * from m where arm = 'baseline'), o as (select * from m where arm = 'oracle')
select m.arm, {R('m.mc_std - b.mc_std')} as d_mc_std, {R('case when abs(b.mc_std - o.mc_std) > 1e-9 then (b.mc_std - m.mc_std) / (b.mc_std - o.mc_std) end')} as closed_mc_std,
  {R('m.miss - b.miss')} as d_miss, {R('case when abs(b.miss - o.miss) > 1e-9 then (b.miss - m.miss) / (b.miss - o.miss) end')} as closed_miss from m, b, o where m.arm not in ('baseline', 'oracle')""")
def arms_against_baseline(v: Views) -> DataFrame:
    a = v.predictions.select(F.expr("case case_id % 4 when 0 then 'baseline' when 1 then 'wedge' when 2 then 'ruler' else 'oracle' end").alias("arm"), "mc_std", F.abs("logit").alias("miss"))
    return rounded(study.against(study.arm_summary(a, ["mc_std", "miss"], "arm"), ["mc_std", "miss"], "baseline", "oracle"))


@query("""select t.*, (select count(*) from manifest where clinic = t.key) as n_files from (values ('nitrd_da', 156, true, 'usable', 'both_classes|institution|licence|n_images'), ('nitrd_db', 150, true, 'usable', 'both_classes|institution|licence|n_images'),
('tbx11k', 11200, true, 'usable_with_caveats', 'institution'), ('vindr_cxr', 18000, true, 'usable_with_caveats', ''), ('padchest', 160000, true, 'usable_with_caveats', 'class_note'),
('kaggle_tb_aggregate', 4200, true, 'not_a_fold', 'class_note'), ('niaid_tbportals', 3000, false, 'not_a_fold', '')) t(key, n_images, both_classes, verdict, unverified)""")
def archive_registry(v: Views) -> DataFrame:
    """The archives, with the files of the manifest that come from each."""
    files = v.manifest.groupBy(F.col("clinic").alias("key")).agg(F.count("*").alias("n_files"))
    rows = source_registry(v.spark).select("key", "n_images", "both_classes", "verdict", F.array_join("unverified", "|").alias("unverified"))
    return rows.join(files, "key", "left").na.fill(0, ["n_files"])


@query()
def sheet_gates(v: Views) -> DataFrame:
    """The gates over photographed test sheets; `spread` is how far careful photographs (severity 0) differ by region."""
    ids = v.table("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.expr("(n_nationkey % 5) * 0.25D").alias("severity"))
    s = imaging.sheet_scores(ids)
    bad = F.size(F.filter("discs", lambda d: d["predicted"] & (20 * F.log10(d["delta_d"] / d["floor"]) >= 3) & (d["dprime"] <= 3.5))).cast("double")
    by_region = imaging.sheet_readings(ids.where("severity = 0")).groupBy("region").agg(F.stddev_samp("density").alias("sd"))
    spread = by_region.agg(F.percentile("sd", 0.5).alias("spread"))
    return study.recapture_gates(s.withColumns({"violations": bad, "discs_n": F.size("discs").cast("double")}).crossJoin(F.broadcast(spread)))
