"""Registered queries over invented photographs, one for each supplier; test sheets and aids likewise. Rows only: no SQL makes pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import imaging
from assayer.plans.views import Views
from assayer.registry import query


def ids(v: Views) -> DataFrame:
    return v.table("supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.expr("(s_suppkey % 5) * 0.25D").alias("severity"))


def photos(v: Views) -> DataFrame:
    return imaging.captures(ids(v))


@query()
def capture_simulation(v: Views) -> DataFrame:
    return photos(v).select("id", "severity", "true_blur", "true_veil", F.crc32("photo").alias("photo_crc32"))


@query()
def photo_degradations(v: Views) -> DataFrame:
    return imaging.degraded_photos(photos(v), 0.5).select("id", "ops", "total_severity", F.crc32("photo").alias("photo_crc32"))


@query()
def photo_features(v: Views) -> DataFrame:
    return imaging.photo_features(photos(v))


@query()
def photo_hashes(v: Views) -> DataFrame:
    return imaging.photo_hashes(photos(v))


@query()
def rehosted_distance(v: Views) -> DataFrame:
    return imaging.rehosted_distance(photos(v))


@query()
def fiducial_detection(v: Views) -> DataFrame:
    return imaging.fiducial_rows(photos(v))


@query()
def inversion(v: Views) -> DataFrame:
    """What was recovered beside what was true."""
    return imaging.recovery_rows(photos(v), keep="severity double, true_blur double, true_veil double")


@query()
def photo_certificates(v: Views) -> DataFrame:
    return imaging.certificates(photos(v))


@query()
def photo_triage(v: Views) -> DataFrame:
    """What to do with each photograph, from its certificate alone, and the dB that mending its causes would bring."""
    causes = {"veil": "glare", "veil_fit": "glare", "blur": "blur", "quantization": "exposure", "sensor_noise": "exposure"}
    table = F.create_map(*(F.lit(x) for kv in causes.items() for x in kv))
    c = imaging.certificates(photos(v)).withColumn("worst_finding", F.element_at(F.filter("findings", lambda f: f["key"] == F.col("worst")), 1))
    category = F.try_element_at(table, F.col("limiting"))
    share = F.aggregate(F.map_values(F.map_filter("worst_finding.shares", lambda k, _: F.try_element_at(table, k) == category)), F.lit(0.0), lambda s, x: s + x)
    gain = -20 * F.log10(F.greatest(1 - F.least(F.greatest(share, F.lit(0.0)), F.lit(0.95)), F.lit(0.05)))
    poor = F.col("verdict").isin("insufficient", "marginal")
    action = F.when(F.col("abstained"), "retake").when(poor & category.isNotNull(), "retake").when(poor, "refer").otherwise("report")
    return c.select("id", action.alias("action"), F.coalesce(F.col("reason"), F.when(poor, category)).alias("reason"), F.when(action == "retake", gain).alias("gain_db"), "verdict", "margin_db")


@query()
def channel_bits(v: Views) -> DataFrame:
    return imaging.channel_rows(photos(v))


@query()
def lightbox_aids(v: Views) -> DataFrame:
    return imaging.aid_rows(ids(v))


@query()
def sheet_scores(v: Views) -> DataFrame:
    return imaging.sheet_scores(v.table("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.expr("(n_nationkey % 5) * 0.25D").alias("severity")))


@query()
def sheet_confusion(v: Views) -> DataFrame:
    return imaging.disc_confusion(imaging.sheet_scores(v.table("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.expr("(n_nationkey % 5) * 0.25D").alias("severity"))))


@query("""with f as (select key, 2.0::double * 0.67::double / ln(10) * 0.19::double * rho * size_mm / 10 as delta_d, size_mm
from (values ('miliary_nodule', 1.06::double - 0.26::double, 2.0::double), ('small_nodule', 1.06::double - 0.26::double, 6.0::double), ('infiltrate', 0.5::double * (1.06::double - 0.26::double), 15.0::double),
('cavity_wall', 1.06::double - 0.001205::double, 3.4::double), ('consolidation', 1.06::double - 0.26::double, 45.0::double), ('pleural_effusion', 1.0::double - 0.26::double, 30.0::double), ('fibrotic_band', 1.06::double - 0.26::double, 5.0::double)) t(key, rho, size_mm)),
r as (select delta_d as ref from f where key = 'small_nodule')
select key, floor(delta_d * 1e6 + 0.5) / 1e6 as delta_d, size_mm, (select count(*) from predictions where margin_db + 20 * log10(delta_d / ref) >= 3) as n_shown from f, r""")
def finding_dimension(v: Views) -> DataFrame:
    """Each finding with the cases whose margin, which is that of a small nodule, would show it clearly."""
    f = imaging.finding_dimension(v.spark)
    ref = f.where("key = 'small_nodule'").select(F.col("delta_d").alias("ref"))
    # Seven rows.
    shown = v.predictions.select("margin_db").crossJoin(F.broadcast(f.crossJoin(ref))).where("margin_db + 20 * log10(delta_d / ref) >= 3").groupBy("key").agg(F.count("*").alias("n_shown"))
    return f.join(shown, "key", "left").select("key", F.expr("floor(delta_d * 1e6 + 0.5) / 1e6").alias("delta_d"), "size_mm", F.coalesce("n_shown", F.lit(0)).alias("n_shown"))
