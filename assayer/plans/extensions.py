"""Registered queries through a user's own code: metrics that merge, table functions called from SQL, a model that scores."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import hooks
from assayer.plans.catalogue import BINNED, CURVE, R, rounded
from assayer.plans.views import Views
from assayer.registry import query
from assayer.sources.tables import scratch


@query(f"""with {BINNED}, b as (select clinic, bin, avg(conf) c, avg(correct) a, count(*) n from binned group by all), e as (select clinic, sum(n * abs(a - c)) / sum(n) as ece from b group by clinic),
l as (select clinic, avg(-case when label = 1 then ln(greatest(1e-15, least(1 - 1e-15, prob))) else ln(1 - greatest(1e-15, least(1 - 1e-15, prob))) end) as log_loss from predictions group by clinic)
select clinic, {R('log_loss')} as log_loss, {R('ece')} as ece from l join e using (clinic)""")
def merged_metrics(v: Views) -> DataFrame:
    return rounded(hooks.grouped_metrics(v.predictions, {"log_loss": hooks.LOG_LOSS, "ece": hooks.ECE}, "clinic"))


@query(f"with {CURVE} select {R('threshold')} as threshold, {R('coverage')} as coverage, {R('accuracy')} as accuracy, {R('sensitivity')} as sensitivity, {R('specificity')} as specificity, n_kept from curve")
def risk_coverage_function(v: Views) -> DataFrame:
    """All clinics' curves by the table function, called from SQL."""
    hooks.register_tables(v.spark)
    rows = hooks.risk_coverage_rows(v.predictions.withColumn("conf", F.greatest("prob", 1 - F.col("prob"))), "conf", "clinic")
    return rounded(v.spark.sql("select * from risk_coverage(TABLE({rows}) PARTITION BY clinic ORDER BY (confidence DESC, threshold NULLS FIRST))", rows=rows))


#: Weights of the linear model that scores vectors.
WEIGHTS = [((i * 37) % 11 - 5) / 10 for i in range(64)]
BIAS = 0.25


@query(f"""with s as (select vec_id, embedding, {BIAS}::double + list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * [{', '.join(f'{w!r}::double' for w in WEIGHTS)}][i])) as logit from embeddings)
select vec_id, {R('logit')} as logit, {R('embedding[1]::double')} as f0, {R('embedding[4]::double')} as f3, {R('1 / (1 + abs(logit))')} as uncertainty from s""")
def linear_scores(v: Views) -> DataFrame:
    """Vectors scored by a model that lies as a file in the shared place."""
    data = io.BytesIO()
    np.savez(data, weights=np.array(WEIGHTS), bias=BIAS)
    path = f"{scratch(v.spark, 'model')}.npz"
    target = v.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(v.spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    rows = hooks.scored(v.table("embeddings").select("vec_id", "embedding"), path, hooks.linear_model, "embedding", 4)
    return rounded(rows.select("vec_id", "logit", F.col("features")[0].alias("f0"), F.col("features")[3].alias("f3"), "uncertainty"))
