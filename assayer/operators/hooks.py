"""Places for a user's own code: metrics that merge, table functions, and models that score.

A metric is four functions over a state of numbers; its states are made within tasks and merged in a tree, so none holds a
group. Table functions are called from SQL with TABLE(...) PARTITION BY ... ORDER BY .... A model is loaded once a worker
and must give logit, features and uncertainty for each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, LongType, StructType

#: States that one task merges, and groups that a task keeps before it lets their states go.
FAN, GROUPS = 64, 4096


@dataclass(frozen=True)
class Metric:
    """init() gives a state (an array of numbers), update(state, labels, probs) and merge(a, b) give new ones, finish(state) the figure."""

    init: Callable[[], np.ndarray]
    update: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], float | None]


def _log_loss(state: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-15, 1 - 1e-15)
    return state + [-np.where(y == 1, np.log(p), np.log1p(-p)).sum(), len(y)]


def _ece_bins(state: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums of confidence, of right answers and of rows in 15 bins of confidence from 0.5 to 1."""
    confidence, right = np.maximum(p, 1 - p), (p >= 0.5) == (y == 1)
    at = np.clip(np.digitize(confidence, np.linspace(0.5, 1.0, 16)) - 1, 0, 14)
    return state + np.concatenate([np.bincount(at, w, 15) for w in (confidence, right.astype(float), np.ones(len(p)))])


def _ece(state: np.ndarray) -> float | None:
    confidence, right, n = state.reshape(3, 15)
    return float(np.abs(right - confidence).sum() / n.sum()) if n.sum() else None


LOG_LOSS = Metric(lambda: np.zeros(2), _log_loss, np.add, lambda s: float(s[0] / s[1]) if s[1] else None)
ECE = Metric(lambda: np.zeros(45), _ece_bins, np.add, _ece)


def grouped_metrics(df: DataFrame, metrics: dict[str, Metric], by: str, label: str = "label", prob: str = "prob") -> DataFrame:
    """by and each metric of its rows' labels and probs; rows where either is null are left out."""
    names = list(metrics)
    kind = df.schema[by].dataType.simpleString()
    states = f"{by} {kind}, slot long, {', '.join(f'{n} array<double>' for n in names)}"

    def made(held: dict, slot: int) -> pd.DataFrame:
        return pd.DataFrame([(k, slot + i, *(s[n].tolist() for n in names)) for i, (k, s) in enumerate(held.items())], columns=[by, "slot", *names])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        slot, held = TaskContext.get().partitionId() << 32, {}
        for d in batches:
            for key, rows in d.groupby(by, dropna=False):
                state = held.setdefault(None if pd.isna(key) else key, {n: m.init() for n, m in metrics.items()})
                y, p = rows[label].to_numpy(float), rows[prob].to_numpy(float)
                for n, m in metrics.items():
                    state[n] = np.asarray(m.update(state[n], y, p), float)
            if len(held) > GROUPS:
                yield made(held, slot)
                slot, held = slot + len(held), {}
        if held:
            yield made(held, slot)

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        out = {n: np.asarray(first[n], float) for n in names}
        for i in range(1, len(rows)):
            out = {n: np.asarray(metrics[n].merge(out[n], np.asarray(rows[n].iloc[i], float)), float) for n in names}
        return pd.DataFrame([(first[by], first["slot"], *(out[n].tolist() for n in names))], columns=[by, "slot", *names])

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield pd.DataFrame({by: d[by], **{n: [metrics[n].finish(np.asarray(s, float)) for s in d[n]] for n in names}})

    from assayer.sources.tables import written

    rows = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull()).select(by, F.col(label).cast("double").alias(label), F.col(prob).cast("double").alias(prob))
    now = written(rows.mapInPandas(partial, states), "states")
    while (now.groupBy(by).count().agg(F.max("count")).first()[0] or 0) > 1:
        # At most about FAN states of a group meet in one task, so many times over as it takes.
        parts = F.ceil(F.count("*") / FAN).cast("long").alias("parts")
        sizes = now.groupBy(F.col(by).alias("_by")).agg(parts)
        dealt = now.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).withColumn("slot", F.pmod(F.xxhash64("slot"), F.col("parts"))).select(by, "slot", *names)
        now = written(dealt.groupBy(by, "slot").applyInPandas(merged, states), "states")
    return now.mapInPandas(finished, f"{by} {kind}, " + ", ".join(f"{n} double" for n in names))


@udtf
class RiskCoverage:
    """TABLE(confidence, n, tp, tn, positives, threshold, total) PARTITION BY ... ORDER BY (confidence DESC, threshold NULLS FIRST): a row a threshold.

    Rows with a threshold mark where it lies; the others count cases of a confidence. What is kept is five sums.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or {"n", "tp", "tn", "positives", "threshold", "total"} - set(rows.dataType.names):
            raise ValueError("risk_coverage takes a table with n, tp, tn, positives, threshold and total")
        schema = StructType()
        for name in ("threshold", "coverage", "accuracy", "sensitivity", "specificity"):
            schema = schema.add(name, DoubleType())
        return AnalyzeResult(schema.add("n_kept", LongType()))

    def __init__(self):
        self.sums = np.zeros(4)

    def eval(self, row):
        if row["threshold"] is None:
            self.sums += [row["n"], row["tp"], row["tn"], row["positives"]]
            return
        n, tp, tn, positives = (float(x) for x in self.sums)
        share = lambda a, b: a / b if b else None
        yield row["threshold"], share(n, row["total"]), share(tp + tn, n), share(tp, positives), share(tn, n - positives), int(n)


@udtf(returnType="snr double, bits double")
class CapacityTable:
    """capacity_table(low_db, high_db, step_db): bits a pixel of a channel at each ratio of signal to noise."""

    def eval(self, low_db: float, high_db: float, step_db: float):
        for i in range(int(np.floor((high_db - low_db) / step_db + 1e-9)) + 1):
            snr = 10 ** ((low_db + i * step_db) / 20)
            yield snr, 0.5 * float(np.log2(1 + snr * snr))


def register_tables(spark: SparkSession) -> None:
    """Makes the table functions known to SQL as risk_coverage and capacity_table."""
    spark.udtf.register("risk_coverage", RiskCoverage)
    spark.udtf.register("capacity_table", CapacityTable)


def risk_coverage_rows(df: DataFrame, confidence: str, by: str) -> DataFrame:
    """The table that risk_coverage takes: cases counted by confidence, and a mark where each of 51 quantiles lies."""
    from assayer.operators.quantiles import summary
    from assayer.operators.selective import GRID

    said, is_ = F.col("prob") >= 0.5, F.col("label") == 1
    counted = df.groupBy(by, F.col(confidence).alias("confidence")).agg(F.count("*").alias("n"), F.count_if(said & is_).alias("tp"), F.count_if(~said & ~is_).alias("tn"), F.count_if(is_).alias("positives"))
    counted = counted.withColumns({"threshold": F.lit(None).cast("double"), "total": F.lit(None).cast("long")})
    marks = summary(df, [by], {"q": (confidence, GRID)}, F.count("*").alias("total")).select(by, "total", F.explode(F.array_distinct("q")).alias("threshold"))
    zero = F.lit(0).cast("long")
    marks = marks.select(by, (F.col("threshold") - 1e-12).alias("confidence"), *(zero.alias(c) for c in ("n", "tp", "tn", "positives")), "threshold", "total")
    return counted.unionByName(marks)


def scored(df: DataFrame, model_file: str, load: Callable[[str], Callable[[np.ndarray], dict[str, np.ndarray]]], column: str, features: int) -> DataFrame:
    """df with logit, features (so many) and uncertainty by a model: load(path) gives a function of a matrix, a row for each of `column`.

    The file goes to each executor once, and is loaded once by each worker's task. A model that gives other names, or another
    number of rows or features, is an error. A null input gives nulls.
    """
    spark = df.sparkSession
    spark.sparkContext.addFile(model_file)
    name = model_file.rstrip("/").rsplit("/", 1)[-1]

    @F.pandas_udf("logit double, features array<double>, uncertainty double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load(SparkFiles.get(name))
        for values in batches:
            there = values.notna().to_numpy()
            out = pd.DataFrame({"logit": np.full(len(values), np.nan), "features": [None] * len(values), "uncertainty": np.full(len(values), np.nan)})
            if there.any():
                x = np.stack([np.asarray(v, float) for v in values[there]])
                got = model(x)
                if set(got) != {"logit", "features", "uncertainty"}:
                    raise ValueError(f"a model gives logit, features and uncertainty, not {sorted(got)}")
                if np.shape(got["features"]) != (len(x), features) or any(np.shape(got[n]) != (len(x),) for n in ("logit", "uncertainty")):
                    raise ValueError(f"a model gives one logit, {features} features and one uncertainty a row")
                out.loc[there, "logit"], out.loc[there, "uncertainty"] = got["logit"], got["uncertainty"]
                out["features"] = pd.Series([None] * len(values), dtype=object)
                out.loc[there, "features"] = pd.Series(np.asarray(got["features"], float).tolist(), index=out.index[there])
            yield out

    made = df.withColumn("_s", score(F.col(column)))
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    return made.select(*df.columns, real("_s.logit").alias("logit"), F.col("_s.features").alias("features"), real("_s.uncertainty").alias("uncertainty"))


def linear_model(path: str) -> Callable[[np.ndarray], dict[str, np.ndarray]]:
    """A linear model from an .npz file of weights and bias: the first four inputs are its features, and it is unsure near 0."""
    with np.load(path) as f:
        weights, bias = f["weights"], float(f["bias"])

    def model(x: np.ndarray) -> dict[str, np.ndarray]:
        logit = x @ weights + bias
        return {"logit": logit, "features": x[:, :4], "uncertainty": 1 / (1 + np.abs(logit))}

    return model
