"""Quality by Bradley-Terry pairwise ranking: logistic loss on the feature differences of preference pairs, cut at a score quantile.

Each pair prefers a document labelled 1 to one labelled 0; the features are counts and shares over the whole text, made by
SQL functions. The learnt strength is cut at a quantile of the training documents' strengths, the one that best parts the
labels; score 0.3 lies at the cut.

A null text counts as empty; an empty text has all features 0; long texts count whole. Without labels of both kinds every
score is 0.5, and an empty table gives no rows. Rows of labels for one document are taken together, the lowest quality counts;
labels without a document, or of another quality than 0 and 1, are left out. Repeated rows and ties are scored alike, rows
without doc_id too. Of the quantiles that part the labels equally well the middle one is the cut. Other columns of docs, whatever
their names, are left out unless they are to be kept.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import bounded_sample, small, text_or_empty

#: Labelled documents used of each quality at most, pairs drawn, passes, weight of the squared coefficients.
SAMPLE_DOCS, PAIRS, STEPS, DECAY, SEED = 2500, 40_000, 400, 1e-4, 5
#: The score at the quantile.
CUT = 0.3

#: Names and SQL of the features of a text t of n characters with w words, of which d are distinct, and l lines.
FEATURES = {
    "words": "ln(1 + w)",
    "word_length": "least(20.0D, n / greatest(w, 1))",
    "symbols": "sqrt(regexp_count(t, '[#*$%&|<>]') / greatest(n, 1))",
    "bangs": "sqrt(regexp_count(t, '[!?]') / greatest(n, 1))",
    "capitals": "sqrt(regexp_count(t, '\\\\p{Lu}') / greatest(n, 1))",
    "digits": "sqrt(regexp_count(t, '[0-9]') / greatest(n, 1))",
    "distinct": "d / greatest(w, 1)",
    "distinct_by_length": "ln(1 + d) / greatest(ln(1 + w), 0.5D)",
    "words_a_line": "ln(1 + w / greatest(l, 1))",
    "stops": "least(1.0D, regexp_count(t, '[.]') / greatest(w, 1))",
}


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns named in keep, and the features f_<name>."""
    t = docs.select(*(F.col(c).alias(f"k_{c}") for c in keep), text_or_empty().alias("t"))
    kept = [f"k_{c}" for c in keep]
    parts = t.select(*kept, "t", F.expr("cast(length(t) as double) as n"), F.array_remove(F.split(F.lower("t"), r"[\x20\x09-\x0D]+"), "").alias("words"))
    sized = parts.select(*kept, "t", "n", F.expr("cast(size(words) as double) as w"), F.expr("cast(size(array_distinct(words)) as double) as d"), F.expr("cast(1 + regexp_count(t, '[\\n]') as double) as l"))
    return sized.select(*(F.col(f"k_{c}").alias(c) for c in keep), *(F.when(F.col("n") > 0, F.expr(sql)).otherwise(0.0).alias(f"f_{name}") for name, sql in FEATURES.items()))


def learn(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(weights, shift, cut): strength is x @ weights + shift, and its quantile that best parts the labels is cut."""
    rng = np.random.default_rng(SEED)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1.0
    z = (x - mean) / spread
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    diff = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, STEPS + 1):
        lost = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))
        g = -(diff * lost[:, None]).mean(axis=0) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    strength = z @ w
    # Errors of either label count alike at each quantile of the strengths.
    order = np.sort(strength)
    cuts = (order[1:] + order[:-1]) / 2
    low, high = np.sort(strength[bad]), np.sort(strength[good])
    errors = np.searchsorted(high, cuts) / len(high) + 1 - np.searchsorted(low, cuts) / len(low)
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return w / spread, -float((mean / spread) @ w), float(np.median(cuts[best]))


def score_sql(weights: np.ndarray, shift: float, cut: float) -> Column:
    total = F.lit(shift - cut + math.log(CUT / (1 - CUT)))
    for name, w in zip(FEATURES, weights):
        total = total + F.lit(float(w)) * F.col(f"f_{name}")
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), total))))


def quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """doc_id and score of each row of docs (doc_id, text), or the columns in keep and the score under `name`; learnt from labels (doc_id, quality) of docs."""
    keep = ["doc_id"] if keep is None else keep
    known = bounded_sample(labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", "quality", SAMPLE_DOCS)
    rows = sorted(tuple(r) for r in features(docs.select("doc_id", "text").join(small(known), "doc_id"), "doc_id", "quality").collect())
    y = np.array([r[1] for r in rows])
    if not {0, 1} <= set(y.tolist()):
        return docs.select(*keep, F.lit(0.5).alias(name))
    return features(docs, *keep).select(*keep, score_sql(*learn(np.array([r[2:] for r in rows], float), y)).alias(name))
