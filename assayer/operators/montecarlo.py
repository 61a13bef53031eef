"""Resampling and simulation, spread over draws, and the balanced assignment of films to cells."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.scalars import ratio
from assayer.operators.matching import matched
from assayer.operators.ranking import dealt, group_rank
from assayer.sources.tables import written


#: Cumulative values of the Poisson distribution at mean 1, from 0 on: how often a draw takes a cluster.
POISSON = (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582)


#: The same for each uniform number of 16 bits.
TIMES = np.searchsorted(POISSON, (np.arange(1 << 16) + 0.5) / (1 << 16), "left").astype(np.uint8)


def drawn(clusters: list[str], draws: int, seed: int) -> np.ndarray:
    """A row for each cluster, how often each draw takes it: four digits of a digest are a draw's uniform number, eight draws share a digest."""
    ends, out = [f"|{i}".encode() for i in range(-(-draws // 8))], np.empty((len(clusters), draws), np.uint8)
    for at in range(0, len(clusters), 4096):
        heads = [f"{seed}|{c}".encode() for c in clusters[at : at + 4096]]
        digests = b"".join([hashlib.md5(h + e).digest() for h in heads for e in ends])
        out[at : at + 4096] = TIMES[np.frombuffer(digests, ">u2").reshape(len(heads), -1)[:, :draws]]
    return out


def draws_of(cluster: str, draws: int, seed: int) -> np.ndarray:
    """How often each draw takes a cluster."""
    return drawn([cluster], draws, seed)[0].astype(int)


#: Bytes of draws that a Python worker keeps from one stretch of scores to the next, as a cluster lies in many of them.
KEPT = 128 << 20
_kept: dict[tuple[int, int], tuple[dict[str, int], np.ndarray]] = {}


def weights_of(clusters: list[str], draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """drawn() of distinct clusters as a table and each one's row in it. Those that came before are not drawn again, as far as they are kept."""
    most = KEPT // draws
    if len(clusters) > most:
        return drawn(clusters, draws, seed), np.arange(len(clusters))
    if (draws, seed) not in _kept:
        _kept.clear()
        _kept[draws, seed] = {}, np.empty((most, draws), np.uint8)
    known, table = _kept[draws, seed]
    new = [c for c in clusters if c not in known]
    if len(known) + len(new) > most:
        known.clear()
        new = clusters
    first = len(known)
    table[first : first + len(new)] = drawn(new, draws, seed)
    known.update(zip(new, range(first, first + len(new))))
    return table, np.fromiter((known[c] for c in clusters), int, len(clusters))


def _stretch(draws: int, seed: int, by: list[str]):
    """A stretch of scores: for each draw the pairs in order within it, and its weights of either label."""

    def stretch(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, [("_x", "ascending")])
        rows = rows.take(order)
        x, p, n = (rows.column(c).to_numpy() for c in ("_x", "_p", "_n"))
        coded = rows.column("_cluster").combine_chunks().dictionary_encode()
        weights, at = weights_of(coded.dictionary.to_pylist(), draws, seed)
        place, below, parts = at[coded.indices.to_numpy()], np.zeros(draws), np.zeros((3, draws))
        ends = np.flatnonzero(np.append(x[1:] != x[:-1], True)) + 1
        first = 0
        while first < len(x):  # some thousand rows at a time, cut between scores
            last = int(ends[min(np.searchsorted(ends, first + 4096), len(ends) - 1)])
            own = weights[place[first:last]]
            starts = np.flatnonzero(np.append(True, x[first + 1 : last] != x[first : last - 1]))
            ps, ns = (np.add.reduceat(own * v[first:last, None], starts) for v in (p, n))
            lower = below + np.cumsum(ns, axis=0) - ns
            parts += [(ps * (lower + ns / 2)).sum(axis=0), ps.sum(axis=0), ns.sum(axis=0)]
            below, first = lower[-1] + ns[-1], last
        values = {c: [rows.column(c)[0].as_py()] for c in (*by, "_bucket")} | {c: [v.tolist()] for c, v in zip(("s", "p", "n"), parts)}
        return pa.table({c: pa.array(v, rows.schema.field(c).type if c in rows.schema.names and c not in "spn" else pa.list_(pa.float64())) for c, v in values.items()})

    return stretch


def cluster_bootstrap(df: DataFrame, score: str, cluster: str, draws: int = 200, seed: int = 1, least: int = 20, by: list[str] | None = None) -> DataFrame:
    """An AUC's 95 % interval from clusters drawn with replacement, for each of `by`: each draw weighs clusters by Poisson counts from digests.

    Rows are counted by (score, cluster) and shuffled once, by stretches of the score; a stretch carries all draws as vectors,
    and gives its pairs in order and its weights for each. Fewer than `least` draws with both labels give no interval.
    """
    by = list(by or [])
    positive, negative = (F.count_if(F.col("label") == y).cast("double") for y in (1, 0))
    counted = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("_x"), F.coalesce(F.col(cluster).cast("string"), F.lit("")).alias("_cluster")).agg(positive.alias("_p"), negative.alias("_n"))
    each = dealt(counted, "_x").withColumn("_bucket", F.col("_bucket").cast("int"))
    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)
    parts = each.groupBy(*by, "_bucket").applyInArrow(_stretch(draws, seed, by), f"{kinds}_bucket int, s array<double>, p array<double>, n array<double>")
    drawn = parts.select(*by, "_bucket", F.posexplode(F.arrays_zip("s", "p", "n")).alias("draw", "v")).select(*by, "_bucket", "draw", "v.*")
    before = Window.partitionBy(*by, "draw").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(before), F.lit(0.0))
    auc = drawn.withColumn("below", below).groupBy(*by, "draw").agg(ratio(F.sum(F.col("s") + F.col("p") * F.col("below")), F.sum("p") * F.sum("n")).alias("auc"))
    enough = F.count("auc") >= least
    return auc.groupBy(*by).agg(*(F.when(enough, F.percentile("auc", q)).alias(n) for n, q in (("low", 0.025), ("median", 0.5), ("high", 0.975))), F.count("auc").alias("draws"))


def stratified_folds(df: DataFrame, group: str, label: str, folds: int = 5) -> DataFrame:
    """(group, fold, n, positives): groups kept whole, dealt largest first, there and back over the folds, those with and without positives apart.

    Fold sizes differ by no more than one group of either kind. There are no more folds than groups of the rarer kind, or, where
    each group holds both labels, than rows of the rarer label; with fewer than two, fold is null.
    """
    sizes = df.where(F.col(label).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("positives"))
    with_, without = F.count_if(F.col("positives") > 0), F.count_if(F.col("positives") < F.col("n"))
    most = sizes.agg(F.least(F.lit(folds), with_, without, F.sum("positives"), F.sum(F.col("n") - F.col("positives"))).cast("int").alias("_folds"))
    tie = F.conv(F.substring(F.md5(F.coalesce(F.col(group).cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")
    rows = sizes.withColumns({"_kind": F.col("positives") > 0, "_size": -F.col("n"), "_tie": tie})
    ranked = group_rank(rows, ["_kind"], "_size", "_tie", "_rank").crossJoin(F.broadcast(most))
    k, at = F.col("_folds"), F.col("_rank") - 1
    there = F.pmod(at, 2 * k)
    fold = F.when(there < k, there).otherwise(2 * k - 1 - there)
    # Groups without positives begin at the other end, where the last of those with some were not dealt.
    fold = F.when(F.col("_kind"), fold).otherwise(k - 1 - fold)
    return ranked.select(group, F.when(k >= 2, fold).cast("int").alias("fold"), "n", "positives")


def balanced_assignment(edges: list[tuple[str, str]], per_cell: int) -> dict[str, str]:
    """Each film to at most one of its cells, cells filled level by level along augmenting paths."""
    cells: dict[str, list[str]] = {}
    for film, cell in sorted(edges):
        cells.setdefault(cell, []).append(film)
    owner: dict[str, str] = {}

    def place(cell: str) -> None:
        seen: set[str] = set()
        stack, path = [(cell, iter(cells[cell]))], []
        while stack:
            film = next((x for x in stack[-1][1] if x not in seen), None)
            if film is None:
                stack.pop()
                del path[-1:]
                continue
            seen.add(film)
            path.append(film)
            if film not in owner:
                owner.update((x, c) for x, (c, _) in zip(path, stack))
                return
            stack.append((owner[film], iter(cells[owner[film]])))

    for _ in range(per_cell):
        for cell in sorted(cells):
            place(cell)
    return owner


#: Edges that the driver may hold for the search over few cells.
FEW_EDGES = 1_000_000


def assigned(df: DataFrame, film: str, cell: str, per_cell: int) -> DataFrame:
    """The drawn design of (film, cell) over all rows: as many films as can be, cells filled level by level.

    At most cells * per_cell films are drawn, so among a cell's first films of that number one is free whenever the
    search asks for the next: it never reads beyond them, and the design is that of all edges. Where cells are so many that
    these are too much for the driver, the search goes by joins (matching.matched), and gives each level as many films.
    """
    edges = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in (film, cell))).distinct()
    cells = edges.select(cell).distinct().count()
    if cells * cells * per_cell > FEW_EDGES:
        return matched(edges, film, cell, per_cell)
    rank = F.row_number().over(Window.partitionBy(cell).orderBy(film))
    first = edges.withColumn("_rank", rank).where(F.col("_rank") <= cells * per_cell).select(film, cell).collect()
    drawn = sorted(balanced_assignment([tuple(r) for r in first], per_cell).items())
    return df.sparkSession.createDataFrame(drawn, f"{film} string, {cell} string")


def _sums(columns: list[str], label: str, folds: int, weights: np.ndarray, mean: np.ndarray, spread: np.ndarray):
    """Each fold's part of every other fold's Newton step: X'WX and X'(p - y), a few numbers a partition."""

    def sums(batches):
        k = len(columns) + 1
        h, g = np.zeros((folds, k, k)), np.zeros((folds, k))
        for pdf in batches:
            x, y, fold = pdf[columns].to_numpy(float), pdf[label].to_numpy(float), pdf["fold"].to_numpy()
            for left in range(folds):
                z = np.hstack([(x - mean[left]) / spread[left], np.ones((len(x), 1))])[fold != left]
                p = 1 / (1 + np.exp(-np.clip(z @ weights[left], -30, 30)))
                h[left] += (z.T * (p * (1 - p))) @ z
                g[left] += z.T @ (p - y[fold != left])
        for left in range(folds):
            yield pd.DataFrame({"left": left, "at": np.arange(k * k + k), "x": np.r_[h[left].ravel(), g[left]]})

    return sums


def out_of_fold(features: DataFrame, columns: list[str], label: str, folds: int = 5, steps: int = 12, by: str = "id") -> tuple[DataFrame, np.ndarray]:
    """(fold, label, prob) where each fold's rows are judged by a logistic regression on the others, and the coefficients by fold.

    Folds are stratified_folds() of `by`: its rows stay together. Without two folds nothing is judged: no rows. Each Newton
    step is one pass, in which partitions give sums only.
    """
    dealt_out = written(stratified_folds(features, by, label, folds), "folds").where("fold is not null")
    folds = (dealt_out.agg(F.max("fold")).first()[0] or 0) + 1
    met = features.join(dealt_out.select(F.col(by).alias("_by"), "fold"), F.col(by).eqNullSafe(F.col("_by")))
    d = met.where(F.col(label).isNotNull()).select("fold", F.col(label).cast("double").alias(label), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    by_fold = d.groupBy("fold").agg(F.count("*").alias("n"), *(f(F.col(c) ** k).alias(f"{c}{k}") for c in columns for f, k in ((F.sum, 1), (F.sum, 2)))).collect()
    k = len(columns) + 1
    weights, mean, spread = np.zeros((folds, k)), np.zeros((folds, k - 1)), np.ones((folds, k - 1))
    for left in range(folds):
        rest = [r for r in by_fold if r["fold"] != left]
        n = max(1, sum(r["n"] for r in rest))
        mean[left] = [sum(r[f"{c}1"] for r in rest) / n for c in columns]
        spread[left] = [max(0.0, sum(r[f"{c}2"] for r in rest) / n - m * m) ** 0.5 or 1.0 for c, m in zip(columns, mean[left])]
    for _ in range(steps):
        rows = d.mapInPandas(_sums(columns, label, folds, weights, mean, spread), "left int, at int, x double").groupBy("left", "at").agg(F.sum("x").alias("x")).collect()
        found = np.zeros((folds, k * k + k))
        for r in rows:
            found[r["left"], r["at"]] = r["x"]
        step = np.stack([np.linalg.solve(x[: k * k].reshape(k, k) + np.eye(k), x[k * k :] + w) for x, w in zip(found, weights)])
        weights = weights - step
        if np.abs(step).max() < 1e-9:
            break

    z = F.lit(0.0)
    for left in range(folds):
        own = F.lit(float(weights[left][-1]))
        for c, w, m, s in zip(columns, weights[left], mean[left], spread[left]):
            own = own + F.lit(float(w)) * (F.col(c) - float(m)) / float(s)
        z = F.when(F.col("fold") == left, own).otherwise(z)
    said = d.select("fold", F.col(label).alias("label"), (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("prob"))
    return said, weights[:, :-1]


def source_confound(features: DataFrame, columns: list[str], label: str, folds: int = 5, by: str = "id") -> DataFrame:
    """How well capture features alone tell the label: the AUC out of fold, a verdict, and each standardised coefficient's mean over folds."""
    from assayer.operators.metrics import roc_auc

    said, weights = out_of_fold(features, columns, label, folds, by=by)
    separation = F.abs(F.col("auc") - 0.5) + 0.5
    verdict = F.when(separation >= 0.8, "confounded").when(separation >= 0.65, "suspect").otherwise("clean")
    coefficients = F.array(*(F.lit(float(x)) for x in weights.mean(axis=0)))
    return roc_auc(said.withColumn("group", F.lit("all")), "group").select("auc", verdict.alias("verdict"), coefficients.alias("coefficients"))
