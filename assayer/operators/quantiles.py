"""Exact quantiles of groups of any size, for all groups, columns and ranks at once, without a task that holds a group.

Values become whole numbers in the same order (a double's sign, exponent and mantissa). A round counts them by their next DIGIT
bits, finds the bin of each rank by running sums, and goes on within these bins only: rows outside drop out, and what one task
sums over is at most 2**DIGIT bins. As soon as each bin that is left holds few rows, the last round counts whole values. Groups
that have few rows from the start are left to Spark's own exact percentile, whose buffer they bound.

Quantiles lie between the two ranks around (n - 1) * p by linear interpolation. Nulls are left out; NaN is the largest value;
a group without values has null. Groups may have null keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.sources.tables import written

DIGIT = 16
#: Rows of a group, or of a bin, that one task may count by whole values.
FEW = 120_000

Wanted = dict[str, tuple[Column | str, float | list[float]]]


def ordered(value: Column) -> Column:
    """A double as a long that compares alike, from its exponent and mantissa; exact, as powers of two are."""
    x = F.abs(value)
    # log2 may miss the exponent by one; the comparisons set that right.
    near = F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.log2(x)).cast("double")))
    low = F.when(F.pow(F.lit(2.0), near) > x, near - 1).when(F.pow(F.lit(2.0), near + 1) <= x, near + 1).otherwise(near)
    e = F.greatest(low, F.lit(-1022.0))
    normal = (e + 1022).cast("long") * (1 << 52) + (x / F.pow(F.lit(2.0), e) * float(1 << 52)).cast("long")
    size = F.when(x == 0, F.lit(0).cast("long")).when(x == float("inf"), F.lit(2047 << 52)).otherwise(normal)
    return F.when(F.isnan(value), F.lit((2047 << 52) + 1)).when(value < 0, -size).otherwise(size)


def _entries(df: DataFrame, by: list[str], wanted: Wanted) -> DataFrame:
    """A row (_g, _c, _v, _k) for each group, column and value."""
    column = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    each = F.array(*(F.struct(F.lit(i).alias("_c"), column(c).alias("_v")) for i, (c, _) in enumerate(wanted.values())))
    return df.select(group.alias("_g"), F.inline(each)).where("_v is not null").withColumn("_k", ordered(F.col("_v")))


def _bins(rows: DataFrame, shift: int) -> DataFrame:
    """(_g, _c, _p, _d, _n, _before, _v): rows by the bits above shift (_d) within those found so far (_p), and how many come before."""
    digit = F.shiftright("_k", shift) if shift else F.col("_k")
    counts = rows.groupBy("_g", "_c", "_p", digit.alias("_d")).agg(F.count("*").alias("_n"), F.min("_v").alias("_v"))
    before = F.sum("_n").over(Window.partitionBy("_g", "_c", "_p").orderBy("_d")) - F.col("_n")
    return counts.withColumn("_before", before)


def _found(bins: DataFrame, ranks: DataFrame) -> DataFrame:
    """ranks (_g, _c, _rank, _p, _r) with the bin of each: _p becomes its bits, _r the rank within, _n its rows."""
    met = bins.join(ranks.select("_g", "_c", "_rank", "_p", "_r"), ["_g", "_c", "_p"]).where("_r > _before and _r <= _before + _n")
    return met.select("_g", "_c", "_rank", F.col("_d").alias("_p"), (F.col("_r") - F.col("_before")).alias("_r"), "_n", "_v")


def selected(entries: DataFrame, ranks: DataFrame) -> DataFrame:
    """(_g, _c, _rank, _v): the values at ranks (_g, _c, _rank), counted from 1, among entries (_g, _c, _v, _k)."""
    ranks = ranks.select("_g", "_c", "_rank", F.lit(0).cast("long").alias("_p"), F.col("_rank").alias("_r"))
    rows, shift = entries.withColumn("_p", F.lit(0).cast("long")), 64 - DIGIT
    while True:
        ranks = written(_found(_bins(rows, shift), ranks), "ranks")
        most = ranks.agg(F.max("_n")).first()[0]
        if not shift or most is None:
            return ranks.select("_g", "_c", "_rank", "_v")
        rows = entries.join(ranks.select("_g", "_c", "_p").distinct(), (F.col("_p") == F.shiftright("_k", shift)) & (ranks["_g"] == entries["_g"]) & (ranks["_c"] == entries["_c"])).select(entries["_g"], entries["_c"], "_v", "_k", "_p")
        shift = 0 if most <= FEW else max(0, shift - DIGIT)


def _probs(p: float | list[float]) -> list[float]:
    return list(p) if isinstance(p, list) else [p]


def _selected_quantiles(df: DataFrame, by: list[str], wanted: Wanted) -> DataFrame:
    entries = _entries(df, by, wanted)
    sizes = written(entries.groupBy("_g", "_c").agg(F.count("*").alias("_size")), "sizes")
    probs = F.lit(None).cast("array<double>")
    for i, (_, p) in enumerate(wanted.values()):
        probs = F.when(F.col("_c") == i, F.array(*(F.lit(float(x)) for x in _probs(p)))).otherwise(probs)
    at = sizes.select("_g", "_c", F.posexplode(F.transform(probs, lambda p: p * (F.col("_size") - 1))).alias("_i", "_at"))
    ranks = at.select("_g", "_c", F.explode(F.array(F.floor("_at") + 1, F.ceil("_at") + 1)).alias("_rank")).distinct()
    values = selected(entries, ranks).select(F.col("_g").alias("_h"), F.col("_c").alias("_e"), "_rank", "_v")
    low, high = (values.select("_h", "_e", F.col("_rank").alias(f"_{n}"), F.col("_v").alias(n)) for n in ("low", "high"))
    same = (F.col("_g") == F.col("_h")) & (F.col("_c") == F.col("_e"))
    met = at.join(low, same & (F.col("_low") == F.floor("_at") + 1)).drop("_h", "_e").join(high, same & (F.col("_high") == F.ceil("_at") + 1))
    # Equal values are not weighed, which might miss them by a bit.
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.col("_high") - 1 - F.col("_at")) * F.col("low") + (F.col("_at") - F.col("_low") + 1) * F.col("high"))
    each = met.select("_g", "_c", F.struct("_i", between.alias("q")).alias("x")).groupBy("_g", "_c").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["q"]).alias("_q"))
    columns = [F.first(F.when(F.col("_c") == i, F.col("_q") if isinstance(p, list) else F.col("_q")[0]), True).alias(n) for i, (n, (_, p)) in enumerate(wanted.items())]
    return each.groupBy("_g").agg(*columns)


def summary(df: DataFrame, by: list[str], wanted: Wanted, *aggs: Column) -> DataFrame:
    """One row a group of df: by, the aggregates, and under each name of wanted its column's exact quantile, or list of them."""
    own = [F.percentile(c if isinstance(c, Column) else F.col(c), _list(p)).alias(n) for n, (c, p) in wanted.items()]
    groups = df.groupBy(*by).agg(F.count("*").alias("_rows"))
    if (groups.agg(F.max("_rows")).first()[0] or 0) <= FEW:
        return df.groupBy(*by).agg(*aggs, *own)
    found = _selected_quantiles(df, by, wanted)
    rest = df.groupBy(*by).agg(*aggs, F.count("*").alias("_rows"))
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    kept = [c for c in rest.columns if c != "_rows"]
    return rest.withColumn("_g", key).join(found.withColumnRenamed("_g", "_h"), F.col("_g") == F.col("_h"), "left").select(*kept, *wanted)


def _list(p: float | list[float]) -> Column | float:
    return F.array(*(F.lit(float(x)) for x in p)) if isinstance(p, list) else p


def quantiles(df: DataFrame, by: list[str], wanted: Wanted) -> DataFrame:
    """by and the quantiles of wanted: {name: (column, p or list of p)}."""
    return summary(df, by, wanted)
