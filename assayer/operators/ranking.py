"""Row numbers and running sums over whole tables and huge groups, without one task that sorts a group.

Rows are dealt into ordered buckets. Buckets are counted to give each its offset, and rows are numbered within a group's
bucket only. The figures are exact whatever the buckets: they only decide how evenly the rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets at least and at most; between them there are so many that each has about ROWS rows.
BUCKETS, MOST, ROWS = 256, 4096, 1 << 20


def _edges(column: str, name: str) -> Column:
    probs = ", ".join(f"{i / MOST}D" for i in range(1, MOST))
    return F.expr(f"percentile_approx({column}, array({probs}), {4 * MOST})").alias(name)


def _thinned(edges: str, rows: Column) -> Column:
    """Every so manieth edge, for the buckets that so many rows need."""
    buckets = F.least(F.lit(MOST), F.greatest(F.lit(BUCKETS), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(rows, F.lit(1)) / ROWS))).cast("int")))
    return F.filter(F.coalesce(edges, F.array().cast("array<double>")), lambda e, i: (i + 1) % (F.lit(MOST) / buckets).cast("int") == 0)


STEPS = (256, 16, 1)


def _coarser(edges: str) -> list[Column]:
    """The edges, each 16th and each 256th of them."""
    return [F.filter(edges, lambda e, i: (i + 1) % step == 0).alias(f"{edges}{step}") for step in STEPS]


def _below(edges: str, column: str) -> Column:
    """How many of the sorted edges are less than the value: by each 256th first, then between two by each 16th, then one by one. Nulls lie beyond all."""
    v, found = F.col(column).cast("double"), F.lit(0)
    for step in STEPS:
        near = F.slice(f"{edges}{step}", (found / step).cast("int") + 1, 16)
        found = found + step * F.size(F.filter(near, lambda e: e < v))
    return F.when(v.isNull(), MOST).otherwise(found)


def dealt(df: DataFrame, value: str, tie: str | None = None) -> DataFrame:
    """df with `_bucket`, ordered by (value, tie), nulls last, from approximate quantiles of all rows.

    Rows of a value that fills whole buckets, or without one, are dealt on by the quantiles of `tie`, a number, if there is one.
    """
    numbers = df.select(F.col(value).cast("double").alias("_v"), *([F.col(tie).cast("double").alias("_t")] if tie else []))
    edges = numbers.agg(F.count("*").alias("_n"), _edges("_v", "_e"), *([_edges("_t", "_f")] if tie else []))
    edges = edges.select(_thinned("_e", F.col("_n")).alias("_e"), *([_thinned("_f", F.col("_n")).alias("_f")] if tie else []))
    if tie:
        full = F.array_distinct(F.filter("_e", lambda e, i: (i > 0) & (F.get("_e", i - 1) == e)))
        edges = edges.withColumn("_full", full).select(F.array_distinct("_e").alias("_e"), "_full", F.array_distinct("_f").alias("_f"))
    else:
        edges = edges.select(F.array_distinct("_e").alias("_e"))
    edges = edges.select(*_coarser("_e"), *([*_coarser("_f"), "_full"] if tie else []))
    inner = F.when(F.col(value).isNull() | F.array_contains("_full", F.col(value).cast("double")), 1 + _below("_f", tie)).otherwise(0) if tie else F.lit(0)
    return df.crossJoin(F.broadcast(edges)).withColumn("_bucket", _below("_e", value) * (MOST + 2) + inner).drop(*edges.columns)


def _offsets(rows: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """For each group and bucket: the sums before it, and the group's row count; over some hundred rows a group."""
    each = rows.groupBy(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_bucket").alias("_at")).agg(F.count("*").alias("_rows"), *(c.alias(n) for n, c in sums.items()))
    group = Window.partitionBy(*(f"_by_{c}" for c in by)) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*(f"_by_{c}" for c in by), "_at", F.sum("_rows").over(group).alias("_total"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums))


def _met(rows: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    same = F.col("_bucket") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(offsets, same).drop("_at", *(f"_by_{c}" for c in by))


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], name: str, total: str | None = None) -> DataFrame:
    """rows, which have `_bucket`, with each one's number in its group under `name`, and the group's size under `total`."""
    own = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    out = _met(rows, _offsets(rows, by), by).withColumn(name, (own + F.col("_before")).cast("long"))
    return (out.withColumn(total, F.col("_total")) if total else out).drop("_bucket", "_before", "_total")


def group_rank(df: DataFrame, by: list[str], value: str, tie: str | None, name: str, total: str | None = None) -> DataFrame:
    """df with the row number by (value, tie), nulls last, in each group; tie is a number."""
    return numbered(dealt(df, value, tie), by, [F.col(c).asc_nulls_last() for c in ([value, tie] if tie else [value])], name, total)


def global_rank(df: DataFrame, value: str, tie: str, name: str) -> DataFrame:
    """df with the row number by (value, tie), nulls last, under `name`."""
    return group_rank(df, [], value, tie, name)


def shuffled_rank(df: DataFrame, by: list[str], seed: int, key: str, name: str, total: str | None = None) -> DataFrame:
    """df with the row number by the md5 of seed and key in each group: the digest's first digits deal the rows evenly."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    rows = df.withColumn("_digest", digest).withColumn("_bucket", F.conv(F.substring("_digest", 1, 3), 16, 10).cast("int"))
    return numbered(rows, by, ["_digest", key], name, total).drop("_digest")


def average_ranks(df: DataFrame, by: list[str], value: str, weight: str, name: str) -> DataFrame:
    """(by, value, name): the mean rank of each distinct value, of which there are `weight` rows each time it occurs."""
    each = dealt(df.groupBy(*by, value).agg(F.sum(weight).alias("_w")), value)
    own = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    met = _met(each, _offsets(each, by, _less=F.sum("_w")), by)
    below = F.coalesce(F.sum("_w").over(own), F.lit(0)) + F.col("_less")
    return met.select(*by, value, (below + (F.col("_w") + 1) / 2.0).alias(name))
