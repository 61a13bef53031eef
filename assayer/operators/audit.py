"""Data audits: difference hashes, near-duplicate joins, overlap verdicts, confound cohorts, image statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import nearhash
from assayer.operators.nearhash import distinct_hashes, near_words
from assayer.operators.quantiles import summary
from assayer.operators.tiles import near_tiles
from assayer.sources.tables import written

SIDE = 8
BITS = SIDE * SIDE - 1


def difference_hash(images: DataFrame) -> DataFrame:
    """Bit i is set where pixel i + 1 is brighter than pixel i."""
    bits = " + ".join(f"shiftleft(cast(px[{i + 1}] > px[{i}] as bigint), {i})" for i in range(BITS))
    return images.select("id", "clinic", F.expr(bits).alias("hash"))


def _bands(bits: int, most: int) -> tuple[list[tuple[int, int]], int]:
    """(bands as (low, high) bits, bits in which near hashes may differ in one of them at least): bands of about 13 bits."""
    n = min(most + 1, max(1, round(bits / 13)))
    cuts = [round(i * bits / n) for i in range(n + 1)]
    return list(zip(cuts, cuts[1:])), most // n


def _flips(width: int, most: int) -> list[int]:
    """All masks of up to `most` of `width` bits."""
    return [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(width), k)]


def near_pairs(a: DataFrame, b: DataFrame, most: int, bits: int = BITS) -> DataFrame:
    """Pairs of (id, clinic, hash), id_a < id_b, within so many bits, exactly and once each.

    The hash, of up to 63 bits, is cut into bands. Of n bands two near hashes differ in most // n bits at most in one, so a
    row is looked up under all such changes of each band. A pair counts in the first band that is near enough.
    """
    bands, radius = _bands(bits, most)
    part = lambda lo, hi: f"shiftrightunsigned(hash, {lo}) & {(1 << (hi - lo)) - 1}L"
    keys = F.array(*(F.struct(F.lit(i).alias("band"), F.expr(part(lo, hi)).alias("part")) for i, (lo, hi) in enumerate(bands)))
    tries = F.flatten(F.array(*(F.expr(f"transform(array({', '.join(f'{m}L' for m in _flips(hi - lo, radius))}), m -> struct({i} as band, ({part(lo, hi)}) ^ m as part))") for i, (lo, hi) in enumerate(bands))))
    left = a.select(F.col("id").alias("id_a"), F.col("clinic").alias("clinic_a"), F.col("hash").alias("hash_a"), F.inline(tries))
    right = b.select(F.col("id").alias("id_b"), F.col("clinic").alias("clinic_b"), F.col("hash").alias("hash_b"), F.inline(keys))
    first = "case " + " ".join(f"when bit_count((hash_a ^ hash_b) & {((1 << hi) - 1) ^ ((1 << lo) - 1)}L) <= {radius} then {i}" for i, (lo, hi) in enumerate(bands)) + " end"
    near = left.join(right, ["band", "part"]).where(f"id_a < id_b and bit_count(hash_a ^ hash_b) <= {most} and band = {first}")
    return near.select("id_a", "id_b", "clinic_a", "clinic_b", F.expr("cast(bit_count(hash_a ^ hash_b) as int)").alias("bits"))


def near_hashes(hashes: DataFrame, most: int) -> DataFrame:
    """(hash_a, hash_b, bits) of distinct near hashes, each pair in both directions, and each hash with itself: copies are one.

    A hash is a number of up to 63 bits, or an array of 64-bit words.
    """
    if hashes.schema["hash"].dataType.typeName() == "array":
        each, _ = distinct_hashes(hashes)
        pairs = near_words(each, most)
        same = each.select(F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"), F.lit(0).alias("bits"))
        return pairs.unionByName(pairs.select(F.col("hash_b").alias("hash_a"), F.col("hash_a").alias("hash_b"), "bits")).unionByName(same)
    each, n = distinct_hashes(hashes)
    if n <= nearhash.TILED:
        pairs = near_tiles(each, n, most)
    else:
        each = each.select(F.col("hash").alias("id"), F.lit("").alias("clinic"), "hash")
        pairs = near_pairs(each, each, most).select(F.col("id_a").alias("hash_a"), F.col("id_b").alias("hash_b"), "bits")
    same = each.select(F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"), F.lit(0).alias("bits"))
    return pairs.unionByName(pairs.select(F.col("hash_b").alias("hash_a"), F.col("hash_a").alias("hash_b"), "bits")).unionByName(same)


def pair_counts(hashes: DataFrame, most: int) -> DataFrame:
    """clinic_a, clinic_b, bits, hash_a, n_a, pairs: how many of a hash's images of one clinic have near ones of another, counted by hashes.

    Each pair of images is counted from both its sides; pairs of copies are counted, never made.
    """
    sizes = written(hashes.where("hash is not null").groupBy("hash", "clinic").agg(F.count("*").alias("n")), "sizes")
    a = sizes.select(F.col("hash").alias("hash_a"), F.col("clinic").alias("clinic_a"), F.col("n").alias("n_a"))
    b = sizes.select(F.col("hash").alias("hash_b"), F.col("clinic").alias("clinic_b"), F.col("n").alias("n_b"))
    # Written, so that pairs are tried once however often their counts are read.
    met = written(near_hashes(sizes, most), "near").join(a, "hash_a").join(b, "hash_b")
    own = F.when((F.col("hash_a") == F.col("hash_b")) & (F.col("clinic_a") == F.col("clinic_b")), 1).otherwise(0)
    return met.select("clinic_a", "clinic_b", "bits", "hash_a", "n_a", (F.col("n_a") * (F.col("n_b") - own)).alias("pairs")).where("pairs > 0")


def self_pairs(counts: DataFrame) -> DataFrame:
    """By clinic, its near pairs."""
    return counts.where("clinic_a = clinic_b").groupBy(F.col("clinic_a").alias("clinic")).agg((F.sum("pairs") / 2).cast("long").alias("pairs"))


def overlap(counts: DataFrame, images: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """By clinic pair: pairs (within a clinic from both sides), distinct left images, their share, and a verdict."""
    size = images.groupBy(F.col("clinic").alias("clinic_a")).agg(F.count("*").alias("size"))
    each = counts.groupBy("clinic_a", "clinic_b", "hash_a").agg(F.sum("pairs").alias("pairs"), F.max("n_a").alias("n_a"))
    g = each.groupBy("clinic_a", "clinic_b").agg(F.sum("pairs").alias("pairs"), F.sum("n_a").alias("n_a"))
    f = F.col("n_a") / F.col("size")
    return g.join(size, "clinic_a").select("clinic_a", "clinic_b", "pairs", "n_a", f.alias("fraction"), F.when(F.col("pairs") == 0, "clean").when(f <= tolerance, "suspect").otherwise("overlapping").alias("verdict"))


def capture_features(images: DataFrame) -> DataFrame:
    """Mean, spread, extremes, contrast of neighbours over an image's pixels, by array functions."""
    d = images.select("id", "clinic", F.transform("px", lambda x: x.cast("double")).alias("p"))
    mean = F.expr("aggregate(p, 0D, (a, x) -> a + x) / size(p)")
    d = d.withColumn("mean", mean)
    return d.select("id", "clinic", "mean", F.expr("sqrt(aggregate(p, 0D, (a, x) -> a + (x - mean) * (x - mean)) / size(p))").alias("std"), F.array_min("p").alias("low"), F.array_max("p").alias("high"), F.expr("aggregate(transform(slice(p, 1, size(p) - 1), (x, i) -> abs(p[i + 1] - x)), 0D, (a, x) -> a + x) / (size(p) - 1)").alias("roughness"))


def shift_table(features: DataFrame) -> DataFrame:
    return summary(features, ["clinic"], {"median": ("mean", 0.5)}, F.count("*").alias("n"), F.avg("mean").alias("brightness"), F.avg("std").alias("contrast"))


def hash_calibration(counts: DataFrame, same: str) -> DataFrame:
    """Bits of pairs that should match and of those that should not: medians, extremes, gap, the midpoint if there is a gap.

    counts (bits, pairs, ...) says how many pairs there are of each kind.
    """
    c = counts.groupBy("bits", F.expr(same).alias("same")).agg(F.sum("pairs").alias("n"))
    g = c.agg(F.max(F.when(F.col("same"), F.col("bits"))).alias("pos_max"), F.min(F.when(~F.col("same"), F.col("bits"))).alias("neg_min"), *(F.expr(f"percentile(case when {cond} then bits end, 0.5, n)").alias(name) for cond, name in (("same", "pos_median"), ("not same", "neg_median"))))
    gap = F.col("neg_min") - F.col("pos_max")
    return g.withColumns({"gap": gap, "threshold": F.when(gap > 1, F.floor((F.col("pos_max") + F.col("neg_min")) / 2).cast("int"))})


def hybrid_cohorts(m: DataFrame, least: int = 10) -> DataFrame:
    """For ordered pairs of clinics: one's negatives with the other's positives, where both have enough."""
    c = m.groupBy("clinic").agg(F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") == 1).alias("pos"))
    a, b = c.select(F.col("clinic").alias("negatives_of"), "neg").where(F.col("neg") >= least), c.select(F.col("clinic").alias("positives_of"), "pos").where(F.col("pos") >= least)
    return a.join(b, F.col("negatives_of") != F.col("positives_of")).withColumn("n", F.col("neg") + F.col("pos"))
