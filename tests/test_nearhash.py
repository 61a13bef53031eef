"""Near pairs of 256-bit hashes against all pairs by numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import audit, nearhash


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def words_of(number):
    return [signed(number >> 64 * w & (1 << 64) - 1) for w in range(4)]


def table(spark, numbers, clinics=None):
    rows = [(i, f"c{i % 3}" if clinics is None else clinics[i], None if x is None else words_of(x)) for i, x in enumerate(numbers)]
    return spark.createDataFrame(rows, "id long, clinic string, hash array<bigint>")


def flipped(rng, x, n):
    for p in rng.sample(range(256), n):
        x ^= 1 << p
    return x


def by_hand(numbers, most):
    return {(i, j, (a ^ b).bit_count()) for i, a in enumerate(numbers) for j, b in enumerate(numbers) if i < j and a is not None and b is not None and (a ^ b).bit_count() <= most}


@pytest.mark.parametrize("hot,levels", [(64, 4), (3, 4), (2, 2)])
def test_pairs_match_all_pairs(spark, monkeypatch, hot, levels):
    """Crowded buckets too: with 3 and 2, most go on to further levels and to blocks."""
    monkeypatch.setattr(nearhash, "HOT", hot)
    monkeypatch.setattr(nearhash, "LEVELS", levels)
    rng = random.Random(7)
    seeds = [rng.getrandbits(256) for _ in range(12)] + [0, (1 << 256) - 1, 1 << 63]
    numbers = [flipped(rng, rng.choice(seeds), rng.randint(0, 20)) for _ in range(150)] + seeds + [None]
    got = [tuple(r) for r in nearhash.near_images(table(spark, numbers), 14).select("id_a", "id_b", "bits").collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(numbers, 14)


def test_a_band_that_all_share_is_refined(spark, monkeypatch):
    """Flat upper halves: half of all bands are alike in all hashes."""
    monkeypatch.setattr(nearhash, "HOT", 20)
    rng = random.Random(8)
    numbers = [rng.getrandbits(128) for _ in range(300)]
    numbers += [flipped(rng, x, 9) for x in numbers[:40]]
    got = {tuple(r) for r in nearhash.near_images(table(spark, numbers), 14).select("id_a", "id_b", "bits").collect()}
    assert got == by_hand(numbers, 14)


def test_counts_by_clinic_make_no_pairs_of_copies(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(256) for _ in range(5)]
    numbers = [base[i % 5] if i % 2 else flipped(rng, base[i % 5], 3) for i in range(60)]
    df = table(spark, numbers)
    clinic = [f"c{i % 3}" for i in range(60)]
    want = {}
    for i, a in enumerate(numbers):
        for j, b in enumerate(numbers):
            if i != j and (a ^ b).bit_count() <= 14:
                want[clinic[i], clinic[j]] = want.get((clinic[i], clinic[j]), 0) + 1
    got = audit.pair_counts(df, 14).groupBy("clinic_a", "clinic_b").agg(F.sum("pairs").alias("n")).collect()
    assert {(r.clinic_a, r.clinic_b): r.n for r in got} == want


def test_candidates_grow_with_the_hashes(spark):
    """100,000 random hashes: candidates in proportion to their number, at most 15 rows of bands a hash."""
    rng = np.random.default_rng(3)
    seen = []
    for n in (25_000, 100_000):
        rows = rng.integers(-(1 << 63), 1 << 63, (n, 4), dtype=np.int64)
        df = spark.createDataFrame([(r,) for r in rows.tolist()], "hash array<bigint>").repartition(8)
        seen.append(nearhash.candidates(df, 14).count() / n)
    assert seen[1] <= 15 * nearhash.HOT / 2 and seen[1] < 8


def test_empty(spark):
    assert nearhash.near_images(table(spark, []), 14).collect() == []
    assert nearhash.near_images(table(spark, [None, 5]), 14).collect() == []
