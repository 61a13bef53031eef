"""Near pairs among hashes of several 64-bit words, exactly, by multi-index hashing.

Hashes that differ in at most `most` bits agree on one of any most + 1 bands that their bits are dealt into. So each hash is one
row a band, and only rows with equal band values meet. Where more than HOT hashes share a band's value, they are dealt into
bands anew, in another order of the bits, and must agree on one of these as well; and so on, level by level, in crowded buckets
only. A pair counts where its first agreeing bands of all levels so far are those of the bucket: once. Buckets that stay crowded
on the last level are tried in blocks. Copies of a hash are one: pairs of copies are counted by the callers, never made here.

Real hashes crowd into buckets, and then bands cost more than trying all pairs as arrays: up to TILED distinct hashes, near_words
leaves them to tiles.py.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.tiles import near_tiles
from assayer.sources.tables import written

WORDS = 4
#: Hashes of a bucket that meet each other, and levels of bands before crowded buckets go by blocks.
HOT, LEVELS = 64, 4
#: Up to so many distinct hashes all pairs are tried by tiles, which takes less than the joins of the bands.
TILED = 3_000_000


def _order(level: int, bits: int) -> list[int]:
    """The bits as a level deals them: in their own order first, then shuffled, the same way in each run."""
    order = list(range(bits))
    if level:
        random.Random(level).shuffle(order)
    return order


def _bands(level: int, bits: int, most: int) -> list[list[int]]:
    order, n = _order(level, bits), most + 1
    cuts = [round(i * bits / n) for i in range(n + 1)]
    return [order[a:b] for a, b in zip(cuts, cuts[1:])]


def _mask(positions: list[int], word: int) -> int:
    value = sum(1 << (p % 64) for p in positions if p // 64 == word)
    return value - (1 << 64) if value >> 63 else value


def _value(positions: list[int]) -> Column:
    """A number that tells apart what hashes hold at some bits: their words there, mixed."""
    words = sorted({p // 64 for p in positions})
    return F.xxhash64(*(F.col("hash")[w].bitwiseAND(F.lit(_mask(positions, w))) for w in words))


def _first(level: int, bits: int, most: int) -> Column:
    """The first band of a level on which hash_a and hash_b agree."""
    found = F.lit(-1)
    for i, positions in reversed(list(enumerate(_bands(level, bits, most)))):
        words = sorted({p // 64 for p in positions})
        same = F.lit(True)
        for w in words:
            same = same & (F.col("hash_a")[w].bitwiseXOR(F.col("hash_b")[w]).bitwiseAND(F.lit(_mask(positions, w))) == 0)
        found = F.when(same, i).otherwise(found)
    return found


def distance(a: Column, b: Column, words: int = WORDS) -> Column:
    """In how many bits two hashes differ."""
    return sum((F.bit_count(a[w].bitwiseXOR(b[w])) for w in range(1, words)), F.bit_count(a[0].bitwiseXOR(b[0]))).cast("int")


def _dealt(rows: DataFrame, level: int, bits: int, most: int) -> DataFrame:
    """A row for each band of a level: path (the bands so far), key (the bucket), hash."""
    bands = F.array(*(F.struct(F.lit(i).alias("i"), _value(p).alias("v")) for i, p in enumerate(_bands(level, bits, most))))
    each = rows.select("path", "key", "hash", F.explode(bands).alias("x"))
    return each.select(F.concat("path", F.array("x.i")).alias("path"), F.xxhash64("key", "x.i", "x.v").alias("key"), "hash")


def _blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs of each bucket's rows by blocks of HOT: a row meets each block that is not before its own."""
    n = F.col("n")
    block = F.pmod(F.xxhash64("hash"), F.ceil(n / HOT)).cast("int")
    own = rows.join(sizes, "key").withColumn("block", block)
    a = own.select("key", "path", F.col("hash").alias("hash_a"), F.col("block").alias("from"), F.explode(F.sequence("block", (F.ceil(n / HOT) - 1).cast("int"))).alias("to"))
    b = own.select("key", F.col("path").alias("path_b"), F.col("hash").alias("hash_b"), F.col("block").alias("to"), F.explode(F.sequence(F.lit(0), "block")).alias("from"))
    met = a.join(b, ["key", "from", "to"]).where("path = path_b and hash_a <> hash_b and (from < to or hash_a < hash_b)")
    return met.select("path", F.least("hash_a", "hash_b").alias("hash_a"), F.greatest("hash_a", "hash_b").alias("hash_b"))


def candidates(hashes: DataFrame, most: int, words: int = WORDS) -> DataFrame:
    """(path, hash_a, hash_b), hash_a < hash_b: pairs that meet in a bucket, of distinct hashes (hash array<bigint>)."""
    bits = 64 * words
    rows = hashes.where("hash is not null").select("hash").distinct().select(F.array().cast("array<int>").alias("path"), F.lit(0).cast("long").alias("key"), "hash")
    found = None
    for level in range(LEVELS):
        rows = written(_dealt(rows, level, bits, most), "bands")
        sizes = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        few = rows.join(sizes.where(F.col("n") <= HOT).select("key"), "key")
        a, b = few.select("key", "path", F.col("hash").alias("hash_a")), few.select("key", F.col("path").alias("path_b"), F.col("hash").alias("hash_b"))
        met = a.join(b, "key").where("path = path_b and hash_a < hash_b").select("path", "hash_a", "hash_b")
        found = met if found is None else found.unionByName(met)
        crowded = sizes.where(F.col("n") > HOT)
        if crowded.isEmpty():
            return found
        if level == LEVELS - 1:
            return found.unionByName(_blocks(rows, crowded))
        rows = rows.join(crowded.select("key"), "key", "left_semi")
    return found


def distinct_hashes(hashes: DataFrame) -> tuple[DataFrame, int]:
    """The distinct hashes, written, and their number."""
    each = written(hashes.where("hash is not null").select("hash").distinct(), "hashes")
    return each, each.count()


def near_words(hashes: DataFrame, most: int, words: int = WORDS) -> DataFrame:
    """(hash_a, hash_b, bits): pairs of distinct hashes within `most` bits, hash_a < hash_b, each once."""
    each, n = distinct_hashes(hashes)
    if n <= TILED:
        return near_tiles(each, n, most, words)
    hashes, bits = each, 64 * words
    first = F.array(*(_first(level, bits, most) for level in range(LEVELS)))
    met = candidates(hashes, most, words).withColumn("bits", distance(F.col("hash_a"), F.col("hash_b"), words)).where(F.col("bits") <= most)
    return met.where(F.col("path") == F.slice(first, F.lit(1), F.size("path"))).select("hash_a", "hash_b", "bits")


def near_images(images: DataFrame, most: int, words: int = WORDS) -> DataFrame:
    """(id_a, id_b, clinic_a, clinic_b, bits) with id_a < id_b of images (id, clinic, hash array<bigint>) within `most` bits; copies too."""
    images = written(images.select("id", "clinic", "hash"), "images")
    side = lambda s: images.select(F.col("id").alias(f"id_{s}"), F.col("clinic").alias(f"clinic_{s}"), F.col("hash").alias(f"hash_{s}"))
    pairs = near_words(images, most, words)
    both = pairs.unionByName(pairs.select(F.col("hash_b").alias("hash_a"), F.col("hash_a").alias("hash_b"), "bits"))
    near = both.join(side("a"), "hash_a").join(side("b"), "hash_b")
    same = side("a").join(side("b"), F.col("hash_a") == F.col("hash_b")).withColumn("bits", F.lit(0))
    names = ["id_a", "id_b", "clinic_a", "clinic_b", "bits"]
    return near.select(names).unionByName(same.select(names)).where("id_a < id_b")


def gradient_words(images: DataFrame, words: int = WORDS) -> DataFrame:
    """id, clinic, hash: in word w, bit i says whether value i + w + 1 (round the end) is greater than value i, of 64 values px."""
    word = lambda s: " + ".join(f"shiftleft(cast(px[{(i + s) % 64}] > px[{i}] as bigint), {i})" for i in range(64))
    return images.select("id", "clinic", F.expr(f"array({', '.join(word(s) for s in range(1, words + 1))})").alias("hash"))
