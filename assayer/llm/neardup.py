"""MinHash near-dedup: bands of MinHash values give candidates, odd sketches judge them, full shingle sets confirm them.

Rows with equal shingle sets are one node. In each bucket of a band all nodes are tried against one hub, which joins large
groups of copies at a cost in proportion to their size. Then only pairs of a bucket are left that still lie in different
components. Where few nodes lie outside the bucket's main component, each is tried against the bucket. Where many do, which
are alike yet not linked, the bucket is split by the rarest shingles of its nodes: sets of the least similarity share one
among so many of their rarest, in any fixed order of all shingles, so no link is lost and what the nodes have in common, being
frequent, brings none together. Longer sketches, made for the nodes of such buckets alone, pass the pairs that may reach the
similarity. So no group is expanded into its pairs. A pair of similarity 0.75 shares none of the 32 bands of 4 values with
probability 6e-6, and is turned away by a sketch with less than that.

Results: a null text, an empty one or one of white space only has no shingles and is linked with nothing. Fewer than
`words` words count as one shingle. Rows of one doc_id are one document, of which each row keeps its own n_shingles. A
row without doc_id is linked like any other but names no component: without a link to an id its component_id is null.
An empty table gives no rows. Long texts are read whole. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import Cut, arrow_batches, small, trimmed
from assayer.llm.textwords import mix, shingles, slices

BANDS, ROWS = 32, 4
SKETCH_BITS = 256
#: (samples, bits) of the longer sketches for pairs across components.
LONGER = ((512, 1024), (3072, 4096))
#: Deviations that a sketch may lie beyond what the least similarity leads one to expect.
SLACK = 4.5
#: Nodes outside a bucket's main component up to which they are tried against the whole bucket.
FEW = 64
#: Nodes of a bucket that those outside its main component meet in one part.
MEET = 4096
#: Nodes of a block that is tried against another.
BLOCK = 1024
#: Bits of the table of shingles' frequencies (4 MB), which gives their order.
FREQUENCY_BITS = 20
#: Pairs of one hub that are confirmed in one task.
HUB = 2000
#: Ids lie below this.
NO_ID = 1 << 62

_K = BANDS * ROWS
_MOST = max(_K, *(k for k, _ in LONGER))
_MUL = (mix(np.arange(1, _MOST + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (mix(np.arange(10001, _MOST + 10001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_PLACE = mix(np.arange(20001, _MOST + 20001, dtype=np.uint64))


def minhash(hashes: np.ndarray, samples: int = _K) -> np.ndarray:
    """The least of each of so many permutations of a set's 32-bit hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(samples, 0xFFFFFFFF, np.uint32)
    step = max(16, (1 << 17) // samples)
    for i in range(0, len(x), step):
        y = x[i : i + step, None] * _MUL[:samples]
        y += _ADD[:samples]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        np.minimum(least, y.min(axis=0), out=least)
    return least


def odd_sketch(least: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """A parity bitmap into which each (permutation, MinHash value) is folded, as 64-bit words."""
    at = mix(_PLACE[: len(least)] ^ least.astype(np.uint64)) % np.uint64(bits)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def most_odd(similarity: float, samples: int = _K, bits: int = SKETCH_BITS) -> int:
    """The most bits in which sketches of sets of this similarity differ, up to SLACK deviations."""
    expected = 2 * samples * (1 - similarity)
    spread = 2 * math.sqrt(samples * similarity * (1 - similarity))
    mean = lambda m: bits * (1 - (1 - 2 / bits) ** m) / 2
    folding = math.sqrt(bits / 4 * (1 - math.exp(-4 * expected / bits)))
    deviation = math.hypot((mean(expected + spread) - mean(expected - spread)) / 2, folding)
    return min(bits, math.ceil(mean(expected) + SLACK * deviation))


def _bands(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
    for i in range(ROWS):
        key = mix(key ^ rows[:, i]) + np.uint64(i)
    return key.view(np.int64)


def _fingerprint(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, from its sorted hashes."""
    place = np.arange(1, len(own) + 1, dtype=np.uint64)
    return tuple(int(mix(own * np.uint64(k) + place).sum().view(np.int64)) for k in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95))


def _sketched(words: int):
    schema = pa.schema([("node", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for first, last, h, at in slices(batch):
                for i in range(first, last):
                    own = shingles(h[at[i - first] : at[i - first + 1]], words)
                    if not len(own):
                        rows.append((ids[i], 0, None, None, None, None))
                        continue
                    least = minhash(own)
                    rows.append((ids[i], len(own), *_fingerprint(own), _bands(least), odd_sketch(least)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return trimmed(sketched), "node long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>"


def _each_set(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    for first, last, h, at in slices(batch):
        for i in range(last - first):
            yield shingles(h[at[i] : at[i + 1]], words)


def _sets(words: int):
    """(node, the set's sorted hashes) of texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in _each_set(batch, words)], pa.binary())], names=["node", "own"])

    return trimmed(sets), "node long, own binary"


def _frequencies(words: int):
    """How many sets hold shingles of each cell of the table."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << FREQUENCY_BITS, np.int64)
        for batch in batches:
            for own in _each_set(batch, words):
                np.add.at(total, (own >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64), 1)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    return trimmed(frequencies), "cell long, n long"


def _rarest(words: int, percent: int, frequency):
    """(node, those of its rarest shingles of which similar sets share one)."""

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in _each_set(batch, words):
                order = np.lexsort((own, frequency.value[(own >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)]))
                out.append(own[order[: len(own) + (-percent * len(own)) // 100 + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["node", "rare"])

    return trimmed(rarest), "node long, rare array<long>"


def _longer(words: int):
    """(node, bands, the longer sketches) of texts."""
    names = ["bands", *(f"z{i}" for i in range(len(LONGER)))]
    schema = pa.schema([("node", pa.int64()), *((x, pa.list_(pa.int64())) for x in names)])

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in _each_set(batch, words):
                least = minhash(own, _MOST)
                out.append([_bands(least[:_K]), *(odd_sketch(least[:k], bits) for k, bits in LONGER)])
            columns = [pa.array(x, schema.field(1).type) for x in zip(*out)] or [pa.array([], schema.field(1).type)] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    return trimmed(longer), "node long, " + ", ".join(f"{x} array<long>" for x in names)


def _tried(own: np.ndarray, across: bool, comp: np.ndarray, sketches: list[np.ndarray], most: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (as places) of a block, or across two, that lie in different components and that sketches pass."""
    n, left, right = len(own), [], []
    for at in range(0, n, 64):
        rows = np.arange(at, min(at + 64, n))
        x, y = np.nonzero((comp[rows, None] != comp) & (rows[:, None] < np.arange(n)) & ((own[rows, None] != own) if across else True))
        x += at
        for z, bound in zip(sketches, most):
            for k in range(0, len(x), 1 << 16):
                part = slice(k, k + (1 << 16))
                good = np.bitwise_count(z[x[part]] ^ z[y[part]]).sum(axis=1, dtype=np.int64) <= bound
                x[part], y[part] = np.where(good, x[part], -1), y[part]
            x, y = x[x >= 0], y[x >= 0]
        left.append(x)
        right.append(y)
    return np.concatenate(left), np.concatenate(right)


def _crowded(percent: int):
    """The pairs (a, b) of groups (g, i, j) of rows, which come sorted by them: a pair that shares several shingles comes several times."""
    most = [most_odd(percent / 100, samples, bits) for samples, bits in LONGER]

    def pairs(t: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
        _, i, j, own, node, comp = (t.column(k).to_numpy() for k in range(6))
        z = [t.column(k).flatten().to_numpy().view(np.uint64).reshape(len(t), -1) for k in (6, 7)]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, high in zip(edges, edges[1:]):
            if high - low < 2 or (comp[low:high] == comp[low]).all():
                continue
            x, y = _tried(own[low:high], i[low] != j[low], comp[low:high], [s[low:high] for s in z], most)
            a.append(np.minimum(node[low + x], node[low + y]))
            b.append(np.maximum(node[low + x], node[low + y]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = batch if held is None or not len(held) else pa.concat_batches([held, batch])
            if not len(t):
                continue
            keys = np.stack([t.column(k).to_numpy() for k in range(3)])
            edges = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1]
            yield pairs(t, edges)
            held = t.slice(edges[-1])
        if held is not None and len(held):
            yield pairs(held, np.array([0, len(held)]))

    return trimmed(crowded), "a long, b long"


def _confirmed(percent: int):
    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a = a.as_py()
                if a != last:
                    last, known = a, np.frombuffer(a, np.uint64)
                other = np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(known, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(known) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return trimmed(confirmed), "a long, b long"


def components(edges: DataFrame) -> Cut:
    """(node, comp): each node of the edges (a, b) with the least node that it is connected with.

    Alternates large-star and small-star steps, minima with partial aggregation joined to the edges, until all parts are stars.
    """
    now = Cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        ends = now.df.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.df.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        if not ends.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]:
            break
        for step in ("large", "small"):
            e = now.df
            near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if step == "large" else e
            least = Cut(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
            joined = near.join(small(least.df), "a")
            if step == "large":
                out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            else:
                out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.df.select("a", F.col("m").alias("b")))
            out = out.where("a <> b")
            new = Cut(out if step == "large" else out.distinct(), "edges")
            now.drop()
            least.drop()
            now = new
    found = Cut(now.df.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.df.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()), "components")
    now.drop()
    return found


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked whose sets of shingles have 100 * intersection >= percent * union.
    """
    arrow_batches(docs.sparkSession)
    # A row without an id is known by its text, by a number above all ids.
    node = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.xxhash64("text").bitwiseAND(F.lit(NO_ID - 1)))
    texts = docs.select(node.alias("node"), F.col("text").cast("string").alias("text"))
    rows = Cut(texts.mapInArrow(*_sketched(words)), "sketches")
    n_rows, n_ids = rows.df.agg(F.count("*"), F.countDistinct("node")).first()
    # Equal sets are one node, the least.
    sets = rows.df.where("f1 is not null").groupBy("f1", "f2").agg(F.min("node").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = Cut(sets, "nodes")
    bucket = nodes.df.select("node", F.explode("bands").alias("k"))
    hubs = Cut(bucket.groupBy("k").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("top > hub").drop("top"), "hubs")
    members = Cut(bucket.join(small(hubs.df), "k").select("k", "node", "hub"), "members")
    bits = most_odd(percent / 100)
    odd = " + ".join(f"bit_count(x[{i}] ^ y[{i}])" for i in range(SKETCH_BITS // 64))

    def texts_of(wanted: Cut) -> DataFrame:
        """The other texts are not moved while the wanted ids can be broadcast."""
        return texts.join(small(wanted.df), "node", "left_semi")

    def once(df: DataFrame, *columns: str) -> DataFrame:
        """Rows of one id may give the same sets again."""
        return df if n_rows == n_ids else df.dropDuplicates(list(columns))

    def confirmed(close: Cut) -> Cut:
        """The pairs (a, b) that full sets confirm."""
        wanted = Cut(close.df.select(F.col("a").alias("node")).distinct().unionByName(close.df.select(F.col("b").alias("node")).distinct()).distinct(), "wanted")
        packed = Cut(once(texts_of(wanted).mapInArrow(*_sets(words)), "node", "own"), "sets")
        # A hub's set goes once to each part of its pairs.
        hubs = small(Cut(close.df.groupBy("a").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")).where("parts > 1"), "hubs").df)
        first = packed.df.select(F.col("node").alias("b"), F.col("own").alias("y")).join(small(close.df), "b").join(hubs, "a", "left")
        part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")
        sent = packed.df.select(F.col("node").alias("a"), F.col("own").alias("x")).join(hubs, "a", "left")
        sent = sent.select("a", "x", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        sized = first.select("a", "b", "y", part.alias("part")).join(sent, ["a", "part"])
        links = Cut(sized.select("a", "b", "x", "y").mapInArrow(*_confirmed(percent)), "links")
        for x in (close, wanted, packed):
            x.drop()
        return links

    def split(many: Cut, longer: Cut) -> DataFrame:
        """The pairs (a, b) across components, of nodes (node, comp), that share one of their rarest shingles and that sketches pass."""
        ours = texts_of(Cut(many.df.select("node"), "ours"))
        table = np.zeros(1 << FREQUENCY_BITS, np.uint32)
        # The table's size is fixed, whatever the number of texts.
        for row in ours.mapInArrow(*_frequencies(words)).groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_batches():
            table[row.column(0).to_numpy()] = np.minimum(row.column(1).to_numpy(), 0xFFFFFFFF)
        frequency = docs.sparkSession.sparkContext.broadcast(table)
        rare = Cut(once(ours.mapInArrow(*_rarest(words, percent, frequency)), "node", "rare").join(small(many.df), "node").select("node", "comp", F.explode("rare").alias("g")), "rare")
        shared = rare.df.groupBy("g").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("low < high").select("g", "parts")
        met = rare.df.join(small(Cut(shared, "shared").df), "g").groupBy("node", "comp").agg(F.collect_list(F.struct("g", "parts")).alias("gs"))
        placed = met.join(small(longer.df), "node").select("node", "comp", "z0", "z1", F.inline("gs"))
        # A large group is tried block by block with each other.
        placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keyed = placed.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "z0", "z1")
        pairs = Cut(keyed.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(*_crowded(percent)).distinct(), "crowd").df
        rare.drop()
        return pairs

    # Each node against the hubs of its buckets.
    tried = Cut(members.df.where("hub < node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "tried")
    left = Cut(nodes.df.select(F.col("node").alias("a"), F.col("sketch").alias("x")).join(small(tried.df), "a"), "left")
    both = nodes.df.select(F.col("node").alias("b"), F.col("sketch").alias("y")).join(small(left.df), "b")
    links = confirmed(Cut(both.where(f"{odd} <= {bits}").select("a", "b"), "close"))
    comp = components(links.df)

    # Buckets that hold several components: the pairs across them.
    placed = members.df.select("k", "node").join(small(comp.df), "node", "left").select("k", "node", F.coalesce("comp", "node").alias("comp"))
    by_comp = placed.groupBy("k", "comp").agg(F.count("*").alias("n"))
    mixed = by_comp.groupBy("k").agg(F.count("*").alias("parts"), F.max(F.struct("n", "comp"))["comp"].alias("main"), (F.sum("n") - F.max("n")).alias("others"), F.ceil(F.sum("n") / MEET).cast("int").alias("salts")).where("parts > 1").select("k", "main", "others", "salts")
    here = Cut(placed.join(small(Cut(mixed, "mixed").df), "k"), "here")
    wanted = Cut(here.df.select("node").distinct(), "wanted")
    longer = Cut(once(texts_of(wanted).mapInArrow(*_longer(words)), "node", "z0", "z1"), "longer")
    near = " + ".join(f"bit_count(z0[{i}] ^ y0[{i}])" for i in range(LONGER[0][1] // 64)) + f" <= {most_odd(percent / 100, *LONGER[0])}"
    nearer = f"aggregate(zip_with(z1, y1, (p, q) -> bit_count(p ^ q)), 0, (a, v) -> a + v) <= {most_odd(percent / 100, *LONGER[1])}"
    carried = here.df.where(F.col("others") <= FEW).join(small(longer.df), "node")
    # A large main component is dealt into parts, each of which meets the few nodes outside it.
    rest = carried.where("comp <> main").select("k", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "node", "comp", "bands", "z0", "z1")
    other = carried.select("k", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.col("node").alias("node2"), F.col("comp").alias("comp2"), "main", F.col("bands").alias("bands2"), F.col("z0").alias("y0"), F.col("z1").alias("y1"))
    across = f"comp <> comp2 and (comp2 = main or node < node2) and {near} and {nearer} and element_at(array_intersect(bands, bands2), 1) = k"
    pairs = rest.join(other, ["k", "salt"]).where(across).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
    many = Cut(here.df.where(F.col("others") > FEW).select("node", "comp").distinct(), "many")
    if not many.df.isEmpty():
        pairs = pairs.unionByName(split(many, longer))
    more = confirmed(Cut(pairs, "close"))
    if not more.df.isEmpty():
        comp = components(more.df.unionByName(comp.df.select(F.col("node").alias("a"), F.col("comp").alias("b"))))
    for x in (links, more, many, here, wanted, longer, left, tried, members, hubs):
        x.drop()
    whole = nodes.df.select("f1", "f2", "node").join(comp.df, "node", "left").select("f1", "f2", F.coalesce("comp", "node").alias("comp"))
    out = rows.df.select("node", "n_shingles", "f1", "f2").join(whole, ["f1", "f2"], "left")
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    out = out.withColumn("comp", F.coalesce("comp", "node")).select(real("node").alias("doc_id"), "n_shingles", real("comp").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
