"""Importance resampling towards a target distribution: documents are drawn by how much likelier their n-grams are in the target.

A partition's texts are cut into groups of about GROUP bytes. A group's words become ids, laid end to end, and their suffixes
are sorted to the depth of the longest n-gram: ranks of one word, then of pairs of ranks, and so on. Between neighbours in that
order stand their common prefixes (LCP), cut at the ends of texts; a run of neighbours that share n words is one repeated n-gram.
Each run is hashed once, and its bucket is scattered back to its occurrences, which are counted or scored.

Counts of buckets are summed over partitions: a table of as many rows as there are buckets, whatever the corpus. Texts are read
twice, once to count and once to score. The draw ranks documents by scores, whole numbers of a bounded range: rows of each score
are counted, so that each score, and each stretch of ids in it, has its offset, and rows are numbered in such a stretch only.

A document's weight is the floored mean of its n-grams' gains, its score the weight and Gumbel noise by its id: the best scores
are a draw without replacement in proportion to the weights' exponentials. Documents with few words aren't drawn. Ties go to the
smaller id. Null and empty texts have no n-grams and weight 0; a null id counts as empty text in the noise and comes last among
ties. Repeated rows count, and are drawn, each. Empty tables give no rows; an empty target, counts of 0. Long texts are read
whole. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import Cut, arrow_batches, trimmed

ORDER, BUCKETS = 2, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of texts whose suffixes are sorted together.
GROUP = 1 << 22
#: Stretches of ids that rows of one score are dealt into.
STRETCHES = 64
#: Bytes of words: digits, letters a to z, all that isn't ASCII. A to Z are lower-cased.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Words:
    """The words of some texts: their spelling, each place's word id, and the places before each text."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        _, bounds, body = texts.buffers()
        offsets = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        word = _WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(word & (np.append(True, ~word[:-1])[: len(word)] | edge[:-1]))
        ends = np.flatnonzero(word & (np.append(~word[1:], True)[: len(word)] | edge[1:])) + 1
        lengths = np.append(0, np.cumsum(ends - starts))
        spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(lengths.astype(np.int64)), pa.py_buffer(_LOWER[data[word]])])
        coded = pc.dictionary_encode(spelled)
        self.spelled, self.ids = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        self.bounds = np.searchsorted(starts, offsets)


class Suffixes:
    """The suffixes of words' places in order, to the depth of `order` words, with their common prefixes; none reaches beyond its text."""

    def __init__(self, words: Words, order: int):
        n, ids = len(words.ids), words.ids
        self.left = np.repeat(words.bounds[1:], np.diff(words.bounds)) - np.arange(n)
        rank, depth = ids + 1, 1
        while depth < order:  # ranks of twice the depth, from pairs of ranks; 0 beyond the text's end
            step = min(depth, order - depth)
            after = np.where(self.left > step, np.append(rank[step:], np.zeros(step, np.int64))[:n], 0)
            rank = np.unique((rank << 32) | after, return_inverse=True)[1].astype(np.int64) + 1
            depth += step
        self.array = np.argsort(rank, kind="stable")
        # Words that a suffix shares with the one before it, up to the depth.
        self.lcp = np.zeros(n, np.int64)
        same = np.ones(max(n - 1, 0), bool)
        for k in range(order):
            a, b = self.array[:-1] + k, self.array[1:] + k
            same = same & (self.left[self.array[:-1]] > k) & (self.left[self.array[1:]] > k)
            same[same] = ids[a[same]] == ids[b[same]]
            self.lcp[1:] += same

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where n-grams of `length` words begin, in order, and the run of each: equal n-grams are neighbours."""
        whole = self.left[self.array] >= length
        return self.array[whole], np.cumsum((self.lcp < length)[whole]) - 1


def occurrences(words: Words, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-grams: the places where they begin, and their buckets, hashed once a run."""
    suffixes = Suffixes(words, order)
    crc = [zlib.crc32(x) for x in words.spelled]
    for length in range(1, order + 1):
        places, run = suffixes.runs(length)
        if not len(places):
            continue
        heads = places[np.flatnonzero(np.append(True, run[1:] != run[:-1]))]
        hashes = [crc[i] for i in words.ids[heads].tolist()]
        for k in range(1, length):
            hashes = [zlib.crc32(b" " + words.spelled[i], h) for i, h in zip(words.ids[heads + k].tolist(), hashes)]
        yield places, (np.array(hashes, np.int64) % buckets)[run]


def _groups(batch: pa.RecordBatch, group: int) -> Iterator[pa.RecordBatch]:
    """Rows of about `group` bytes of text together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + group, "right")))
        yield batch.slice(first, last - first)
        first = last


def _counted(order: int, buckets: int, group: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for rows in _groups(batch, group):
                for _, found in occurrences(Words(rows.column(0)), order, buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return trimmed(counted), "bucket long, n long"


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS, group: int = GROUP) -> DataFrame:
    """(bucket, n): how many n-grams of all texts (text) fall into each bucket that has some."""
    arrow_batches(texts.sparkSession)
    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(*_counted(order, buckets, group)).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, group: int = GROUP) -> DataFrame:
    """(bucket, s, t, gain): the buckets' counts in docs and target, and 1000 times the log of how much likelier the target has them, floored."""
    own = bucket_counts(docs, order, buckets, group).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    other = bucket_counts(target, order, buckets, group).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    each = Cut(own.unionByName(other).unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets").df
    totals = each.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    share = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets).cast("double") / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets).cast("double"))
    return each.crossJoin(F.broadcast(totals)).select("bucket", "s", "t", F.floor(F.lit(1000.0) * F.log(share)).alias("gain"))


def _weighed(gain: np.ndarray, order: int, group: int):
    buckets = len(gain)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _groups(batch, group):
                words = Words(rows.column(1))
                doc = np.repeat(np.arange(rows.num_rows), np.diff(words.bounds))
                n, total = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
                for places, found in occurrences(words, order, buckets):
                    n += np.bincount(doc[places], minlength=len(n))
                    total += np.bincount(doc[places], gain[found], len(n)).astype(np.int64)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(words.bounds)), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return trimmed(weighed), "doc_id long, n_words long, n_features long, weight long"


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times Gumbel noise by the id, floored."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, most: Column) -> DataFrame:
    """rows (doc_id, score, ...) with `rank` 1, 2, ... by falling scores and rising ids, and `most` (of `n_rows`) as the last rank; null beyond.

    Rows of a score are dealt by stretches of ids; counts of those, of which there are STRETCHES a score at most, give each its offset.
    """
    span = rows.agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"), F.count("*").alias("n_rows"))
    wide = (F.col("_high").cast("double") - F.col("_low").cast("double") + 1) / STRETCHES
    at = F.coalesce(F.floor((F.col("doc_id").cast("double") - F.col("_low").cast("double")) / wide), F.lit(STRETCHES))
    dealt = rows.crossJoin(F.broadcast(span)).withColumn("_at", at)
    counts = dealt.groupBy("score", "_at").agg(F.count("*").alias("_n"))
    by_score = counts.groupBy("score").agg(F.sum("_n").alias("_m"))
    # A few ten thousand scores at most, whatever the corpus: gains and noise are logarithms.
    higher = by_score.select("score", (F.sum("_m").over(Window.orderBy(F.desc("score"))) - F.col("_m")).alias("_higher"))
    before = F.sum("_n").over(Window.partitionBy("score").orderBy("_at")) - F.col("_n")
    offsets = counts.withColumn("_before", before).join(F.broadcast(higher), "score").select(F.col("score").alias("_s"), F.col("_at").alias("_a"), (F.col("_higher") + F.col("_before")).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("score", "_at").orderBy(F.asc_nulls_last("doc_id")))
    met = dealt.withColumn("_own", own).join(offsets, (F.col("score") == F.col("_s")) & (F.col("_at") == F.col("_a")))
    rank = F.col("_own") + F.col("_offset")
    return met.withColumn("rank", F.when(rank <= most, rank)).select(*rows.columns, "rank")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, group: int = GROUP
) -> DataFrame:
    """For each row of docs (doc_id, text): n_features, weight, score, rank; those with a rank are drawn.

    Of documents with least_words words or more, `percent` in a hundred are drawn towards target (text).
    """
    arrow_batches(docs.sparkSession)
    gain = np.zeros(buckets, np.int64)
    for r in gains(docs, target, order, buckets, group).select("bucket", "gain").collect():  # as many rows as buckets
        gain[r.bucket] = r.gain
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = texts.mapInArrow(*_weighed(gain, order, group)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = Cut(weighed, "weights").df
    long = ranked(rows.where(F.col("n_words") >= least_words), F.expr(f"{percent} * n_rows div 100"))
    short = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return long.unionByName(short).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
