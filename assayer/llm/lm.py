"""Cross-entropy difference: a target and a background n-gram model over one vocabulary score each document.

Both models are word bigrams interpolated with unigrams and with the uniform distribution over all words of the corpus,
with the same weights; each distribution sums to one. Words and pairs are told apart by 64-bit hashes and counted over
every document in tables that grow with the corpus. Documents lie in groups of about GROUP bytes, as they are read: a group is
one row, its words' hashes and each token's place among them, and texts are never shuffled. A group's n-grams are counted
within it and shuffled by ranges of their hashes, where they are summed over all groups; each group gets back the sums of its
own n-grams only. So a frequent n-gram is one row a group, and nothing of the model is collected. Which documents are of the
target is found by a join of ids, and brought to the groups as places: nothing is broadcast, whatever the target's size.

No document is scored by its own counts: they are taken off the sums of each model that it is part of.

A text without words, or a null one, has 0 tokens and null scores. Repeated rows are counted and scored each, so that copies
count for each other. An empty table gives no rows; without a target its model is uniform, as is the background's for a
document alone. Long texts are read whole. Ties have equal scores. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import Cut, arrow_batches, packed, trim, trimmed, unpacked
from assayer.llm.textwords import mix, slices

#: Shares of the word's and the uniform probability; the pair's takes a part of both, which grows with the first word's count.
WEIGHTS = (0.9, 0.1)
PAIR_SHARE, PAIR_PRIOR = 0.6, 200.0
#: Bytes of text of a group, and of the corpus for each range of hashes (RANGES at least).
GROUP, RANGE, RANGES = 1 << 22, 1 << 25, 1 << 8


def _grouped(group: int):
    """Rows of about `group` bytes of texts: part, ids, each document's tokens, the sorted words, each token's place there."""
    names = {"part": pa.int64(), "ids": pa.list_(pa.int64()), "n": pa.list_(pa.int64()), "words": pa.binary(), "tokens": pa.binary(), "size": pa.int64()}

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        ids, n, found, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            words, word = np.unique(np.concatenate(found), return_inverse=True)
            values = (part, ids, n, _steps(words), packed(word.astype(np.uint32)), size)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, names.values())], list(names))

        for batch in batches:
            own = batch.column(0).to_pylist()
            for first, last, h, at in slices(batch):
                ids += own[first:last]
                n += np.diff(at).tolist()
                found.append(h)
                size += batch.column(1).slice(first, last - first).nbytes
                if size >= group:
                    yield row()
                    part, ids, n, found, size = part + 1, [], [], [], 0
        if ids:
            yield row()

    return trimmed(grouped), "part long, ids array<long>, n array<long>, words binary, tokens binary, size long"


def _grams(group: pa.Table) -> tuple[np.ndarray, ...]:
    """A group's sorted words and each token's place there, the sorted pairs and each pair's place, the pairs' second tokens, and each document's tokens."""
    words, word = _keys(group.column("words")[0].as_py()), unpacked(group.column("tokens")[0].as_py(), np.uint32, 1)[0].astype(np.int64)
    n = np.array(group.column("n")[0].as_py(), np.int64)
    inner = np.ones(len(word), bool)
    starts = np.cumsum(n) - n
    inner[starts[n > 0]] = False
    second, h = np.flatnonzero(inner), words[word]
    pairs, pair = np.unique(mix(h[second - 1] * np.uint64(0x9E3779B97F4A7C15) + h[second]), return_inverse=True)
    return words, word, pairs, pair, second, n


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys by the steps between them, which are small and leave zeros."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64, 1)[0], dtype=np.uint64)


def _counted(bits: int):
    bounds = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def counted(group: pa.Table, target: pa.Table) -> pa.Table:
        """Counts of a group: of its words, as words and as a pair's first, and of its pairs; each of all texts and of the target's."""
        trim()
        words, word, pairs, pair, second, n = _grams(group)
        own = np.zeros(len(n), bool)
        own[target.column("at").to_numpy()] = True
        mine = np.repeat(own, n)
        before = word[second - 1]
        tables = (
            (words, (word, word[mine], before, before[mine[second]])),
            (pairs, (pair, pair[mine[second]])),
        )
        ranges, keys, counts = [], [], []
        for k, (found, places) in enumerate(tables):
            n = np.stack([np.bincount(x, minlength=len(found)) for x in places]).astype(np.int32)
            edges = [*np.searchsorted(found, bounds).tolist(), len(found)]
            for r in range(1 << bits):
                if edges[r] < edges[r + 1]:
                    own = slice(edges[r], edges[r + 1])
                    ranges.append((k << bits) + r)
                    keys.append(_steps(found[own] - bounds[r]))
                    counts.append(packed(n[:, own]))
        groups = pa.array([group.column("part")[0].as_py()] * len(ranges), pa.int64())
        return pa.table({"part": groups, "range": pa.array(ranges, pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return counted, "part long, range int, keys binary, counts binary"


def _summed(bits: int):
    def summed(rows: pa.Table) -> pa.Table:
        """The sums over all groups, given back to each for its own n-grams; part -1 has the words' totals."""
        trim()
        r = rows.column("range")[0].as_py()
        keys = [_keys(x) for x in rows.column("keys").to_pylist()]
        counts = np.hstack([unpacked(x, np.int32, 2 if r >> bits else 4) for x in rows.column("counts").to_pylist()])
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.stack([np.bincount(place, x, len(found)) for x in counts]).astype(np.int64)
        edges = np.cumsum([0, *map(len, keys)])
        parts, back = rows.column("part").to_pylist(), [packed(sums[:, place[a:b]]) for a, b in zip(edges, edges[1:])]
        totals = [0, 0, 0] if r >> bits else [len(found), int(sums[0].sum()), int(sums[1].sum())]
        zeros = [0] * len(parts)
        columns = {"part": [*parts, -1], "range": [r] * (len(parts) + 1), "counts": [*back, b""]} | {name: [*zeros, x] for name, x in zip(("words", "background", "target"), totals)}
        return pa.table({name: pa.array(x, {"range": pa.int32(), "counts": pa.binary()}.get(name, pa.int64())) for name, x in columns.items()})

    return summed, "part long, range int, counts binary, words long, background long, target long"


def _within(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each token, how often its id occurs in its own row."""
    _, place, n = np.unique(rows.astype(np.int64) << 32 | ids, return_inverse=True, return_counts=True)
    return n[place]


def _scored(bits: int, vocabulary: int, totals: tuple[int, int]):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ce_target", pa.float64()), ("ce_background", pa.float64()), ("ce_diff", pa.float64())])

    def scored(group: pa.Table, model: pa.Table) -> pa.Table:
        trim()
        words, word, pairs, pair, second, n = _grams(group)
        blobs = sorted(zip(model.column("range").to_pylist(), model.column("counts").to_pylist()))
        target = np.zeros(len(n), bool)
        if blobs and blobs[0][0] < 0:  # places of the target's documents
            target[[int(x) for x in blobs.pop(0)[1].split(b",")]] = True
        sums = [np.hstack([np.zeros((rows, 0), np.int64), *(unpacked(x, np.int64, rows) for r, x in blobs if r >> bits == k)]) for k, rows in ((0, 4), (1, 2))]
        if sums[0].shape[1] != len(words) or sums[1].shape[1] != len(pairs):
            raise RuntimeError("the texts of a group changed between counting and scoring")
        rows = np.repeat(np.arange(len(n)), n)
        mine = target[rows]
        before = word[second - 1]
        own_word, own_before, own_pair = _within(rows, word), _within(rows[second], before), _within(rows[second], pair)
        means = []
        for side in (1, 0):
            # Without what the document itself has brought.
            part = mine if side else np.ones(len(word), bool)
            total = totals[side] - n[rows] * part
            p = np.where(total > 0, WEIGHTS[0] * (sums[0][side][word] - own_word * part) / np.maximum(total, 1) + WEIGHTS[1] / max(vocabulary, 1), 1 / max(vocabulary, 1))
            first = sums[0][2 + side][before] - own_before * part[second]
            share = PAIR_SHARE * first / (first + PAIR_PRIOR)
            p[second] = (1 - share) * p[second] + share * (sums[1][side][pair] - own_pair * part[second]) / np.maximum(first, 1)
            means.append(np.bincount(rows, -np.log2(p), len(n)) / np.maximum(n, 1))
        empty = n == 0
        return pa.Table.from_arrays([pa.array(group.column("ids")[0].as_py(), pa.int64()), pa.array(n), *(pa.array(x, mask=empty) for x in (*means, means[0] - means[1]))], schema=schema)

    return scored, "doc_id long, n_tokens long, ce_target double, ce_background double, ce_diff double"


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text): n_tokens, bits a token under the target's and the background's model, and their difference.

    target_ids (doc_id) names the target's documents; a lower ce_diff is nearer to them.
    """
    arrow_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    groups = Cut(texts.mapInArrow(*_grouped(GROUP)), "groups").df
    size = groups.agg(F.sum("size")).first()[0] or 0
    bits = max(RANGES, size // RANGE).bit_length() - 1
    wanted = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    places = Cut(groups.select("part", F.posexplode("ids").alias("at", "doc_id")).join(wanted, "doc_id", "left_semi").select(F.col("part").alias("of"), "at"), "target").df
    counted = groups.groupBy("part").cogroup(places.groupBy("of")).applyInArrow(*_counted(bits))
    model = Cut(counted.groupBy("range").applyInArrow(*_summed(bits)), "ngrams").df
    total = model.where("part = -1").agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("words", "background", "target"))).first()
    own = model.where("part >= 0").select(F.col("part").alias("of"), "range", "counts")
    told = places.groupBy("of").agg(F.array_join(F.collect_list(F.col("at").cast("string")), ",").cast("binary").alias("counts")).select("of", F.lit(-1).alias("range"), "counts")
    return groups.groupBy("part").cogroup(own.unionByName(told).groupBy("of")).applyInArrow(*_scored(bits, total[0], (total[1], total[2])))
