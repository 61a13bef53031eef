"""Benchmark decontamination by spaced seeds: hashes of words under masks that skip positions, joined and then verified.

An item is found in a document where WINDOW aligned words in a row differ in at most SUBSTITUTIONS of them. For each pair
of differing positions one of the masks lies in the window clear of both, so no such overlap is missed. Items of fewer
words are found where they stand whole, from the caller's `short` words on with at most one word changed: each of three
masks leaves out a third of the item, so one is clear of the change. Shorter ones must be unchanged.

A benchmark of up to BLOCK_WORDS words is sent to the executors, whose hash tables documents are tried against as they are
read. A larger one stays a table: its seeds' hashes are joined to those of the documents that pass a bitmap of fixed size,
with salts, and each document is then tried against the items that it shares a seed with.

Null and empty texts, on either side, overlap with nothing, and neither side may be empty of rows with any but an empty
result. Repeated rows, of either side, each give their own rows; a null id stays null. Long texts are read whole; where a
text and an item repeat the same words, so that their seeds meet at more shifts than there are, all shifts are tried. Other
columns, whatever their names, are left out. Of overlaps with as many equal words the first in the document is given.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import Cut, arrow_batches, trimmed
from assayer.llm.textwords import slices, windows

WINDOW, SUBSTITUTIONS = 13, 2
#: Positions that count, of a window's words.
MASKS = ((0, 1, 2, 3, 5, 6, 7), (0, 1, 2, 4, 7, 9, 10), (0, 1, 4, 5, 6, 8, 9))
#: Words from which the queries let an item of under WINDOW words have one changed.
SHORT = 6
#: Words of a benchmark that is sent to the executors, some 100 bytes each; a larger one is joined.
BLOCK_WORDS = 400_000
#: Salts of a seed's join; bits of the bitmap of a joined benchmark's seeds (16 MB).
SALTS, BITMAP_BITS = 8, 27
#: Items whose words one row holds for a text, about.
TOGETHER = 64
#: Meetings of seeds of a text and an item, for each possible shift, beyond which all shifts are tried.
MEETINGS = 2
_FILTER_BITS = 22


def masks(n: int, short: int) -> tuple[tuple[int, ...], ...]:
    """The masks of an item of n words."""
    if n >= WINDOW:
        return MASKS
    if n >= short:
        return tuple(tuple(k for k in range(n) if k * 3 // n != left) for left in range(3))
    return (tuple(range(n)),) if n else ()


def substitutions(n: int, short: int) -> int:
    return SUBSTITUTIONS if n >= WINDOW else int(n >= short)


def seeds(h: np.ndarray, mask: tuple[int, ...] | np.ndarray) -> np.ndarray:
    """The hashes of all windows under a mask."""
    return windows(h, int(mask[-1]) + 1, np.asarray(mask))


class Items:
    """The seeds of some items: for each mask the sorted distinct (hash, item), and the places of each within the item."""

    def __init__(self, ids: list, words: list[np.ndarray], short: int, filtered: bool = True):
        self.ids, self.words, self.short = ids, words, short
        by_mask = defaultdict(list)
        for n, h in enumerate(words):
            for mask in masks(len(h), short):
                found = seeds(h, mask)
                by_mask[mask].append((found, np.full(len(found), n), np.arange(len(found))))
        self.seeds = []
        for mask, parts in by_mask.items():
            h, n, k = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((k, n, h))
            h, n, k = h[order], n[order], k[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (n[1:] != n[:-1])]) if len(h) else np.zeros(0, np.int64)
            there = None
            if filtered:
                there = np.zeros(1 << _FILTER_BITS, bool)
                there[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
                there = np.packbits(there)
            self.seeds.append((mask, h[first], n[first], k, np.r_[first, len(h)], there))

    def met(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, item, shifts at which they may overlap), texts' words being h[at[i]:at[i + 1]]."""
        rows, positions, places, n_p, n_k = [], [], [], 0, 0
        for mask, keys, item, place, edge, bits in self.seeds:
            own = seeds(h, mask)
            p = np.arange(len(own))
            if bits is not None:
                p = np.flatnonzero(np.unpackbits(bits).view(bool)[(own >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            low, high = np.searchsorted(keys, own[p], "left"), np.searchsorted(keys, own[p], "right")
            text = np.searchsorted(at, p, "right") - 1
            good = (high > low) & (p + mask[-1] < at[text + 1])
            order = np.lexsort((p[good], low[good], text[good]))
            p, text, low, n = (x[good][order] for x in (p, text, low, high - low))
            # A row for each distinct seed of a text and each of its items: where the text has it, and where the item.
            first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (low[1:] != low[:-1])][: len(p)])
            n, last = n[first], np.r_[first[1:], len(p)][: len(first)]
            group = np.repeat(np.arange(len(first)), n)
            row = low[first][group] + np.arange(len(group)) - (np.cumsum(n) - n)[group]
            rows.append(np.stack([text[first][group], item[row], first[group] + n_p, last[group] + n_p, edge[row] + n_k, edge[row + 1] + n_k]))
            positions.append(p)
            places.append(place)
            n_p, n_k = n_p + len(p), n_k + len(place)
        if not rows:
            return
        t, i, *bounds = np.concatenate(rows, axis=1)
        order = np.lexsort((i, t))
        t, i, p1, p2, k1, k2 = (x[order] for x in (t, i, *bounds))
        p, k = np.concatenate(positions), np.concatenate(places)
        first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (i[1:] != i[:-1])][: len(t)])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(t)]):
            text, words = int(t[a]), len(self.words[i[a]])
            size = min(WINDOW, words)
            least, most = int(at[text]) - (words - size), int(at[text + 1]) - size
            if ((p2 - p1)[a:b] * (k2 - k1)[a:b]).sum() > MEETINGS * (most - least + 1):
                yield text, int(i[a]), np.arange(least, most + 1)
            else:
                yield text, int(i[a]), np.unique(np.concatenate([np.subtract.outer(p[p1[j] : p2[j]], k[k1[j] : k2[j]]).ravel() for j in range(a, b)]))

    def found(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, object, int, int, int]]:
        """(text, item id, first word, words, equal words) of the best overlap of each text and item."""
        for t, n, shifts in self.met(h, at):
            words, begin, end = self.words[n], int(at[t]), int(at[t + 1])
            size, best = min(WINDOW, len(words)), None
            allowed = substitutions(len(words), self.short)
            for shift in shifts.tolist():
                first, last = max(shift, begin), min(shift + len(words), end)
                if last - first < size or best is not None and last - first < best[0]:
                    continue
                equal = h[first:last] == words[first - shift : last - shift]
                total = int(np.count_nonzero(equal))
                if total < size - allowed or best is not None and total <= best[0]:
                    continue
                sums = np.cumsum(np.r_[0, equal])
                if (sums[size:] - sums[:-size]).max() >= size - allowed:
                    best = total, first - begin, last - first
                    if total == len(words):
                        break
            if best is not None:
                yield t, self.ids[n], best[1], best[2], best[0]


_OVERLAPS = "doc_id long, item_id long, start_word long, n_words long, n_equal long"
_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in _OVERLAPS.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, schema=_SCHEMA)


def _words_of(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for _, _, h, at in slices(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})):
        out += [h[a:b] for a, b in zip(at, at[1:])]
    return out


def _overlaps(items):
    """Documents against items that were sent."""

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for first, _, h, at in slices(batch):
                rows += [(batch.column(0)[first + t].as_py(), *x) for t, *x in items.value.found(h, at)]
            yield _batch(rows)

    return trimmed(overlaps), _OVERLAPS


def _item_rows(short: int):
    """Each item that has words: its words' hashes, and its distinct seeds."""

    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _words_of(batch.column(1).to_pylist())
            found = [np.unique(np.concatenate([seeds(h, mask) for mask in masks(len(h), short)] or [h])).view(np.int64) for h in words]
            rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h in words], pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["item_id", "words", "seeds"])
            yield rows.filter(pa.array([len(h) > 0 for h in words], pa.bool_()))

    return trimmed(item_rows), "item_id long, words binary, seeds array<long>"


def _doc_rows(kinds: list[tuple[int, ...]], bitmap):
    """Each document's distinct seeds under any mask that pass the bitmap."""

    def doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            out = []
            for first, last, h, at in slices(batch):
                for i in range(last - first):
                    own = h[at[i] : at[i + 1]]
                    found = np.unique(np.concatenate([seeds(own, mask) for mask in kinds]))
                    cell = (found >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                    out.append(found[(there[cell >> 3] >> (cell & 7)) & 1 > 0].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "k", "seeds"])

    return trimmed(doc_rows), "doc_id long, k long, seeds array<long>"


def _verified(short: int):
    """Documents against the items that they share a seed with."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for first, last, h, at in slices(batch):
                for i in range(first, last):
                    given = batch.column(2)[i].as_py()
                    items = Items([x["item_id"] for x in given], [np.frombuffer(x["words"], np.uint64) for x in given], short, filtered=False)
                    own = h[at[i - first] : at[i - first + 1]]
                    rows += [(batch.column(0)[i].as_py(), *x) for _, *x in items.found(own, np.array([0, len(own)]))]
            yield _batch(rows)

    return trimmed(verified), _OVERLAPS


def _joined(texts: DataFrame, benchmark: DataFrame, short: int) -> DataFrame:
    spark = texts.sparkSession
    items = Cut(benchmark.mapInArrow(*_item_rows(short)).withColumn("no", F.monotonically_increasing_id()), "items").df
    keys = items.select("no", F.explode("seeds").alias("seed"))
    cells = keys.select(F.shiftrightunsigned("seed", 64 - BITMAP_BITS).alias("c")).groupBy(F.floor(F.col("c") / 32768).alias("part")).agg(F.expr("bitmap_construct_agg(c % 32768)").alias("bits"))
    bitmap = bytearray((1 << BITMAP_BITS) // 8)
    for row in cells.toLocalIterator():
        bitmap[row.part * 4096 : (row.part + 1) * 4096] = row.bits
    lengths = items.select(F.least(F.octet_length("words") / 8, F.lit(WINDOW)).cast("int").alias("n")).distinct().collect()
    kinds = sorted({mask for r in lengths for mask in masks(r.n, short)})
    if not kinds:
        return spark.createDataFrame([], _OVERLAPS)
    keyed = texts.select("doc_id", F.xxhash64("text").alias("k"), "text")
    own = keyed.mapInArrow(*_doc_rows(kinds, spark.sparkContext.broadcast(bytes(bitmap)))).select("doc_id", "k", F.explode("seeds").alias("seed"))
    salt = F.pmod(F.xxhash64("doc_id", "k"), F.lit(SALTS)).cast("int")
    spread = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = own.withColumn("salt", salt).join(spread, ["seed", "salt"]).select("doc_id", "k", "no", "salt").distinct()
    every = items.select("no", "item_id", "words", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # A text that meets many items meets them some at a time: no row holds the words of more than about TOGETHER.
    together = F.pmod(F.xxhash64("no"), F.lit(items.count() // TOGETHER + 1)).alias("_part")
    given = met.join(every, ["no", "salt"]).groupBy(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), together).agg(F.collect_list(F.struct("item_id", "words")).alias("items"))
    given = Cut(given.drop("_part"), "met").df
    tried = keyed.join(given, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_k"))).select("doc_id", "text", "items")
    return tried.mapInArrow(*_verified(short))


def contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, short: int = WINDOW) -> DataFrame:
    """Rows for documents (doc_id, text) that hold an item of benchmark (item_id, text): the best overlap of each pair.

    doc_id, item_id, start_word (in the document, from 0), n_words (aligned) and n_equal of them. Items of `short` words or
    more may have one word changed; unless given, only those of WINDOW words may have any.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = bench.agg(F.sum(F.expr(r"regexp_count(text, '[^\x20\x09-\x0D]+')")), F.sum(F.octet_length("text"))).first()
    if (size[0] or 0) > block_words or (size[1] or 0) > 64 * block_words:
        return _joined(texts, bench, short)
    rows = [(r[0], h) for r in bench.collect() for h in _words_of([r[1]]) if len(h)]
    return texts.mapInArrow(*_overlaps(spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], short))))
