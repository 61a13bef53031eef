"""Tokens of two tokenizers aligned by the bytes that they share, and how strongly their ids are linked over a corpus.

A text's tokens of either tokenizer tile its bytes. B's tokens are a static interval index: their sorted starts and ends. Each
A token's range stabs it by two bisections and lists the B tokens that it overlaps: the links. A token and all that it overlaps
make a span; a gap between tokens that no span covers is a boundary between groups. Texts are laid end to end, some at a time,
and their gaps are boundaries of themselves, so that numpy bisects for all their tokens at once.

A link's count is the number of documents that hold its pair of ids linked. Tasks put about GROUP bytes of texts into one row:
the texts' figures, their distinct links packed, and the group's distinct pairs with their documents. Pairs are summed by
shuffles of one row a pair and group, and each group gets the sums of its own pairs back. Nothing of the pairs is collected or
broadcast but each A id's highest count, of which there are as many as A has ids.

Null and empty texts, and those whose tokens' bytes are not the text's (characters that a tokenizer writes in another way),
have no tokens: zeros, no groups, an empty digest. Strings of special tokens are plain text. Repeated rows count each. Of links
with equally high counts all are best. Long texts are read whole. An empty table gives no rows. Other columns, whatever their
names, are left out.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import Cut, arrow_batches, packed, trim, trimmed, unpacked

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of texts in a group, and of those whose tokens are aligned at once.
GROUP, SLICE = 1 << 24, 1 << 20
#: Bits of an id in a pair.
BITS = 20
#: Characters whose classes all regular expression engines agree on.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]")


def place(file: str) -> str:
    """A tokenizer file's path on this machine: an absolute path as it is, a name among the public tokenizers."""
    if os.path.isabs(file):
        return file
    import public_tokenizers

    return public_tokenizers.path(file)


class ByteLevel:
    """A byte-level tokenizer: ids of texts, and each id's bytes. Plain texts go by the vocabulary's ranks where they are there, which is faster."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        # Printable bytes stand for themselves; the others for characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        vocabulary = self.exact.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and not _PLAIN.search(text):
            return self.fast(text)
        return self.exact.encode(text, add_special_tokens=False).ids


class Pieces:
    """A piece tokenizer, which puts a space before a text: ids of texts, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.exact = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.exact.id_to_piece(i) for i in range(self.exact.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.exact.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def encode(self, text: str) -> list[int]:
        return self.exact.encode(text)


@lru_cache(2)
def _pair(a_file: str, b_file: str) -> tuple[ByteLevel, Pieces, np.ndarray, np.ndarray]:
    a, b = ByteLevel(place(a_file)), Pieces(place(b_file))
    return a, b, np.array([len(x) for x in a.bytes], np.int64), np.array([len(x) for x in b.bytes], np.int64)


def tokens(text: str | None, a: ByteLevel, b: Pieces) -> tuple[list[int], list[int]]:
    """The ids of A and B; none unless both spell the text, with a space before it, byte by byte."""
    if not text:
        return [], []
    whole = (" " + text).encode()
    ids = a.encode(" " + text), b.encode(text)
    same = all(b"".join([k.bytes[i] for i in x]) == whole for k, x in zip((a, b), ids))
    return ids if same else ([], [])


class Aligned:
    """Tokens of some texts laid end to end: links as places of their A and B tokens, and each token's group."""

    def __init__(self, texts: list[tuple[list[int], list[int]]], a_length: np.ndarray, b_length: np.ndarray):
        self.n_a, self.n_b = (np.array([len(x[k]) for x in texts], np.int64) for k in (0, 1))
        self.a, self.b = (np.array([i for x in texts for i in x[k]], np.int64) for k in (0, 1))
        a_end, b_end = np.cumsum(a_length[self.a]), np.cumsum(b_length[self.b])
        self.a_start, self.b_start = a_end - a_length[self.a], b_end - b_length[self.b]
        self.a_end, self.b_end = a_end, b_end
        # B's index, stabbed by A's ranges.
        first, last = np.searchsorted(b_end, self.a_start, "right"), np.searchsorted(self.b_start, a_end, "left")
        n = np.maximum(last - first, 0)
        self.link_a = np.repeat(np.arange(len(self.a)), n)
        self.link_b = np.arange(len(self.link_a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        # A span ends with the last of its B tokens; the next token starts a group where no span so far goes on.
        some = len(self.a) and len(self.b)
        reach = np.maximum.accumulate(np.maximum(a_end, b_end[np.minimum(last, len(self.b)) - 1])) if some else a_end
        self.a_group = np.cumsum(np.concatenate([np.zeros(min(len(self.a), 1), bool), self.a_start[1:] >= reach[:-1]])) if len(self.a) else np.zeros(0, np.int64)
        self.b_group = self.a_group[np.searchsorted(a_end, self.b_start, "right")] if some else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.n_a)


@lru_cache(2)
def _words(a: int, b: int) -> tuple[np.ndarray, ...]:
    """Decimal ids and what follows them: a comma within a side, a bar after A's, a semicolon after a group."""
    return tuple(np.array([f"{i}{end}" for i in range(n)], object) for n, end in ((a, ","), (a, "|"), (b, ","), (b, ";")))


def _digests(x: Aligned, words: tuple[np.ndarray, ...]) -> list[str]:
    """sha256 of each text's groups as `a1,a2|b1;a3|b2`; empty without tokens."""
    ga, gb = x.a_group, x.b_group
    at_a, at_b = np.arange(len(ga)) + np.searchsorted(gb, ga, "left"), np.arange(len(gb)) + np.searchsorted(ga, gb, "right")
    line = np.empty(len(ga) + len(gb), object)
    for at, ids, group, comma, last in ((at_a, x.a, ga, *words[:2]), (at_b, x.b, gb, *words[2:])):
        end = np.append(group[1:] != group[:-1], True)[: len(group)]
        line[at] = np.where(end, last[ids], comma[ids])
    out, at = [], 0
    for n in (x.n_a + x.n_b).tolist():
        out.append(hashlib.sha256("".join(line[at : at + n].tolist())[:-1].encode()).hexdigest() if n else "")
        at += n
    return out


def _sliced(batch: pa.RecordBatch, a: ByteLevel, b: Pieces) -> Iterator[tuple[list, list, int]]:
    """(doc_ids, tokens, bytes) of some rows of (doc_id, text) at a time."""
    ids, found, size = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        ids.append(doc)
        found.append(tokens(text, a, b))
        size += len(text or "")
        if size >= SLICE:
            yield ids, found, size
            ids, found, size = [], [], 0
    if ids:
        yield ids, found, size


_FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_pairs")
_ROWS = "part long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, n_pairs array<long>, digests array<string>, places binary, times binary, pairs array<long>, docs array<long>"


def _grouped(a_file: str, b_file: str, group: int):
    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, a_length, b_length = _pair(a_file, b_file)
        words = _words(len(a_length), len(b_length))
        part = TaskContext.get().partitionId() << 32
        schema = pa.schema([("part", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((n, pa.list_(pa.int64())) for n in _FIGURES), ("digests", pa.list_(pa.string())), ("places", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
        empty = lambda: ([], {n: [] for n in _FIGURES}, [], [], [])

        def row(ids: list, figures: dict, digests: list, keys: list, times: list) -> pa.RecordBatch:
            nonlocal part
            pairs, at, docs = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            bound = np.zeros(len(at), bool)
            bound[(np.cumsum(figures["n_pairs"]) - figures["n_pairs"])[np.array(figures["n_pairs"]) > 0]] = True
            # Places rise within a document: steps between them are small.
            steps = np.where(bound, at, np.diff(at, prepend=0)).astype(np.uint32)
            values = [part, ids, *figures.values(), digests, packed(steps), packed(np.concatenate(times).astype(np.uint32)), pairs, docs]
            part += 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        now, size = empty(), 0
        for batch in batches:
            for ids, found, n in _sliced(batch, a, b):
                x = Aligned(found, a_length, b_length)
                key = (x.doc[x.link_a] << 2 * BITS) | (x.a[x.link_a] << BITS) | x.b[x.link_b]
                key, times = np.unique(key, return_counts=True)
                each = lambda values, rows=len(ids): np.bincount(values, minlength=rows).tolist()
                starts = np.append(True, x.a_group[1:] != x.a_group[:-1])[: len(x.a)]
                own = dict(zip(_FIGURES, (x.n_a.tolist(), x.n_b.tolist(), each(x.doc[starts]), each(x.doc[x.link_a]), each(key >> 2 * BITS))))
                now[0].extend(ids)
                for name, values in own.items():
                    now[1][name].extend(values)
                now[2].extend(_digests(x, words))
                now[3].append(key & ((1 << 2 * BITS) - 1))
                now[4].append(times)
                size += n
                if size >= group:
                    yield row(*now)
                    now, size = empty(), 0
        if now[0]:
            yield row(*now)

    return trimmed(grouped), _ROWS


def _weighed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A group's rows of documents, from its row and its pairs' (i, n, best)."""
    trim()
    x = {n: docs.column(n)[0].as_py() for n in ("doc_ids", *_FIGURES, "digests")}
    order = pc.sort_indices(pairs, [("i", "ascending")])
    n, best = (pairs.column(c).take(order).to_numpy() for c in ("n", "best"))
    sizes = np.array(x["n_pairs"], np.int64)
    at, times = (unpacked(docs.column(c)[0].as_py(), np.uint32, 1)[0].astype(np.int64) for c in ("places", "times"))
    starts = np.cumsum(sizes) - sizes
    # Steps back to places: running sums, less what came before each document.
    run = np.cumsum(at)
    before = np.concatenate([[0], run])[np.minimum(starts, len(run))]
    at = run - np.repeat(before, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    total = lambda v: np.bincount(row, v, len(sizes)).astype(np.int64) if len(row) else np.zeros(len(sizes), np.int64)
    columns = [x["doc_ids"], x["n_a"], x["n_b"], x["n_groups"], x["n_links"], total(times * best[at]), total(times * n[at]), x["digests"]]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return pa.table({c: pa.array(v, pa.string() if c == "groups_sha256" else pa.int64()) for c, v in zip(names, columns)})


def _texts(docs: DataFrame) -> DataFrame:
    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def linked(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Groups of documents, a row each, and the corpus's pairs (pair, a, b, n, best): n documents hold them linked; best is 1 for an A id's highest n."""
    rows = Cut(_texts(docs).mapInArrow(*_grouped(a_file, b_file, group)), "aligned").df
    each = rows.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("x.pairs", "x.docs")
    summed = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n"))
    counts = Cut(summed.select("pair", F.shiftright("pair", BITS).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << BITS) - 1)).alias("b"), "n"), "pairs").df
    # One row for each id of A at most.
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    return rows, counts.join(F.broadcast(highest), "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))


def alignment(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, group: int = GROUP) -> DataFrame:
    """For each row of docs (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows, counts = linked(docs, a_file, b_file, group)
    own = rows.select(F.col("part").alias("group"), F.posexplode("pairs").alias("i", "pair")).join(counts.select("pair", "n", "best").hint("merge"), "pair").select("group", "i", "n", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.drop("pairs", "docs").groupBy("part").cogroup(own.groupBy("group")).applyInArrow(_weighed, schema)


def token_groups(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """A row for each group of each text: doc_id, start and end (bytes of the text with a space before it), a_ids, b_ids."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, a_length, b_length = _pair(a_file, b_file)
        for batch in batches:
            for ids, found, _ in _sliced(batch, a, b):
                x = Aligned(found, a_length, b_length)
                if not len(x.a):
                    continue
                at, bt = (np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g)).astype(np.int32) for g in (x.a_group, x.b_group))
                doc = x.doc[at[:-1]]
                sizes = np.bincount(x.doc, a_length[x.a], len(ids)).astype(np.int64)
                base = (np.cumsum(sizes) - sizes)[doc]
                start, end = x.a_start[at[:-1]] - base, x.a_end[at[1:] - 1] - base
                lists = [pa.ListArray.from_arrays(pa.array(o), pa.array(v.astype(np.int32))) for o, v in ((at, x.a), (bt, x.b))]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in doc], pa.int64()), pa.array(start), pa.array(end), *lists], ["doc_id", "start", "end", "a_ids", "b_ids"])

    return _texts(docs).mapInArrow(trimmed(groups), "doc_id long, start long, end long, a_ids array<int>, b_ids array<int>")
