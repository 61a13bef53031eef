"""Bounded-space online packing: each partition keeps a fixed number of open windows, places a piece where it fits best,
and emits the fullest window when none fits; what stays open is merged at the end.

The fullest window is filled before it is emitted, with the first part of the piece that fits nowhere: documents may be cut
freely. At the end of a partition its open windows are poured together, so that one part of a window is left over; these
leftovers are poured together again, some partitions' at a time, until few are left. Only the last are padded.

A null or empty text is the end id alone. Repeated rows are packed each, and so are rows without doc_id, whose pieces have
none. Long texts are cut at window ends. Of windows that fit equally well the first opened takes the piece. An empty table
gives no rows. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.align import place
from assayer.llm.common import Cut, arrow_batches, trimmed

#: The file, and where it lies on this machine; workers look for it on theirs.
FILE = "byte_bpe_50k.json"
TOKENIZER = place(FILE)
WINDOW, OPEN_WINDOWS, END_ID = 2048, 64, 1
#: Leftovers that are poured together in one task.
GROUP = 256
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, left binary"
_SCHEMA = pa.schema([*((x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("left", pa.binary())])
#: Characters whose classes all regular expression engines agree on.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]")


@lru_cache(1)
def _tokenizer(path: str):
    """The tokenizer's encoder of lists of plain texts, and that of any texts."""
    path = place(path)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    ranks = path.removesuffix(".json") + ".tiktoken"
    anything = lambda texts: [x.ids for x in exact.encode_batch_fast(texts, add_special_tokens=False)]
    if not os.path.exists(ranks):
        return anything, anything
    import base64

    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return (lambda texts: [fast.encode_ordinary(x) for x in texts]), anything


def token_ids(texts: list[str | None], path: str = FILE) -> list[np.ndarray]:
    """Each text's ids, and the end id: by the vocabulary's ranks where that gives the same ids sooner, else by the tokenizer."""
    fast, anything = _tokenizer(path)
    texts = [x or "" for x in texts]
    plain = [not _PLAIN.search(x) and "<|" not in x for x in texts]
    by = {True: iter(fast([x for x, p in zip(texts, plain) if p])), False: iter(anything([x for x, p in zip(texts, plain) if not p]))}
    return [np.array([*next(by[p]), END_ID], np.uint32) for p in plain]


class Window:
    """An open window: pieces (doc_id, start, ids, the document's ids in all)."""

    __slots__ = ("pieces", "used")

    def __init__(self):
        self.pieces, self.used = [], 0

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.used += len(piece[2])


def _split(piece: tuple, n: int) -> tuple[tuple, tuple]:
    doc, start, ids, total = piece
    return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total)


class Packer:
    """Emits closed windows' rows; sequence ids count up from `first`."""

    def __init__(self, first: int, window: int = WINDOW, most_open: int = OPEN_WINDOWS):
        self.next, self.window, self.most_open, self.open = first, window, most_open, []

    def rows(self, w: Window) -> list[tuple]:
        out, offset = [], 0
        for doc, start, ids, total in w.pieces:
            out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset, None))
            offset += len(ids)
        self.next += 1
        return out

    def place(self, piece: tuple) -> list[tuple]:
        out = []
        while len(piece[2]) >= self.window:
            whole, piece = _split(piece, self.window)
            w = Window()
            w.add(whole)
            out += self.rows(w)
        n = len(piece[2])
        if not n:
            return out
        fits = [w for w in self.open if w.used + n <= self.window]
        if fits:
            best = max(fits, key=lambda w: w.used)
            best.add(piece)
        elif len(self.open) < self.most_open:
            best = Window()
            best.add(piece)
            self.open.append(best)
        else:
            best = max(self.open, key=lambda w: w.used)
            head, tail = _split(piece, self.window - best.used)
            best.add(head)
            self.open.append(Window())
            self.open[-1].add(tail)
        if best.used == self.window:
            self.open.remove(best)
            out += self.rows(best)
        return out

    def merged(self) -> tuple[list[tuple], Window | None]:
        """Pours the open windows together: rows of the full ones, and what is left."""
        out, last = [], None
        for w in sorted(self.open, key=lambda w: -w.used):
            if last is None:
                last = w
                continue
            for piece in w.pieces:
                head, tail = _split(piece, min(len(piece[2]), self.window - last.used))
                last.add(head)
                if last.used == self.window:
                    out += self.rows(last)
                    last = Window()
                    if len(tail[2]):
                        last.add(tail)
        self.open = []
        return out, last if last is not None and last.used else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _SCHEMA)] if rows else [pa.array([], f.type) for f in _SCHEMA], schema=_SCHEMA)


def _left(window: Window | None) -> list[tuple]:
    return [(doc, start, len(ids), None, total, None, None, ids.astype("<u4").tobytes()) for doc, start, ids, total in window.pieces] if window else []


def _packed(path: str, window: int, most_open: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 32, window, most_open)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(ids), 64):
                rows = []
                for doc, own in zip(ids[i : i + 64], token_ids(texts[i : i + 64].to_pylist(), path)):
                    rows += packer.place((doc, 0, own, len(own)))
                yield _batch(rows)
        rows, left = packer.merged()
        yield _batch(rows + _left(left))

    return trimmed(packed), _PIECES


def _poured(level: int, window: int, last: bool):
    """Pours a partition's leftovers together; the last level closes what is left."""

    def poured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer((level << 56) + (TaskContext.get().partitionId() << 32), window)
        current = Window()
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                piece = (x["doc_id"], x["start"], np.frombuffer(x["left"], "<u4"), x["doc_tokens"])
                head, tail = _split(piece, min(len(piece[2]), window - current.used))
                current.add(head)
                if current.used == window:
                    rows += packer.rows(current)
                    current = Window()
                    if len(tail[2]):
                        current.add(tail)
            yield _batch(rows)
        yield _batch(packer.rows(current) if last and current.used else _left(current))

    return trimmed(poured), _PIECES


def pack(docs: DataFrame, path: str = FILE, window: int = WINDOW, most_open: int = OPEN_WINDOWS) -> DataFrame:
    """Rows of pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of each document lies in one piece; a sequence's pieces follow one another from offset 0 up to `window` at most.
    """
    arrow_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [Cut(texts.mapInArrow(*_packed(path, window, most_open)), "pieces").df]
    level = 0
    while True:
        left = parts[-1].where("left is not null")
        n = left.count()
        if not n:
            break
        level += 1
        groups = 1 + left.agg(F.sum(F.octet_length("left"))).first()[0] // (4 * window * GROUP)
        poured = left.select(*_SCHEMA.names).repartition(groups).sortWithinPartitions("doc_id", "start").mapInArrow(*_poured(level, window, groups == 1))
        parts.append(Cut(poured, "leftovers").df)
        if groups == 1:
            break
    out = parts[0].where("left is null")
    for x in parts[1:]:
        out = out.unionByName(x.where("left is null"))
    return out.drop("left")
