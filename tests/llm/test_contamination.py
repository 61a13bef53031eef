"""Benchmark overlaps against brute force, in all columns, sent or joined; texts and items of repeated words; long texts."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import decontam
from tests.llm.test_operators import docs, odd_texts, prose


def normal(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, item, short):
    """(start_word, n_words, n_equal) of the overlap with most equal words, the first of such; None without one."""
    w, m, best = normal(text), normal(item), None
    size = min(len(m), decontam.WINDOW)
    allowed = 2 if len(m) >= 13 else int(len(m) >= short)
    if not m or len(w) < size:
        return None
    names = {x: n for n, x in enumerate({*w, *m})}
    w, m = np.array([names[x] for x in w]), np.array([names[x] for x in m])
    for shift in range(-(len(m) - size), len(w) - size + 1):
        a, b = max(shift, 0), min(shift + len(m), len(w))
        equal = w[a:b] == m[a - shift : b - shift]
        if np.convolve(equal, np.ones(size, int), "valid").max() >= size - allowed and (best is None or equal.sum() > best[2]):
            best = (a, b - a, int(equal.sum()))
    return best


@pytest.mark.parametrize("block", [0, 10_000])
@pytest.mark.parametrize("short", [decontam.SHORT, decontam.WINDOW])
def test_all_columns_match_brute_force(spark, block, short):
    rng = random.Random(12)
    items = [prose(n, rng) for n in (1, 4, 7, 12, 13, 20, 40)] + ["", None, "same " * 30, "a b " * 9, "word"]
    items.append(items[5])
    texts = [t for t in odd_texts() if t is None or len(t) < 5000] + ["same " * 50, "a b a b " * 9, "a a b " * 20]
    for item in items[:7]:
        for changed in (0, 1, 2, 3, 5):
            w = item.split()
            for p in rng.sample(range(len(w)), min(changed, len(w))):
                w[p] = "changed"
            texts.append(prose(30, rng) + " " + " ".join(w).upper() + "\n" + prose(9, rng))
    texts += [" ".join(items[6].split()[20:]) + " " + prose(20, rng), prose(20_000, rng) + " " + items[5] + " " + prose(20_000, rng), texts[-1]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted(tuple(r) for r in decontam.contamination(docs(spark, texts), bench, block, short).collect())
    want = sorted((i, j, *found) for i, t in enumerate(texts) for j, x in enumerate(items) if (found := brute(t, x, short)))
    assert got == want


@pytest.mark.parametrize("block", [0, 10_000])
def test_rows_without_id_and_repeated_rows(spark, block):
    item = prose(20)
    bench = spark.createDataFrame([(5, item), (5, item), (None, item)], "item_id long, text string")
    given = docs(spark, [item, item, item, "x"], [None, 3, 3, None])
    rows = decontam.contamination(given, bench, block).collect()
    assert sorted((r.doc_id or -1, r.item_id or -1, r.n_equal) for r in rows) == sorted([(d, i, 20) for d in (-1, 3, 3) for i in (5, 5, -1)])
    assert decontam.contamination(docs(spark, []), bench, block).collect() == []
    assert decontam.contamination(given, bench.limit(0), block).collect() == []
    assert decontam.contamination(given, spark.createDataFrame([(1, None), (2, " ")], "item_id long, text string"), -1).collect() == []


def test_repeated_words_take_no_square_time():
    words = np.full(20_000, 7, np.uint64)
    items = decontam.Items([1], [words[:2000]], decontam.WINDOW)
    began = time.process_time()
    ((_, _, start, n, equal),) = items.found(words, np.array([0, len(words)]))
    assert (start, n, equal) == (0, 2000, 2000) and time.process_time() - began < 2
    mixed = np.tile(np.array([7, 8], np.uint64), 10_000)
    began = time.process_time()
    assert len(list(items.found(mixed, np.array([0, len(mixed)])))) == 0 and time.process_time() - began < 5


def test_a_phrase_in_all_texts_and_all_items_is_met_in_bounded_rows(spark, monkeypatch):
    """Joined as sent, though each text meets each item; no row holds the words of many items."""
    monkeypatch.setattr(decontam, "TOGETHER", 5)
    seen, inner = [], decontam.Cut

    def watched(df, name):
        out = inner(df, name)
        if name == "met":
            seen.append(out.df.selectExpr("max(size(items))", "count(*)").first())
        return out

    monkeypatch.setattr(decontam, "Cut", watched)
    rng = random.Random(12)
    phrase = prose(13, rng)
    items = spark.createDataFrame([(i, f"{prose(9, rng)} {phrase} {prose(4, rng)}") for i in range(60)], "item_id long, text string")
    texts = docs(spark, [f"{prose(40, rng)} {phrase} {prose(30, rng)}" for _ in range(25)] + [prose(50, rng), None])
    rows = lambda words: sorted(tuple(r) for r in decontam.contamination(texts, items, block_words=words).collect())
    joined = rows(0)
    assert joined == rows(1 << 30) and len(joined) == 25 * 60
    assert seen[0][0] <= 5 * 5 and seen[0][1] >= 25 * 60 / 25
