"""The draw towards a target, against counts by dictionaries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.llm import queries, resample

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def features(text, order=2):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return len(w), [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def expected(rows, target, order=2, buckets=10_000, least=20, percent=25):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(doc, *features(t, order)) for doc, t in rows]
    s = Counter(of(f) for *_, fs in own for f in fs)
    t = Counter(of(f) for x in target for f in features(x, order)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * float(all_s + buckets) / (float(s[b] + 1) * float(all_t + buckets)))) for b in range(buckets)]
    out = []
    for doc, n, fs in own:
        weight = sum(gain[of(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    rank = {id(x): i + 1 for i, x in enumerate(long[: percent * len(long) // 100])}
    return sorted(((x[0], x[2], x[3], x[4], rank.get(id(x))) for x in out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def test_query_matches_counts_by_dictionaries(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert rows_of(queries.op13_target_resampling(spark, SF)) == expected(rows, target)


@pytest.mark.parametrize("order,group", [(1, resample.GROUP), (2, 200), (3, 5000), (5, resample.GROUP)])
def test_odd_texts_and_longer_runs(spark, order, group):
    rng = random.Random(order)
    word = lambda: rng.choice(["a", "B", "cc", "Zürich", "日本", "x1", "the", "of"])
    texts = [None, "", " .,;\x00", "A", "a a a a a", "A-b_c'd 12.5", "é" * 30_000, " ".join(word() for _ in range(20_000)), "end"] + [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[20])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for c in ("rank", "score", "n_rows", "bucket", "_at", "weight"):
        df = df.withColumn(c, F.lit("x"))
    target = ["the of zürich", None, "", "the of the of"]
    got = resample.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), order=order, buckets=97, group=group)
    assert rows_of(got) == expected(rows, target, order, 97)


def test_suffixes_are_in_order_with_their_common_prefixes():
    rng = random.Random(9)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(20)]
    words = resample.Words(pa.array(texts))
    suffixes = resample.Suffixes(words, 4)
    beyond = lambda p: tuple(words.ids[p : p + min(4, suffixes.left[p])].tolist())
    every = [beyond(p) for p in suffixes.array.tolist()]
    assert every == sorted(every) and sorted(suffixes.array.tolist()) == list(range(len(words.ids)))
    for i in range(1, len(every)):
        same = next((k for k, (x, y) in enumerate(zip(every[i - 1], every[i])) if x != y), min(len(every[i - 1]), len(every[i])))
        assert suffixes.lcp[i] == same
    places, run = suffixes.runs(2)
    assert len(np.unique(run)) == len({beyond(p)[:2] for p in places.tolist()})


def test_ties_and_repeats_get_one_rank_each(spark):
    rows = spark.createDataFrame([(i % 50, 5 - i % 3) for i in range(1000)] + [(None, 4)] * 5, "doc_id long, score long")
    got = resample.ranked(rows, F.lit(700)).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 701))
    order = [(-r.score, r.doc_id is None, r.doc_id or 0) for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)]
    assert order == sorted(order)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(i, "one two three " * 8) for i in range(9)], "doc_id long, text string")
    assert resample.resampled(none, some).collect() == []
    assert rows_of(resample.resampled(some, none)) == expected([(i, "one two three " * 8) for i in range(9)], [])
