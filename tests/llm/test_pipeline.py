"""Each stage and the whole pipeline against brute force, on odd rows: null ids and texts, repeats, ties, long texts, empty tables."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm import packing, secrets
from tests.llm.test_contamination import brute
from tests.llm.test_operators import DOCS, base_spans, brute_components, docs, edited, labels, odd_texts, prose


def corpus(spark, folder):
    rng = random.Random(31)
    item = prose(20, rng)
    good = [prose(rng.randint(60, 120), rng) for _ in range(25)]
    texts = [*good, *(edited(t, 0.01, rng) for t in good[:5]), good[6], good[6], f"{good[7]} {item}", f"{prose(70, rng)} {item.upper()}", *(f"{prose(90, rng)} password={'abcdefgh' * k} {prose(9, rng)}" for k in (1, 2)), *odd_texts(), *["### $$$ %%% !!! " * 20] * 4]
    ids = [*range(len(texts) - 6), None, None, 3, 3, 500, 501]
    labels(spark, [(i, 1, 0) for i in range(25)] + [(i, 0, 0) for i in (500, 501, 3)] + [(None, 0, 0)]).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    df = docs(spark, texts, ids)
    df.write.parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), item


def masked(t):
    at, out = 0, []
    for a, _, b, _ in base_spans(t):
        if a >= at:
            out.append(t[at:a] + secrets.MASK)
        at = max(at, b)
    return "".join(out) + t[at:]


def test_stages_match_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    now, item = corpus(spark, tmp_path)
    names = now.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == names
        out.write.parquet(f"{tmp_path}/{name}")
        kept[name] = [(r.doc_id, r.text) for r in now.collect()], [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()]
        now = spark.read.parquet(f"{tmp_path}/{name}")

    before, after = kept["MinHash near-dedup"]
    distinct = sorted(set(before), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    least = brute_components([(n, t) for n, (_, t) in enumerate(distinct)])
    groups = {}
    for n, r in enumerate(distinct):
        groups.setdefault(least[n], []).append(r)
    assert len(after) == len(groups) and all(sum(after.count(r) for r in g) == 1 for g in groups.values())
    named = [g for g in groups.values() if all(r[0] is not None for r in g) and len({r[0] for r in g}) == len(g)]
    assert all(min(g, key=lambda r: r[0]) in after for g in named if not {3} & {r[0] for r in g})

    before, after = kept["benchmark decontamination"]
    assert sorted(map(str, after)) == sorted(str(r) for r in before if not brute(r[1], item, 6)) and len(after) < len(before)

    before, after = kept["secret scans"]
    assert sorted(map(str, after)) == sorted(str((i, t if t is None else masked(t))) for i, t in before) and any(secrets.MASK in (t or "") for _, t in after)

    exact = Tokenizer.from_file(packing.TOKENIZER)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = sorted((str(i), len(exact.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in after)
    total = {}
    for r in pieces:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert sum(r.length for r in pieces) == sum(n for _, n in want) and max(total.values()) <= 2048
    assert sorted({(str(r.doc_id), r.doc_tokens) for r in pieces}) == sorted(set(want))
    whole = {i: np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in after if i is not None and [x[0] for x in after].count(i) == 1}
    assert all(r.ids_crc32 == zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes()) for r in pieces if r.doc_id in whole)


def test_stages_on_empty_tables(spark, tmp_path):
    corpus(spark, tmp_path)
    none = spark.createDataFrame([], DOCS).withColumn("score", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, str(tmp_path))
        assert out.columns == none.columns and out.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, none, str(tmp_path)).collect() == []


def test_stages_without_labels_or_benchmark(spark, tmp_path):
    """Without labels every document is kept, without a benchmark none leaks."""
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = docs(spark, ["", None, prose(50), prose(50)], [1, 2, None, 4])
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.decontamination_stage):
        assert sorted(map(str, stage(spark, given, str(tmp_path)).collect())) == sorted(map(str, given.collect()))
