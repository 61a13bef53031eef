"""The learned queries against versions of another make: features and statistics by Python, the network by plain loops."""

import math
import re
import zlib

import numpy as np
import pytest
import regex

from assayer.llm import langid, quality, queries, rules
from tests.llm.test_operators import brute_stats

SF = "/root/testdata/sf0.001"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def learned_labels(spark):
    """The lowest quality of each document of the four fifths."""
    out = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r.doc_id is not None and r.quality in (0, 1) and not held_out(r.doc_id):
            out[r.doc_id] = min(r.quality, out.get(r.doc_id, 1))
    return out


def brute_features(t):
    t = t or ""
    n, lines = len(t), 1 + t.count("\n")
    words = re.findall("[^\x20\x09-\x0d]+", t.lower())
    w, d = len(words), len(set(words))
    if not n:
        return [0.0] * len(quality.FEATURES)
    share = lambda p, m: len(regex.findall(p, t)) / max(m, 1)
    return [math.log(1 + w), min(20.0, n / max(w, 1)), *(math.sqrt(share(p, n)) for p in (r"[#*$%&|<>]", "[!?]", r"\p{Lu}", "[0-9]")), d / max(w, 1), math.log(1 + d) / max(math.log(1 + w), 0.5), math.log(1 + w / lines), min(1.0, share("[.]", w))]


def test_quality_scores_match_brute_force(spark):
    docs, y = documents(spark), learned_labels(spark)
    rows = sorted((r.doc_id, y[r.doc_id], *brute_features(r.text)) for r in docs if r.doc_id in y)
    x, label = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    weights, shift, cut = quality.learn(x, label)
    # The weights tell preferred documents from others: the pairs' logistic loss is below that of no weights.
    good, bad = x[label == 1] @ weights, x[label == 0] @ weights
    assert np.log1p(np.exp(-np.clip(good[:, None] - bad[None], -40, 40))).mean() < math.log(2) / 2
    want = {r.doc_id: 1 / (1 + math.exp(-max(-40, min(40, float(np.dot(brute_features(r.text), weights)) + shift - cut + math.log(3 / 7))))) for r in docs}
    got = queries.op2_quality_classifier(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6) and r.held_out == held_out(r.doc_id)
        assert r.predicted == int(r.score >= 0.3)


def brute_windows(data):
    """Pieces of 256 bytes, lower-cased, all that is no ASCII letter a blank."""
    data = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in data)
    return [data[i : i + 256].ljust(256) for i in range(0, len(data), 256)]


def brute_probabilities(net, window):
    pooled = []
    wide = sorted(langid.WIDTHS, reverse=True)
    for f in range(net.size):
        width = wide[f // langid.FILTERS]
        tables = [net.kernel[k][:, f].tolist() for k in range(width)]
        places = range(256 - wide[0] + 1)
        pooled.append(max(0.0, max(sum(t[window[p + k]] for k, t in enumerate(tables)) for p in places) + float(net.bias[f])))
    z = np.array(pooled) @ net.out.astype(float) + net.last
    e = np.exp(z - z.max())
    return e / e.sum()


def test_languages_match_plain_loops(spark):
    docs = [r for r in documents(spark)]
    found = set()
    for r in docs:
        if r.lang is not None and r.text and not held_out(r.doc_id):
            found |= {(r.lang, r.doc_id, r.text[len(r.text) * k // 3 :][:256]) for k in range(3)}
    found = sorted(found)
    net = langid.train([t for _, _, t in found], [lang for lang, _, _ in found])
    got = {r.doc_id: r for r in queries.op3_language_id(spark, SF).collect()}
    assert len(got) == len(docs)
    short = sorted((r for r in docs if r.text), key=lambda r: (len(r.text), r.doc_id))[:40]
    for r in short:
        total = np.zeros(len(net.languages))
        for w in brute_windows(r.text.encode()):
            letters = sum(b != 32 for b in w)
            total += letters * brute_probabilities(net, w)
        if not regex.search(r"\p{L}", r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        best = int(total.argmax())
        assert got[r.doc_id].score == pytest.approx(total[best] / total.sum(), abs=1e-4)
        assert got[r.doc_id].lang_pred == net.languages[best]


def test_equal_languages_go_to_the_first():
    net = langid.Net(["aa", "bb"])
    net.out[:], net.last[:] = 0, 0
    assert langid._judged(net, ["word", None, "1 2"]) == (["aa", "und", "und"], [0.5, 0.0, 0.0])


def brute_statistics(t):
    t = t or ""
    n, chars, symbols, lines, repeated = brute_stats(t)
    words = re.findall("[^\x20\x09-\x0d]+", t)
    w, c = max(n, 1), max(chars, 1)
    count = lambda p: len(regex.findall(p, t))
    values = [float(n), chars / w, symbols / c, repeated / w, float(lines), count(r"\p{Lu}") / c, count("[!?]") / w, count("[0-9]") / c, len(set(words)) / w]
    return dict(zip(rules.STATISTICS, values)), (n, chars, symbols, lines, repeated)


def test_rules_verdicts_match_brute_force(spark):
    docs, y = documents(spark), learned_labels(spark)
    order = lambda r: (r[0] * 2654435761 % (1 << 32), (r[0], r[1], *r[2].values()))
    rows = sorted(((r.doc_id, y[r.doc_id], brute_statistics(r.text)[0]) for r in docs if r.doc_id in y), key=order)
    learnt = rules.learn([(s, 1 - q) for _, q, s in rows])
    assert learnt and all(1 <= len(r) <= rules.CONDITIONS for r in learnt)
    got = queries.op5_quality_rules(spark, SF).collect()
    assert len(got) == len(docs)
    text = {r.doc_id: r.text for r in docs}
    for r in got:
        stats, base = brute_statistics(text[r.doc_id])
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        caught = any(all((stats[n] >= cut) if above else (stats[n] < cut) for n, above, cut in rule) for rule in learnt)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert (r.base_failed, r.kept) == (failed, not failed and not caught)


def test_long_and_repeated_rows_are_scored_alike(spark):
    rows = [(1, "word " * 40_000), (1, "word " * 40_000), (2, ""), (None, "word")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    scores = sorted((r.doc_id or 0, r.score) for r in quality.quality(df, y).collect())
    assert len(scores) == 4 and scores[1] == scores[2]
    assert sum(r.n_words == 40_000 for r in rules.judged(df, y).collect()) == 2


def test_many_equal_rows_lie_in_many_groups(spark, monkeypatch):
    """50,000 rows of one text, without an id and with one of the target: no group holds more than its bytes, and all score alike."""
    from assayer.llm import lm

    monkeypatch.setattr(lm, "GROUP", 50_000)
    seen = []
    inner = lm.Cut

    def watched(df, name):
        out = inner(df, name)
        if name == "groups":
            seen.extend(r[0] for r in out.df.selectExpr("size(ids)").collect())
        return out

    monkeypatch.setattr(lm, "Cut", watched)
    text = "the same words in each of these rows"
    df = spark.range(50_000).selectExpr("case when id % 2 = 0 then 5 end as doc_id", f"'{text}' as text")
    rows = lm.cross_entropy_difference(df, spark.createDataFrame([(5,), (5,), (6,)], "doc_id long")).groupBy("doc_id").agg({"*": "count", "ce_diff": "min", "n_tokens": "max"}).collect()
    assert sorted((r["count(1)"], r["max(n_tokens)"]) for r in rows) == [(25_000, 8), (25_000, 8)]
    assert len(seen) > 20 and max(seen) < 50_000 / 8
