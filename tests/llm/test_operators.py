"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm import decontam, html, langid, lm, neardup, packing, queries, quality, rules, secrets, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that the operators use within.
CLASH = ["score", "kept", "k", "node", "t", "w", "h", "words", "label", "host", "path", "rule", "spans", "_rank", "target", "found", "quality"]
RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


def odd_texts():
    """Null, empty, blank, one word, repeats, a very long text, non-ASCII, controls."""
    long = prose(60_000)
    return [None, "", " \t\n\r\x0b ", "word", "word", "A a\u00a0b \x1c c", "\u4f60\u597d " * 8, long, long + " more", "x" * 200_000, "<|endoftext|> it's 12 \u2028 ok", prose(80), "12 345 !!", "\x00 nul"]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    """(id, text) to the least id reachable over similarities of 0.75."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    least = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        changed = False
        for a, sa in sets:
            for b, sb in sets:
                if sa and sb and 100 * len(sa & sb) >= 75 * len(sa | sb) and least[a] < least[b]:
                    least[b], changed = least[a], True
        if not changed:
            return least
    return least


def edited(text, rate, rng):
    return " ".join(rng.choice(WORDS) if rng.random() < rate else w for w in text.split())


def shuffled_bytes(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_crowds_of_long_texts_shuffle_in_proportion(spark, monkeypatch):
    """Unlike texts of one bucket, three times as long: at most four times as much is shuffled; none is linked."""
    monkeypatch.setattr(neardup, "FEW", 0)
    rng, seen = random.Random(5), []
    for n in (2000, 6000):
        base = [f"w{rng.randrange(50_000)}" for _ in range(n)]
        texts = [" ".join(w if rng.random() > 0.018 else f"x{rng.randrange(10**9)}" for w in base) for _ in range(60)]
        df, before = docs(spark, texts), shuffled_bytes(spark)
        assert neardup.near_duplicates(df).where("not kept").count() == sum(a != i for i, a in brute_components(list(enumerate(texts))).items())
        seen.append(shuffled_bytes(spark) - before)
    assert seen[1] <= 4 * seen[0], seen


@pytest.mark.parametrize("few", [neardup.FEW, 0])
def test_near_duplicates_match_brute_force(spark, monkeypatch, few):
    """With 0, all pairs across components are found by their rarest shingles."""
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "HUB", 2)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "MEET", 2)
    rng = random.Random(8)
    bases = [prose(n, rng) for n in (6, 40, 120, 300)]
    texts = [edited(b, rate, rng) for b in bases for rate in (0, 0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.08) for _ in range(3)] + odd_texts()
    found = {r.doc_id: r for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    want = brute_components(list(enumerate(texts)))
    assert {i: r.component_id for i, r in found.items()} == want
    assert all(r.n_shingles == len(shingle_set(texts[i])) and r.kept == (want[i] == i) for i, r in found.items())


def test_near_duplicates_without_ids_and_rows(spark):
    text = prose(50)
    rows = neardup.near_duplicates(docs(spark, [text, text, text, prose(30)], [None, 4, 4, None])).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in rows) == Counter({(None, 4, False): 1, (4, 4, True): 2, (None, None, True): 1})
    assert neardup.near_duplicates(docs(spark, [])).collect() == []


def test_near_duplicates_in_a_crowd_of_unlike_texts(spark):
    """Many texts that share a third of their words, which fill buckets without being linked, and a few links among them."""
    rng = random.Random(17)
    common = prose(50, rng)
    texts = [f"{common} {' '.join(f'w{rng.randrange(10**7)}' for _ in range(60))}" for _ in range(1500)]
    texts += [edited(t, 0.01, rng) for t in texts[:100]]
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    sets = [shingle_set(t) for t in texts]
    alike = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    want = {i: i for i in range(1500)} | {1500 + i: i if alike(sets[i], sets[1500 + i]) else 1500 + i for i in range(100)}
    assert found == want and sum(want[1500 + i] == i for i in range(100)) > 50


def test_long_sketches_turn_away_few(spark):
    rng = np.random.default_rng(3)
    for _ in range(20):
        h = rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
        a, b = h[:875], h[125:]  # similarity 0.75
        for k, bits in neardup.LONGER:
            x, y = (neardup.odd_sketch(neardup.minhash(s, k), bits) for s in (a, b))
            assert sum(int(v).bit_count() for v in np.bitwise_xor(x, y).view(np.uint64)) <= neardup.most_odd(0.75, k, bits)


ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    s = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(s)


def test_secrets(spark):
    key, own = "AKIA" + "Z" * 16, "Zx9_" * 6
    texts = odd_texts() + [f"é secret: token: abcdefgh {key}", f"PASSWORD = '{'0a' * 12}' {key}", f"tok {key} AKIAAKIA{'B' * 16}", f"api_key={'a1' * 20}", f"only here {own} end", "token=ab token=abcdef", f"{own[::-1]} {own[::-1]}"] + [f"copied {'Qw7-' * 7} {i}" for i in range(6)]
    d = docs(spark, texts)
    found = secrets.scanned(d, F.col("source"), F.col("doc_id"))
    rows = {r.doc_id: r for r in secrets.digest(found).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert rows[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [x for x in rows[i].spans.split(",") if x and not x.startswith("token")] == ([] if not text else text.split(","))
    by = {t: rows[i] for i, t in enumerate(texts)}
    assert by[f"only here {own} end"].spans == f"token:10:{10 + len(own)}" and by[f"only here {own} end"].n_live == 1
    assert by[f"copied {'Qw7-' * 7} 0"].spans == ""
    clean = {r.doc_id: r for r in secrets.redacted(d, found).collect()}
    for i, t in enumerate(texts):
        assert secrets.MASK in (clean[i].text or "") if rows[i].spans else clean[i].text == t
        assert not base_spans((clean[i].text or "").replace(secrets.MASK, "\n"))
    assert secrets.digest(secrets.scanned(docs(spark, []), F.col("source"), F.col("doc_id"))).collect() == []
    twice = docs(spark, [f"x {key}"] * 3, [7, 7, None])
    assert [r.n_access for r in secrets.digest(secrets.scanned(twice, F.col("source"), F.col("doc_id"))).collect()] == [1, 1, 1]


def test_quality_held_out(spark):
    got = queries.op2_quality_classifier(spark, SF.replace("0.001", "0.01")).join(spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([(r.predicted == 1) == (r.quality == 1) for r in got]) > 0.95


def test_quality_odd_rows(spark):
    texts = odd_texts() + [prose(60) for _ in range(10)] + ["### $$$ %%% " * 20 for _ in range(10)]
    d = docs(spark, texts)
    y = labels(spark, [(i, 1, 0) for i in range(14, 24)] + [(i, 0, 0) for i in range(24, 34)] + [(30, 0, 0), (None, 1, 0), (3, None, 0)])
    rows = {r.doc_id: r.score for r in quality.quality(d, y).collect()}
    assert len(rows) == len(texts) and all(0 <= s <= 1 for s in rows.values())
    assert all(rows[i] >= 0.3 for i in range(14, 24)) and all(rows[i] < 0.3 for i in range(24, 34)) and rows[0] == rows[1]
    assert {r.score for r in quality.quality(d, y.limit(0)).collect()} == {0.5}
    assert quality.quality(docs(spark, []), y).collect() == []


def test_language_held_out(spark):
    folder = SF.replace("0.001", "0.01")
    got = queries.op3_language_id(spark, folder).join(spark.read.parquet(folder + "/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_language_odd_rows(spark):
    d = docs(spark, odd_texts())
    train = spark.createDataFrame([(i, t, lang) for i in range(30) for t, lang in ((prose(40), "aa"), ("zyx wvu " * 20 + str(i), "bb"), (None, "aa"), ("", "bb"))], "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    rows = langid.identify(d, train).orderBy("doc_id").collect()
    texts = odd_texts()
    assert [r.lang_pred == "und" for r in rows] == [not re.search(r"[^\W\d_]", t or "") for t in texts]
    assert all(0 <= r.score <= 1 for r in rows) and rows[7].lang_pred == "aa"
    assert {r.lang_pred for r in langid.identify(d, train.limit(0)).collect()} == {"und"}
    assert langid.identify(docs(spark, []), train).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a</b) x("</div>")</script></head><body><header><h1>Site</h1></header><nav><a href=/>home</a></nav>
<div class="wrap"><div class="post-{n}"><h1>A &amp; B</h1><p>One <b>bold</b>&nbsp;word.<p>Two {n} {words}<ul><li>x<li>y</ul><div class="ad">buy</div></div><div id="side-bar">aside</div></div>
<section class="comments"><p>me too</p></section><footer>&copy;</footer></body></html>"""


def test_html(spark):
    words = prose(40)
    pages = [(i, f"http://h{i % 2}.x/{i}", PAGE.format(n=i, words=words)) for i in range(6)] + [(6, None, None), (7, "http://h0.x", ""), (8, "nothing", "plain <b>text"), (8, "nothing", "plain <b>text"), (9, "http://h1.x", "<p>" + "long " * 100_000), (10, "http://h1.x", '<div class="q" "unclosed <p')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("path", F.lit(1)).withColumn("host", F.lit(2))
    rows = html.main_text(df).collect()
    text = {r.page_id: r.text for r in rows}
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    assert all(text[i] == f"A & B\nOne bold word.\nTwo {i} {words}\nx\ny" for i in range(6))
    assert text[6] == text[7] == "" and text[8] == "plain text" and text[9] == ("long " * 100_000).strip()
    assert html.main_text(df.limit(0)).collect() == []


def brute_stats(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    c, marked, seen, dup = Counter(zip(w, w[1:], w[2:])), set(), set(), 0
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    for line in (t or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(marked)


def test_quality_rules(spark):
    texts = odd_texts() + ["a b c a b c\nq\nq\n\n\n q", "a a a a a a", "$$$ " * 60, (prose(60) + "\n") * 2] + [prose(70) for _ in range(40)] + [" ".join(f"{w}##" for w in prose(70).split()) for _ in range(40)]
    d = docs(spark, texts)
    y = labels(spark, [(i, 1, 0) for i in range(18, 58)] + [(i, 0, 0) for i in range(58, 98)])
    rows = {r.doc_id: r for r in rules.judged(d, y).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_stats(t), t and t[:60]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert all(rows[i].kept for i in range(18, 58)) and not any(rows[i].kept for i in range(58, 98))
    assert all(r.kept == (not r.base_failed) for r in rules.judged(d, y.limit(0)).collect())
    assert rules.judged(docs(spark, []), y).collect() == []


def test_cross_entropy(spark):
    rng = random.Random(1)
    a, b = WORDS[:100], WORDS[150:250]
    texts = [" ".join(rng.choice(a if i % 2 else b) for _ in range(60)) for i in range(40)] + odd_texts()
    d = docs(spark, texts)
    rows = {r.doc_id: r for r in lm.cross_entropy_difference(d, d.where("doc_id < 20 and doc_id % 2 = 1")).collect()}
    assert all(r.n_tokens == len(re.findall("[^\x20\x09-\x0d]+", texts[i] or "")) and (r.ce_diff is None) == (r.n_tokens == 0) for i, r in rows.items())
    assert max(rows[i].ce_diff for i in range(1, 40, 2)) < min(rows[i].ce_diff for i in range(0, 40, 2))
    assert lm.cross_entropy_difference(docs(spark, []), d.limit(0)).collect() == [] and lm.cross_entropy_difference(d, d.limit(0)).count() == len(texts)


def brute_overlap(text, item):
    norm = lambda t: re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, m = norm(text), norm(item)
    n = min(len(m), 13)
    return n > 0 and any(sum(x != y for x, y in zip(w[i : i + n], m[j : j + n])) <= (2 if len(m) >= 13 else 0) for i in range(len(w) - n + 1) for j in range(len(m) - n + 1))


@pytest.mark.parametrize("block", [20, 10_000])
def test_contamination_matches_brute_force(spark, block):
    rng = random.Random(2)
    items = [prose(n, rng) for n in (1, 4, 12, 13, 20, 40)] + ["", None]
    texts = [t for t in odd_texts() if t is None or len(t) < 5000]
    for item in items[:6]:
        for changed in (0, 1, 2, 3, 5):
            w = item.split()
            for p in rng.sample(range(len(w)), min(changed, len(w))):
                w[p] = "changed"
            texts.append(prose(30, rng) + " " + " ".join(w).upper() + "\n" + prose(9, rng))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontam.contamination(docs(spark, texts), bench, block).collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if brute_overlap(t, x)}
    assert decontam.contamination(docs(spark, []), bench).collect() == [] and decontam.contamination(docs(spark, texts), bench.limit(0)).collect() == []


def test_masks_cover_all_pairs_of_changes():
    for a in range(13):
        for b in range(a + 1, 13):
            assert any(not {a - o, b - o} & set(m) for m in decontam.MASKS for o in range(13 - m[-1]))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.TOKENIZER)
    texts = odd_texts() + [prose(RNG.randint(1, 900)) for _ in range(150)]
    rows = packing.pack(docs(spark, texts).repartition(7), most_open=3).collect()
    ids = [[*exact.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    at, filled = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        at[r.doc_id] = r.start + r.length
    assert at == {i: len(x) for i, x in enumerate(ids)}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048 and sum(n < 2048 for n in filled.values()) <= 1
    assert packing.pack(docs(spark, [])).collect() == []


def test_packer_is_bounded():
    p = packing.Packer(0, 10, 2)
    rows = [r for n in (7, 6, 5, 9, 3, 12, 4) for r in p.place(("d", 0, np.arange(n, dtype=np.uint32), n))]
    assert len(p.open) <= 2 and all(sum(len(x[2]) for x in w.pieces) == w.used < 10 for w in p.open)
    assert sum(r[2] for r in rows) + sum(w.used for w in p.open) == 46


def test_urls(spark):
    given = ["http://A.Example.ORG/es/1", "http://example.org/en/12", "https://x.example.org/de/?q#f", "http://b.com/fr/x", "http://b.com/de/x", "http://spam-casino.example.net/win", "http://city-library.example.net/books", "http://notorg/", "http://x.org", None, "", "no scheme", "a://b://c/d", "http://a.com?x/fr/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(given)] + [(5, given[5])], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("w", F.lit(2))
    rows = urls.judged(df).collect()
    by = {r.page_id: r for r in rows}
    assert len(rows) == len(given) + 1 and all((by[i].host, by[i].path) == urls.parts(u) for i, u in enumerate(given))
    assert [by[i].rule for i in range(9)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None]
    assert [by[i].verdict for i in range(7)] == ["block", "block", "allow", "allow", "block", "block", "allow"]
    assert by[9].verdict == by[10].verdict == by[11].verdict == "allow" and by[12].host == "b:" and by[12].path == "//c/d"
    assert urls.judged(df.limit(0)).collect() == []


def test_pipeline_stages(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    good = [prose(80) for _ in range(30)]
    item = prose(20)
    texts = good + [good[0], edited(good[1], 0.01, RNG), f"{prose(60)} {item}", f"{prose(60)} password=abc123def {prose(5)}", None, ""] + ["### $$$ %%% !!! " * 20] * 3
    base = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)] + [(33, texts[33], "en", "s1", len(texts[33]))], DOCS)
    labels(spark, [(i, 1, 0) for i in range(30)] + [(i, 0, 0) for i in range(36, 39)]).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = base.withColumn("score", F.lit("x")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r.text for r in now.collect()})
        assert name != "MinHash near-dedup" or now.count() == len(seen[-1])
    assert set(range(34)) <= set(seen[0]) and not {36, 37, 38} & set(seen[0])
    assert set(seen[0]) - set(seen[1]) == {30, 31} and set(seen[1]) - set(seen[2]) == {32}
    assert seen[3].keys() == seen[2].keys() and secrets.MASK in seen[3][33] and seen[3][0] == good[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen[3])


def test_every_query_is_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))
    assert Path(corpus_pipeline.__file__).parent == Path(queries.__file__).parents[2]


def brute_cross_entropy(texts, chosen):
    """Bits a token of each text by bigram models counted in plain dictionaries over all other texts; each sums to one."""
    tokens = [re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    words, out = {w for t in tokens for w in t}, []
    for own in (set(chosen), set(range(len(texts)))):
        word, first, pair = (Counter(x for i in own for x in f(tokens[i])) for f in (list, lambda t: t[:-1], lambda t: list(zip(t, t[1:]))))
        total = sum(word.values())

        def bits(i):
            t, taken = tokens[i], tokens[i] if i in own else []
            w, f, p, n = Counter(taken), Counter(taken[:-1]), Counter(zip(taken, taken[1:])), total - len(taken)

            def probability(x, before):
                base = lm.WEIGHTS[0] * (word[x] - w[x]) / n + lm.WEIGHTS[1] / len(words) if n else 1 / len(words)
                if before is None:
                    return base
                k = first[before] - f[before]
                share = lm.PAIR_SHARE * k / (k + lm.PAIR_PRIOR)
                return (1 - share) * base + share * (pair[before, x] - p[before, x]) / max(k, 1)

            if i % 9 == 0 and t:
                assert sum(probability(x, t[0]) for x in words) == pytest.approx(1)
            return -sum(math.log2(probability(x, t[k - 1] if k else None)) for k, x in enumerate(t)) / len(t) if t else None

        out.append([bits(i) for i in range(len(texts))])
    return list(zip(*out))


@pytest.mark.parametrize("group", [1 << 22, 200])
def test_cross_entropy_counts_true_ngrams(spark, monkeypatch, group):
    """Whatever the groups and ranges, each document gets the counts of the whole corpus."""
    monkeypatch.setattr(lm, "GROUP", group, raising=False)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS) if rng.random() < 0.7 else f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 120))) for _ in range(60)] + [t if t is None or len(t) < 10_000 else t[:4000] for t in odd_texts()]
    texts += texts[:5]
    d = docs(spark, texts)
    rows = {r.doc_id: r for r in lm.cross_entropy_difference(d, d.where("doc_id % 3 = 0")).collect()}
    for i, (target, background) in enumerate(brute_cross_entropy(texts, range(0, len(texts), 3))):
        assert rows[i].ce_target == pytest.approx(target) and rows[i].ce_background == pytest.approx(background)
        assert rows[i].ce_diff is None if target is None else rows[i].ce_diff == pytest.approx(target - background)
    alone = lm.cross_entropy_difference(docs(spark, ["a b a"]), d.limit(0)).collect()[0]
    assert alone.ce_target == alone.ce_background == 1.0 and alone.ce_diff == 0.0


def test_html_keeps_whole_articles(spark):
    """Title, lead and end around a dense element, prose around lists, tables and quotes, and a host's second template."""
    words = [f"w{i}" for i in range(200)]
    long, item = " ".join(words), "".join(f"<li>{w} {w}</li>" for w in words)
    nav = "<div>" + "<a href='/'>some link of the site</a>" * 9 + "</div>"
    bodies = {
        "a": (f"<article><h1>Title</h1><p>lead</p><div class=body>{long}</div><section>end</section></article>", f"Title\nlead\n{long}\nend"),
        "b": (f"<div class=page><h1>Title</h1><p>lead</p><div class=body><div class=x>{long}</div></div><section>end</section></div>{nav}", f"Title\nlead\n{long}\nend"),
        "c": (f"<div class=page><p>before</p><ul>{item}</ul><p>after</p></div>", "before\n" + "\n".join(f"{w} {w}" for w in words) + "\nafter"),
        "d": (f"<div class=page><p>before</p><table><tr><td>{long}</table><p>after</p></div>", f"before\n{long}\nafter"),
        "e": (f"<div class=page><p>before</p><blockquote>{long}</blockquote><p>after</p></div>", f"before\n{long}\nafter"),
    }
    pages = [(f"http://{k}.x/{i}", f"<html><body>{page}</body></html>", text) for k, (page, text) in bodies.items() for i in range(3)]
    pages += [(f"http://two.x/{i}", f"<html><body><div class=post>{long}</div></body></html>", long) for i in range(6)]
    pages += [(f"http://two.x/o{i}", f"<html><body><div class=post>short</div><main>{long} {long}</main></body></html>", f"{long} {long}") for i in range(3)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string, want string")
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert [i for i, p in enumerate(pages) if got[i] != p[2]] == []


@pytest.mark.parametrize("n", [3, 5, 6, 7, 10, 12])
def test_short_items_with_one_word_changed(spark, tmp_path, n):
    """In the query: from six words on, an item is found with any one word changed, and with no two."""
    item = [f"i{k}" for k in range(n)]

    def text(changed):
        return " ".join(["pre", "fix", *("other" if k in changed else w for k, w in enumerate(item)), "end"])

    changes = [()] + [(k,) for k in range(n)] + [(k, k + 1) for k in range(n - 1)]
    docs(spark, [text(c) for c in changes]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id for r in queries.op8_benchmark_decontamination(spark, str(tmp_path)).collect()}
    assert found == {i for i, c in enumerate(changes) if len(c) <= (n >= 6)}


def test_pipeline_null_and_repeated_ids(spark, tmp_path):
    """Copies and leaks go whether rows have ids or not, and rows of one id with different texts are told apart."""
    rng = random.Random(8)
    a, b, c, d, item = (prose(60, rng) for _ in range(5))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = f"{a} {item}"
    rows = [(None, b), (None, b), (7, c), (7, d), (7, d), (None, c)]
    kept = corpus_pipeline.near_dedup_stage(spark, docs(spark, [t for _, t in rows], [i for i, _ in rows]), str(tmp_path)).collect()
    assert sorted(r.text for r in kept) == sorted([b, c, d])
    rows = [(None, leak), (None, b), (7, leak), (7, c), (8, d)]
    kept = corpus_pipeline.decontamination_stage(spark, docs(spark, [t for _, t in rows], [i for i, _ in rows]), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, b), (7, c), (8, d)])


def test_secrets_of_many_matches_take_linear_time(spark):
    """20,000 matches in one text: spans as by brute force, texts masked once for each stretch of them."""
    rng = random.Random(1)
    t = " ".join(f"password=abc{i}def" if i % 2 else f"{rng.getrandbits(120):030x}" if i % 3 else f"zX{i}_{rng.getrandbits(90):024X}q" for i in range(20_000))
    d = docs(spark, [t, f"token=abc{'f' * 30} {'f' * 30}"])
    began = time.perf_counter()
    found = secrets.scanned(d, F.col("source"), F.col("doc_id"))
    rows = {r.doc_id: r.spans.split(",") for r in secrets.digest(found).collect()}
    clean = {r.doc_id: r.text for r in secrets.redacted(d, found).collect()}
    assert time.perf_counter() - began < 30
    assert [x for x in rows[0] if not x.startswith("token")] == [f"{k}:{a}:{b}" for a, _, b, k in base_spans(t)]
    at, out = 0, []
    for a, b in sorted(tuple(map(int, x.split(":")[1:])) for x in rows[0]):
        if a >= at:
            out.append(t[at:a] + secrets.MASK)
        at = max(at, b)
    assert clean[0] == "".join(out) + t[at:] and clean[1] == f"{secrets.MASK} {secrets.MASK}"


def test_candidates_apart_from_base_spans(spark):
    """A candidate goes where any base span meets it, whatever their order and lengths."""
    rng = random.Random(6)
    texts = []
    for _ in range(150):
        parts = ["password=" + "".join(rng.choice("abC1/.") for _ in range(rng.randint(3, 30))), "AKIA" + "Z9" * rng.randint(5, 12), "".join(rng.choice("0af") for _ in range(rng.randint(18, 30))), "".join(rng.choice("xY7-_") for _ in range(rng.randint(15, 30)))]
        texts.append(rng.choice(["", " ", "/"]).join(rng.choice(parts) for _ in range(rng.randint(1, 9))))
    rows = {r.doc_id: r for r in secrets.digest(secrets.scanned(docs(spark, texts), F.col("source"), F.col("doc_id"))).collect()}
    values = Counter()
    want = {}
    for i, t in enumerate(texts):
        base = base_spans(t)
        more = [(m.start(), 3, m.end(), "token") for m in re.finditer("[A-Za-z0-9_-]{20,}", t) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        want[i] = base, [x for x in more if not any(y[0] < x[2] and x[0] < y[2] for y in base)]
        values.update({t[a:b] for a, _, b, _ in want[i][1]} | {ASSIGN.match(t, a)[1] if k == "assign" else t[a:b] for a, _, b, k in base})
    for i, t in enumerate(texts):
        base, more = want[i]
        live = [x for x in more if values[t[x[0] : x[2]]] == 1]
        spans = rows[i].spans.split(",") if rows[i].spans else []
        assert {f"{k}:{a}:{b}" for a, _, b, k in base + live} <= set(spans) <= {f"{k}:{a}:{b}" for a, _, b, k in base + more}


def test_url_scores_match_the_model(spark):
    """The SQL score is that of the weights, on all pages and on long URLs; the labelled table has no host of the pages."""
    given = [r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect()] + ["http://" + "é-casino." * 500 + "x/" + "p" * 5000, None, "http://ab/", "://"]
    df = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    weights, bias = urls.learn()
    z = urls.features(["" if u is None else u for u in given]) @ weights + bias
    rows = {r.page_id: r for r in urls.judged(df).collect()}
    for i, u in enumerate(given):
        assert rows[i].score == pytest.approx(1 / (1 + np.exp(-np.clip(z[i], -40, 40))), abs=1e-9)
        h, p = urls.parts(u)
        fits = [(len(b + c), -n, a, b + c) for n, (a, b, c) in enumerate(urls.RULES) if (h == b or h.endswith("." + b)) and p.startswith(c)]
        assert (rows[i].rule, rows[i].verdict) == ((max(fits)[3], max(fits)[2]) if fits else (None, "block" if rows[i].score >= 0.5 else "allow"))
    own = {urls.parts(u)[0].split(".")[0] for u in urls.BLOCK + urls.ALLOW}
    assert not own & {x for u in given[:-4] for x in urls.parts(u)[0].split(".")} - {"www", "m", "blog"}


def test_url_model_by_cross_validation():
    x, y = urls.features(urls.BLOCK + urls.ALLOW), np.array([1.0] * len(urls.BLOCK) + [0.0] * len(urls.ALLOW))
    right = 0
    for k in range(8):
        out = np.arange(len(y)) % 8 == k
        w, bias = urls.fit(x[~out], y[~out])
        right += ((x[out] @ w + bias >= 0) == (y[out] == 1)).sum()
    assert right / len(y) > 0.75
