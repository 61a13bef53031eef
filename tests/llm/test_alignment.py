"""Tokens of two tokenizers aligned, against a version that looks at every pair of tokens."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayer.llm import align, queries

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "a", "a  b", " lead", "trail ", "   ", "\n\n\t x", "▁under", "<|endoftext|> <s> </s> <0x0A>", "日本語のテキスト naïve ﬁ é é", "\x00 nul \x7f", "don't 12345 ---- ++", "x" * 5000, "word " * 3000, "😀😀 mixed😀", "a b　c d", "\r\n" * 7, "tab\tand  two   three    four"]


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of(c):
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return ord(c) if ord(c) in plain else [b for b in range(256) if b not in plain][ord(c) - 256]


def by_hand(text, models):
    """(A ids, B ids, links, groups) of a text, each token by its byte range."""
    a, b = models
    if not text:
        return [], [], [], []
    x = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(byte_of(c) for c in a.id_to_token(i))) for i in x.ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    if b"".join(v for _, v in left) != whole or b"".join(v for _, v in right) != whole:
        return [], [], [], []
    ranges = []
    for side in (left, right):
        at, own = 0, []
        for i, v in side:
            own.append((i, at, at + len(v)))
            at += len(v)
        ranges.append(own)
    links, j = [], 0
    for i, s, e in ranges[0]:
        while ranges[1][j][2] <= s:
            j += 1
        for k, u, v in ranges[1][j:]:
            if u >= e:
                break
            links.append((i, k))
    cuts = sorted({e for *_, e in ranges[0]} & {e for *_, e in ranges[1]})
    groups, at = [], 0
    for cut in cuts:
        groups.append(tuple([i for i, s, e in side if at <= s and e <= cut] for side in ranges) if len(cuts) < 400 else None)
        at = cut
    if len(cuts) >= 400:
        ends, groups = set(cuts), []
        iters = [iter(side) for side in ranges]
        for cut in cuts:
            own = ([], [])
            for k, it in enumerate(iters):
                for i, s, e in it:
                    own[k].append(i)
                    if e == cut:
                        break
            groups.append(own)
    return [i for i, *_ in ranges[0]], [i for i, *_ in ranges[1]], links, groups


def expected(rows, models):
    found = [(doc, *by_hand(t, models)) for doc, t in rows]
    n = Counter(pair for *_, links, _ in found for pair in set(links))
    most = Counter()
    for (a, _), k in n.items():
        most[a] = max(most[a], k)
    out = []
    for doc, a, b, links, groups in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc, len(a), len(b), len(groups), len(links), sum(n[p] == most[p[0]] for p in links), sum(n[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("group", [align.GROUP, 3000])
def test_odd_texts_match_all_pairs_of_tokens(spark, models, group):
    rng = random.Random(5)
    words = [t for t in ODD if t and len(t) < 30]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("part", "pair", "n", "a", "best", "places"):
        df = df.withColumn(c, F.lit("x"))
    got = sorted((tuple(r) for r in align.alignment(df, group=group).select(COLUMNS).collect()), key=repr)
    assert got == expected(rows, models)


def test_query_matches_all_pairs_of_tokens(spark, models):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op11_token_alignment(spark, SF).select(COLUMNS).collect()), key=repr)
    assert got == expected(rows, models)


def test_groups_are_what_the_digest_says_and_cover_the_text(spark, models):
    rows = [(i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in align.token_groups(df).orderBy("doc_id", "start").collect():
        found.setdefault(r.doc_id, []).append(r)
    for doc, t in rows:
        *_, groups = by_hand(t, models)
        own = found.get(doc, [])
        assert [(r.a_ids, r.b_ids) for r in own] == [tuple(g) for g in groups]
        if own:
            assert own[0].start == 0 and own[-1].end == len((" " + t).encode()) and all(x.end == y.start for x, y in zip(own, own[1:]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align.alignment(df).collect() == [] and align.token_groups(df).collect() == []
