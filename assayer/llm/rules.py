"""Quality rules: learned decision lists over text statistics, all made and applied by SQL functions.

Sequential covering grows conjunctions of thresholds for low quality on labelled statistics, one after another, prunes each
on rows held back from its growth, and stops where a rule no longer holds there. The list becomes one ordered conditional
expression. The learner itself sees a bounded sample of labelled rows, on the driver.

A null text counts as empty and has no words; it fails the base rules. Long texts count whole. Without labels of both kinds
the list is empty and the base rules alone decide; an empty table gives no rows. Rows of labels for one document are taken
together, the lowest quality counts; labels without a document are left out. Repeated rows are judged alike, rows without
doc_id too. Of equally good conditions the first statistic's and the lowest threshold's counts. Other columns of docs, whatever
their names, are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import bounded_sample, small, text_or_empty

#: Labelled documents used of each quality at most; the most conditions of a rule, and rules; thresholds tried of a statistic.
SAMPLE_DOCS, CONDITIONS, RULES, THRESHOLDS = 1500, 4, 12, 40
#: A rule must be right in this share of the rows that it covers, and cover so many, among those held back.
PRECISION, LEAST_COVERED = 0.9, 3
#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

#: Statistics of the learner in SQL over the base columns, c (capitals), b (! and ?), g (digits), d (distinct words).
STATISTICS = {
    "words": "cast(n_words as double)",
    "mean_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_char": "n_symbols / greatest(word_chars, 1)",
    "repeated_per_word": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "cast(n_dup_lines as double)",
    "capitals_per_char": "c / greatest(word_chars, 1)",
    "bangs_per_word": "b / greatest(n_words, 1)",
    "digits_per_char": "g / greatest(word_chars, 1)",
    "distinct_per_word": "d / greatest(n_words, 1)",
}
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns in keep, the base columns and the learner's statistics of each row of docs (doc_id, text)."""
    t = docs.select("doc_id", *keep, text_or_empty().alias("t"))
    words = t.select("doc_id", *keep, "t", F.array_remove(F.split("t", SPACE + "+"), "").alias("w"), F.expr(f"filter(split(t, '\\n'), x -> x rlike r'{WORD}')").alias("lines"))
    count = lambda p: F.expr(f"regexp_count(t, r'{p}')").cast("long")
    counted = words.select(
        "doc_id",
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        count(r"\p{Lu}").alias("c"),
        count("[!?]").alias("b"),
        count("[0-9]").alias("g"),
        F.size(F.array_distinct("w")).cast("long").alias("d"),
        F.expr("if(size(w) < 3, cast(array() as array<bigint>), transform(slice(w, 1, greatest(size(w) - 2, 1)), (x, i) -> xxhash64(x, w[i + 1], w[i + 2])))").alias("h"),
    )
    columns = ["doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "c", "b", "g", "d"]
    # Windows by hash, each next to its like, only where some occur twice; then their places, in order.
    paired = counted.select(*columns, F.expr("if(size(array_distinct(h)) = size(h), cast(array() as array<struct<h:bigint,i:int>>), sort_array(transform(h, (x, i) -> struct(x as h, i as i))))").alias("s"))
    twice = "filter(s, (x, i) -> (i > 0 and s[greatest(i - 1, 0)].h = x.h) or (i + 1 < size(s) and s[least(i + 1, size(s) - 1)].h = x.h))"
    placed = paired.select(*columns, F.expr(f"sort_array(transform({twice}, x -> x.i))").alias("p"))
    whole = placed.select(*columns, F.expr("aggregate(p, struct(-3 as at, 0L as n), (a, x) -> struct(x as at, a.n + least(3, x - a.at) as n), a -> a.n)").alias("n_repeat_words"))
    return whole.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(F.expr(sql).cast("double").alias(f"s_{name}") for name, sql in STATISTICS.items()))


Rule = list[tuple[str, bool, float]]


def _holds(rule: Rule, row: dict) -> bool:
    return all((row[name] >= cut) if above else (row[name] < cut) for name, above, cut in rule)


def _counts(rule: Rule, rows: list[tuple[dict, int]]) -> tuple[int, int]:
    bad = sum(1 for row, y in rows if y and _holds(rule, row))
    return bad, sum(1 for row, y in rows if not y and _holds(rule, row))


def _grown(rows: list[tuple[dict, int]]) -> Rule:
    """Conditions are added by information gain until no good row is covered."""
    rule: Rule = []
    while len(rule) < CONDITIONS:
        bad = sum(y for _, y in rows)
        if not bad or bad == len(rows):
            break
        before, best = math.log2(bad / len(rows)), (0.0, None)
        for name in STATISTICS:
            values = sorted((row[name], y) for row, y in rows)
            total, seen, seen_bad = len(values), 0, 0
            step = max(1, total // THRESHOLDS)
            for i in range(1, total):
                seen += 1
                seen_bad += values[i - 1][1]
                if values[i][0] == values[i - 1][0] or not (i % step == 0 or values[i][1] != values[i - 1][1]):
                    continue
                cut = (values[i][0] + values[i - 1][0]) / 2
                for above, n, p in ((False, seen, seen_bad), (True, total - seen, bad - seen_bad)):
                    if p:
                        best = max(best, (p * (math.log2(p / n) - before), (name, above, cut)), key=lambda x: x[0])
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [x for x in rows if _holds([best[1]], x[0])]
    return rule


def _pruned(rule: Rule, rows: list[tuple[dict, int]]) -> Rule:
    """The shortest front part of the rule that is best on rows held back."""

    def worth(r: Rule) -> float:
        p, n = _counts(r, rows)
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (worth(r), -len(r)))


def learn(rows: list[tuple[dict, int]]) -> list[Rule]:
    """Ordered rules for rows (statistics, 1 if of low quality), which come in a fixed order: each third is held back."""
    grow, hold, out = [x for i, x in enumerate(rows) if i % 3], [x for i, x in enumerate(rows) if not i % 3], []
    while len(out) < RULES and any(y for _, y in grow):
        rule = _grown(grow)
        if not rule:
            break
        rule = _pruned(rule, hold)
        p, n = _counts(rule, hold)
        if p < LEAST_COVERED or p < PRECISION * (p + n):
            break
        out.append(rule)
        grow, hold = ([x for x in part if not _holds(rule, x[0])] for part in (grow, hold))
    return out


def decision(rules: list[Rule]) -> Column:
    """True (kept) unless a rule holds, as one conditional expression in the rules' order."""
    out = None
    for rule in rules:
        holds = None
        for name, above, cut in rule:
            c = F.col(f"s_{name}") >= cut if above else F.col(f"s_{name}") < cut
            holds = c if holds is None else holds & c
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learnt_rules(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    known = bounded_sample(labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", "quality", SAMPLE_DOCS)
    stats = statistics(docs.select("doc_id", "text").join(small(known), "doc_id"), "quality").select("doc_id", "quality", *(f"s_{name}" for name in STATISTICS)).collect()
    rows = sorted(tuple(r) for r in stats)
    if len({r[1] for r in rows}) < 2:
        return []
    return learn([(dict(zip(STATISTICS, r[2:])), 1 - r[1]) for r in sorted(rows, key=lambda r: (r[0] * 2654435761 % (1 << 32), r))])


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base columns, base_failed and kept of each row of docs (doc_id, text); the list is learnt from labels (doc_id, quality)."""
    rules = learnt_rules(docs, labels)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    out = statistics(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & decision(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
