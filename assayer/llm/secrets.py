"""Secret scan with corpus-wide ownership frequency, by SQL functions alone.

Every text gives the spans of three fixed kinds (assign, access, hex) and candidates of one more (token: long runs of mixed
letters and digits apart from those). All values' hashes are aggregated over the corpus by distinct repositories and
owners: a value of one owner in few repositories looks live, one that many share is a copied example. Spans of the fixed
kinds stay in any case; candidates are added where they look live.

A null text counts as empty; a text without spans has the hash of the empty string and an empty span list. A null owner
or repository counts as one more owner or repository. Repeated rows are counted once and each give their row, rows without
doc_id too, which are known by their text. Long texts are read whole, in time n log n of their matches. Spans that start alike
are in the order of KINDS. An empty table gives no rows. Other columns, whatever their names, are left out of the report and
kept by redacted().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import Cut, small

# The patterns of the three kinds, and the least length of the value or match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A further candidate: a run of so many of these characters with both letters and digits.
TOKEN, TOKEN_LEAST = r"[A-Za-z0-9_-]{20,}", 20
#: Owners and repositories that a live-looking value has at most.
LIVE_OWNERS, LIVE_REPOSITORIES = 1, 3
#: Parts among which a value's rows are dealt when its figures are joined to them, if it has more than HOT rows.
SALTS, HOT = 32, 10_000
KINDS = ("assign", "access", "hex", "token")
MASK = "[SECRET]"
#: Masked spans of a stretch of text that is cut at once.
STRETCH = 128
#: Maximal runs of the least length have the same matches as runs of any length that are dropped when short, and cost less.
_QUICK = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "token": TOKEN}


def _let(name: str, value: str, body: str) -> str:
    """SQL of body, in which name stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, step: str) -> str:
    """SQL of the running figures of an array, by doubling: n log n steps. step joins x with an earlier one, {}, null where there is none."""
    grown = f"transform(s, (x, i) -> {step.format('get(s, i - shiftleft(1, k))')})"
    return _let("values", values, f"aggregate(sequence(0, cast(log2(greatest(size(values), 1)) as int)), values, (s, k) -> {grown})")


def _matches(kind: str) -> str:
    """SQL of an array of (start, no, end, kind, value) of one kind's matches in t; positions from the pieces between them."""
    p = "r'" + _QUICK[kind].replace("'", r"\x27") + "'"
    least = LEAST.get(kind, TOKEN_LEAST)
    value = f"regexp_extract(m, {p}, 1)" if kind == "assign" else "m"
    good = f"length(x.value) >= {least}" + (" and x.value rlike '[0-9]' and x.value rlike '[A-Za-z]'" if kind == "token" else "")
    lengths = f"zip_with(ms, slice(split(t, {p}, -1), 1, size(ms)), (m, gap) -> length(m) + length(gap))"
    ends = _running(lengths, "x + coalesce({}, 0)")
    spans = f"zip_with(ms, {ends}, (m, to) -> struct(to - length(m) as start, {KINDS.index(kind)} as no, to as end, '{kind}' as kind, {value} as value))"
    return f"case when t rlike {p} then filter({_let('ms', f'regexp_extract_all(t, {p}, 0)', spans)}, x -> {good}) else {_NO_SPANS} end"


_NO_SPANS = "cast(array() as array<struct<start:int,no:int,end:int,kind:string,value:string>>)"
_NONE = "cast(array() as array<struct<start:int,no:int,end:int,kind:string,live:boolean>>)"


#: SQL of the candidates that lie apart from all base spans: on the line of both, the furthest end so far and the next start.
_APART = _let(
    "line",
    "sort_array(concat(transform(base, x -> struct(x.start as start, -1 as at, x.end as end)), transform(token, (x, i) -> struct(x.start as start, i as at, x.end as end))))",
    _let(
        "before",
        _running("transform(line, x -> if(x.at < 0, x.end, 0))", "greatest(x, {})"),
        _let(
            "after",
            "reverse(" + _running("transform(reverse(line), x -> if(x.at < 0, x.start, 2147483647))", "least(x, {})") + ")",
            "transform(filter(zip_with(line, zip_with(before, after, (p, q) -> struct(p, q)), (x, y) -> struct(x.at as at, x.at >= 0 and y.p <= x.start and y.q >= x.end as apart)), x -> x.apart), x -> token[x.at])",
        ),
    ),
)


def _spans(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """doc_id, k (the text's hash), owner, repository, found: base spans by start and kind, then candidates apart from them; values hashed."""
    t = docs.select("doc_id", owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    each = t.select("doc_id", "owner", "repository", F.xxhash64("t").alias("k"), *(F.expr(_matches(kind)).alias(kind) for kind in KINDS))
    base = each.withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))
    apart = base.withColumn("token", F.expr(f"if(size(base) = 0 or size(token) = 0, token, {_APART})"))
    hashed = "transform({}, x -> struct(x.start, x.no, x.end, x.kind, sha2(x.value, 256) as hash))"
    return apart.select("doc_id", "k", "owner", "repository", F.expr(f"concat({hashed.format('base')}, {hashed.format('token')})").alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories, n_rows of the values of found (owner, repository, hash)."""
    once = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("rows"))
    by_owner = once.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"), F.sum("rows").alias("n_rows"))


def scanned(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """doc_id, k (xxhash64 of the text), spans: array of (start, end, kind, live), for each row of docs (doc_id, text, ...)."""
    rows = Cut(_spans(docs, owner, repository), "spans").df
    some = rows.where(F.size("found") > 0)
    values = some.select("doc_id", "k", "owner", "repository", F.explode("found").alias("x")).select("*", F.col("x.hash").alias("hash"))
    live = F.col("n_owners").__le__(LIVE_OWNERS) & F.col("n_repositories").__le__(LIVE_REPOSITORIES)
    figures = Cut(ownership(values).select("hash", live.alias("live"), (F.col("n_rows") > HOT).alias("hot")), "figures").df
    # Values of many rows, of which there are few, are dealt among parts.
    hot = small(Cut(figures.where("hot").select(F.col("hash").alias("_hot")), "hot").df)
    parted = values.join(hot, F.col("hash") == F.col("_hot"), "left")
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("doc_id", "k"), F.lit(SALTS)).cast("int")).otherwise(0)
    copied = figures.select("hash", "live", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0))).alias("salt"))
    judged = parted.select("doc_id", "k", "x", "hash", salt.alias("salt")).join(copied.hint("merge"), ["hash", "salt"])
    judged = judged.where("x.no < 3 or live").groupBy(F.col("doc_id").alias("_id"), F.col("k").alias("_k")).agg(F.sort_array(F.collect_set(F.expr("struct(x.start, x.no, x.end, x.kind, live)"))).alias("spans"))
    joined = some.select("doc_id", "k").join(judged, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_k")), "left")
    kept = joined.select("doc_id", "k", F.coalesce("spans", F.expr(_NONE)).alias("spans"))
    return kept.unionByName(rows.where(F.size("found") == 0).select("doc_id", "k", F.expr(_NONE).alias("spans")))


def digest(found: DataFrame) -> DataFrame:
    """The columns of a report from scanned()."""
    text = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    count = lambda sql: F.expr(f"cast(size(filter(spans, x -> {sql})) as bigint)")
    return found.select(
        "doc_id",
        *(count(f"x.kind = '{k}'").alias(f"n_{k}") for k in KINDS[:3]),
        F.expr(f"sha2({text.format('filter(spans, x -> x.no < 3)')}, 256)").alias("base_sha256"),
        F.expr(text.format("spans")).alias("spans"),
        count("x.live").alias("n_live"),
        count("not x.live").alias("n_copied"),
    )


def redacted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the spans of scanned() masked in text, and n_chars to match where docs have it; other rows as they are."""
    marked = Cut(found.where(F.size("spans") > 0).select(F.col("doc_id").alias("__secrets_id"), F.col("k").alias("__secrets_k"), F.col("spans").alias("__secrets_spans")).distinct(), "marked").df
    joined = docs.join(small(marked), F.col("doc_id").eqNullSafe(F.col("__secrets_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__secrets_k")), "left")
    # Overlapping spans are one. What lies before each is cut from its own stretch of the text: a cut costs as much as it lies deep.
    far = _running("transform(__secrets_spans, x -> x.end)", "greatest(x, {})")
    heads = "filter(zip_with(__secrets_spans, concat(array(0), far), (x, p) -> struct(p as p, x.start as s)), x -> x.p <= x.s)"
    stretch = f"array_join(transform(own, x -> concat(substring(seg, x.p - own[0].p + 1, x.s - x.p), '{MASK}')), '')"
    each = _let("own", f"slice(heads, j, {STRETCH})", _let("seg", "substring(text, own[0].p + 1, own[size(own) - 1].s - own[0].p)", stretch))
    masked = f"concat(array_join(transform(sequence(1, size(heads), {STRETCH}), j -> {each}), ''), substring(text, array_max(far) + 1))"
    pieces = _let("far", far, _let("heads", heads, masked))
    text = F.when(F.col("__secrets_spans").isNull(), F.col("text")).otherwise(F.expr(pieces))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__secrets_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
