"""DuckDB SQL that gives the rows of those operators that SQL can express."""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)"""
_KINDS = (("assign", _ASSIGN, 1, "length(value) >= 6"), ("access", "AKIA[A-Z0-9]+", 0, "length(value) >= 20"), ("hex", "[0-9a-f]+", 0, "length(value) >= 24"), ("token", "[A-Za-z0-9_-]{20,}", 0, "regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')"))


def _found(no: int, kind: str, pattern: str, group: int, good: str) -> str:
    return f"""
    select rid, doc_id, source, s as start, {no} as no, s + length(m) as "end", '{kind}' as kind, value
    from (
      select rid, doc_id, source, unnest(ms) as m, unnest(vs) as value,
        unnest(list_transform(range(1, len(ms) + 1), lambda i: cast(
          coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) as bigint))) as s
      from (select rid, doc_id, source, regexp_extract_all(t, '{pattern}') as ms, regexp_extract_all(t, '{pattern}', {group}) as vs, string_split_regex(t, '{pattern}') as gaps from docs)
    ) where {good}"""


OP1 = f"""
with docs as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
every as ({' union all '.join(_found(no, *x) for no, x in enumerate(_KINDS))}),
found as (
  select e.* from every e where no < 3
  union all
  select e.* from every e where no = 3 and not exists (select 1 from every b where b.rid = e.rid and b.no < 3 and b.start < e."end" and e.start < b."end")
),
live as (
  select value from (select distinct value, coalesce(source, chr(0)) as source, coalesce(cast(doc_id as varchar), chr(0)) as doc_id from found)
  group by value having count(distinct source) <= 1 and count(*) <= 3
),
spans as (select f.*, l.value is not null as live, f.kind || ':' || f.start || ':' || f."end" as x from found f left join live l using (value) where no < 3 or l.value is not null),
by_doc as (
  select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(x, ',' order by start, no) filter (no < 3) as base, string_agg(x, ',' order by start, no) as spans,
    count(*) filter (live) as n_live, count(*) filter (not live) as n_copied
  from spans group by rid
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
from docs left join by_doc using (rid)
"""

OP7 = r"""
with recursive docs as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from docs
),
each as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (
  select a.doc_id as a, b.doc_id as b from each a join each b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
reach(doc_id, r) as (select doc_id, doc_id from documents union select reach.doc_id, links.b from reach join links on links.a = reach.r)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from sets s join (select doc_id, min(r) as component_id from reach group by doc_id) c using (doc_id)
"""

OP12 = """
with rows as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
named as (
  select *, translate(array_to_string(list_transform(range(1, 41, 5), lambda i: to_base(cast('0x' || substr(h, i, 5) as bigint), 32, 4)), ''), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as digest,
    max(page_id) over (partition by payload) as top
  from rows
)
select page_id, strlen(payload) as payload_bytes, digest as payload_digest, case when page_id is distinct from top then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from top then top end as refers_to
from named
"""
