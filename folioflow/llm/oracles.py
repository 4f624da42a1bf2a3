"""SQL for the queries of this subpackage that SQL can express, for a second engine to check them by."""

from __future__ import annotations

#: Windows of 100 bytes as 200 hexadecimal digits; all but the first of equal ones cover their bytes; covered runs are
#: islands of starts at most 100 apart, and what lies between them is kept.
SUFFIX_DEDUP = """
with texts as (select doc_id, hex(coalesce(text, '')) as h from documents),
starts as (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as p from texts),
windows as (select doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) as w from starts),
again as (select doc_id, p from windows qualify row_number() over (partition by w order by doc_id, p) > 1),
steps as (select doc_id, p, case when p - lag(p) over (partition by doc_id order by p) <= 100 then 0 else 1 end as step from again),
marked as (select doc_id, p, sum(step) over (partition by doc_id order by p rows unbounded preceding) as island from steps),
islands as (select doc_id, min(p) as a, max(p) + 100 as z from marked group by doc_id, island),
gaps as (select doc_id, a, coalesce(lag(z) over (partition by doc_id order by a), 0) as from_ from islands),
heads as (select g.doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' order by a) as head from gaps g join texts t on g.doc_id = t.doc_id group by g.doc_id),
runs as (select doc_id, count(*) as n_spans, sum(z - a) as n_removed, max(z) as z from islands group by doc_id)
select t.doc_id,
       cast(length(h) // 2 as bigint) as n_bytes,
       cast(coalesce(n_removed, 0) as bigint) as n_removed,
       cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(from_hex(coalesce(head, '') || substr(h, 2 * coalesce(z, 0) + 1))) as kept_sha256
from texts t left join heads on t.doc_id = heads.doc_id left join runs on t.doc_id = runs.doc_id
"""

#: Equal sets are one class; classes that share a shingle are compared; components are what can be reached by links.
JACCARD_JOIN = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, list_sort(list_distinct(case when len(w) >= 5 then [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]
                                              when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from words),
classed as (select doc_id, s, len(s) as n, min(doc_id) over (partition by s) as class from sets),
shingles as (select class, n, unnest(s) as shingle from classed where doc_id = class),
common as (select a.class as a, b.class as b, a.n as na, b.n as nb, count(*) as n from shingles a join shingles b on a.shingle = b.shingle and a.class < b.class group by all),
links as (select a, b from common where 100 * n >= 80 * (na + nb - n)),
both_ways as (select a, b from links union all select b, a from links),
reach(class, other) as (select class, class from classed where doc_id = class union select r.class, l.b from reach r join both_ways l on r.other = l.a),
components as (select class, min(other) as component from reach group by class)
select doc_id, cast(n as bigint) as n_shingles, case when n > 0 then component else doc_id end as component_id
from classed join components using (class)
"""

SQL = {"op1_suffix_dedup": SUFFIX_DEDUP, "op5_jaccard_join": JACCARD_JOIN}
