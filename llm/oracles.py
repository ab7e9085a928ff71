"""SQL that gives the rows of the operators that SQL can express."""

from __future__ import annotations

from .lattice import COSINE
from .suffixes import LENGTH

E8_LATTICE = f"""
with recursive v as (select distinct vec_id, embedding::double[] as e, label from embeddings where vec_id is not null and embedding is not null and label is not null and list_aggregate(list_transform(embedding, lambda x : abs(x)), 'max') > 0),
l as (select distinct a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach as (select a as node, b as other from l union select r.node, l.b from reach r join l on r.other = l.a),
c as (select node, least(node, min(other)) as component from reach group by node), n as (select a as node, count(*) as n from l group by a)
select vec_id, coalesce(n, 0) as n_links, coalesce(component, vec_id) as component_id, vec_id = coalesce(component, vec_id) as kept
from embeddings left join n on n.node = vec_id left join c on c.node = vec_id
"""

SUFFIX_DEDUP = f"""
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
p as (select r, p, md5(b[p + 1 : p + {LENGTH}]::varchar) as h from (select r, b, unnest(range(0, octet_length(b) - {LENGTH} + 1)) as p from d where octet_length(b) >= {LENGTH})),
g as (select r, p from p where h in (select h from p group by h having count(*) > 1)),
s as (select r, p, case when p - lag(p) over (partition by r order by p) <= {LENGTH} then 0 else 1 end as new from g),
i as (select r, p, sum(new) over (partition by r order by p rows unbounded preceding) as k from s),
span as (select r, k, min(p) as a, max(p) + {LENGTH} as z from i group by r, k),
gap as (select r, coalesce(lag(z) over (partition by r order by a), 0) as x, a as y from span union all select r, max(z), 4611686018427387904 from span group by r),
kept as (select gap.r, coalesce(string_agg(case when y > x then hex(b[x + 1 : least(y, octet_length(b))]) else '' end, '' order by x), '') as k from gap join d using (r) group by gap.r),
n as (select r, sum(z - a)::bigint as n_removed, count(*) as n_spans from span group by r)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(case when k is null then b else unhex(k) end) as kept_sha256
from d left join n using (r) left join kept using (r)
"""
