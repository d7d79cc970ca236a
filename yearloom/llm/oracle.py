"""DuckDB SQL of those queries of this package that SQL can express on whole tables."""

from __future__ import annotations

_CHAT = r"""
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), o as (
    select *, lag(role) over w as before,
           2 * length(text) - length(regexp_replace(text, '[\\<|]', '', 'g')) as text_len,
           2 * length(role) - length(regexp_replace(role, '[\\<|]', '', 'g')) as role_len
    from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n from c)
    window w as (partition by conv_id order by n)
), s as (
    select conv_id, count(*) as n_turns,
           string_agg(role || chr(10) || text || chr(10), '' order by n) as whole,
           coalesce(string_agg(text, '' order by n) filter (where role = 'assistant'), '') as loss,
           -- a block costs <|turn:role|> and <|end|> with a line end, a further turn of its role <|+|>
           sum(text_len + case when before = role then 5 else 9 + role_len + 8 end) as formatted_chars
    from o group by conv_id
)
select conv_id, n_turns, sha256(whole) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
       cast(formatted_chars as bigint) as formatted_chars
from s
"""

_MERKLE = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (
    select doc_id, text,
           coalesce(lead(text) over (order by doc_id desc), first_value(text) over (order by doc_id desc)) as after
    from d
), e as (
    select doc_id, text, after, left(text, length(text) - length(text) // 2) || left(after, length(text) // 2) as edited from n
), t as (
    select doc_id, 'own' as kind, text from e union all select doc_id, 'edited', edited from e union all select doc_id, 'next', after from e
), cut as (
    select doc_id, kind, list_transform(string_split(text, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
        lambda p: list_filter(list_concat(
            [substr(p, 1, 1), substr(p, 2, 1), substr(p, 3, 2), substr(p, 5, 4), substr(p, 9, 8), substr(p, 17, 16), substr(p, 33, 32)],
            regexp_extract_all(substr(p, 65), '(?s).{1,64}')), lambda x: x <> ''))) as tree
    from t
), para as (
    select doc_id, kind, list_transform(tree, lambda s: list_transform(s, lambda p: {
        'node': md5(list_aggregate(list_concat([''], list_transform(p, lambda x: md5(x))), 'string_agg', '')),
        'shown': list_aggregate(list_concat([''], list_transform(p, lambda x: '.' || left(md5(x), 8) || lpad(cast(length(x) as varchar), 2, '0'))), 'string_agg', '')})) as s
    from cut
), sec as (
    select doc_id, kind, list_transform(s, lambda x: {
        'node': md5(list_aggregate(list_transform(x, lambda p: p.node), 'string_agg', ',')),
        'shown': list_aggregate(list_transform(x, lambda p: left(p.node, 8) || p.shown), 'string_agg', ';')}) as s
    from para
), fp as (
    select doc_id, kind,
           md5(list_aggregate(list_transform(s, lambda x: x.node), 'string_agg', ';')) || '|'
           || list_aggregate(list_transform(s, lambda x: left(x.node, 8) || '(' || x.shown || ')'), 'string_agg', '') as fingerprint
    from sec
), leaves as (
    select doc_id, kind, fingerprint, list_distinct(regexp_extract_all(fingerprint, '\.([0-9a-f]{8}[0-9]{2})', 1)) as leaf from fp
), weighed as (
    select *, coalesce(list_sum(list_transform(leaf, lambda x: cast(substr(x, 9, 2) as bigint))), 0) as w from leaves
), pairs as (
    select a.doc_id, b.kind, a.fingerprint, b.fingerprint as other,
           case when left(a.fingerprint, 32) = left(b.fingerprint, 32) then 1.0
                when a.w + b.w = 0 then 0.0
                else 2.0 * cast(coalesce(list_sum(list_transform(list_intersect(a.leaf, b.leaf), lambda x: cast(substr(x, 9, 2) as bigint))), 0) as double)
                     / cast(a.w + b.w as double) end as near
    from weighed a join weighed b on a.doc_id = b.doc_id and a.kind = 'own' and b.kind <> 'own'
)
select e.doc_id, length(e.text) as n_chars, sha256(e.edited) as edited_sha256, x.fingerprint, x.other as edited_fingerprint,
       cast(x.near as double) as near_edited, cast(y.near as double) as near_next
from e join pairs x on e.doc_id = x.doc_id and x.kind = 'edited' join pairs y on e.doc_id = y.doc_id and y.kind = 'next'
"""

_WARC = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
o as (select *, max(page_id) over (partition by payload_digest) as first from p),
r as (select *, payload_bytes >= 1000 and page_id < first as again from o)
select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type,
       case when again then first end as refers_to
from r
"""

_VECTORS = """
with recursive v as (
    select vec_id, label, cast(embedding as double[]) as e from embeddings
    where label is not null and embedding is not null and len(embedding) > 0
      and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
      and list_sum(list_transform(embedding, lambda x: cast(x as double) * x)) > 0
), l as (
    select a.vec_id as a, b.vec_id as b from v a join v b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) as (select a, b from l union select r.a, l.b from reach r join l on r.b = l.a),
c as (select a, least(a, min(b)) as component_id from reach group by a),
n as (select a, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id,
       vec_id = coalesce(component_id, vec_id) as kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id
"""

_MINHASH = r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') as w
    from documents
), sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
    from w
), one as (select s, min(doc_id) as rep from (select doc_id, list_sort(s) as s from sets where len(s) > 0) group by s),
of as (select doc_id, rep from (select doc_id, list_sort(s) as s from sets where len(s) > 0) join one using (s)),
x as (select rep, len(s) as n, unnest(s) as g from one),
l as (
    select a.rep as a, b.rep as b from x a join x b on a.g = b.g and a.rep <> b.rep and least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) - 1e-9
    group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(a, b) as (select a, b from l union select r.a, l.b from reach r join l on r.b = l.a),
c as (select a, least(a, min(b)) as component_id from reach group by a)
select s.doc_id, len(s.s) as n_shingles, coalesce(c.component_id, o.rep, s.doc_id) as component_id,
       s.doc_id = coalesce(c.component_id, o.rep, s.doc_id) as kept
from sets s left join of o on o.doc_id = s.doc_id left join c on c.a = o.rep
"""

_AUDIT = r"""
with d as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
    from documents
), l as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1),
fails as (
    select part, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic,
           len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b,
           100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) as c,
           regexp_matches(text, '[#$%&*|]') as d, coalesce(doc_id > min(doc_id) over (partition by text), false) as e
    from d left join l using (doc_id)
), m as (
    select part, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end
             || case when d then 'D' else '' end || case when e then 'E' else '' end as failed,
           count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
    from fails group by all
), f as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
    select p.x || q.x || r.x || s.x || t.x as filter_order from f p, f q, f r, f s, f t
    where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps as (
    select filter_order, step, substr(filter_order, step, 1) as x, substr(filter_order, 1, step - 1) as before
    from orders, (select unnest([1, 2, 3, 4, 5]) as step)
), counted as (
    select part, filter_order, step, x,
           coalesce(sum(n) filter (t.hit and not t.gone), 0) as removed,
           coalesce(sum(n) filter (t.hit and t.gone), 0) as redundant, coalesce(sum(n) filter (failed = x), 0) as unique_fails,
           coalesce(sum(good) filter (t.hit and not t.gone), 0) as good_lost, coalesce(sum(toxic) filter (t.hit and not t.gone), 0) as toxic_lost,
           sum(n) as total, coalesce(sum(n) filter (t.gone or t.hit), 0) as lost
    from (select m.*, s.*, contains(failed, x) as hit, before <> '' and regexp_matches(failed, '[' || before || '_]') as gone from m, steps s) t
    group by part, filter_order, step, x
)
select part, filter_order, cast(step as integer) as step, cast(total - lost as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
       cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, x) as bigint) as shapley
from counted
"""

_NEGATIVES = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
    from embeddings
    where label is not null and embedding is not null and len(embedding) > 0
      and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
), s as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.e, b.e) as bigint) as score
    from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
), p as (
    select anchor_id, vec_id as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, cast(row_number() over w as integer) as rank, s.vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, s.vec_id)
qualify row_number() over w <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat": _CHAT,
        "op3_merkle": _MERKLE,
        "op4_warc": _WARC,
        "op6_vectors": _VECTORS,
        "op9_minhash": _MINHASH,
        "op11_audit": _AUDIT,
        "op13_negatives": _NEGATIVES,
    }
