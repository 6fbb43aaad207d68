"""DuckDB SQL for the operators whose results SQL can express."""

from tidemark.llm.common import UNSPACED_REGEX

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
with d as (select row_number() over () rid, doc_id, {_WORDS} w from documents),
b as (select item_id, {_WORDS} w from benchmark),
bw as (select distinct item_id, l, array_to_string(w[k:k + l - 1], ' ') p from (select item_id, w, least(13, len(w)) l, unnest(generate_series(1, greatest(1, len(w) - 12))) k from b where len(w) > 0)),
dw as (select rid, k, l, array_to_string(w[k:k + l - 1], ' ') p from (select rid, w, l, unnest(generate_series(1, len(w) - l + 1)) k from d, (select distinct l from bw) where len(w) >= l)),
h as (select rid, k, l, item_id from dw join bw using (p, l)),
hits as (select rid, count(distinct pos) n from (select rid, unnest(generate_series(k, k + l - 1)) pos from h) group by 1),
found as (select rid, count(*) n, string_agg(i, ',' order by i) s from (select distinct rid, cast(item_id as varchar) i from h) group by 1)
select doc_id, len(w) n_words, coalesce(hits.n, 0) n_hit, coalesce(found.n, 0) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(hits.n, 0) > 0 and 20 * coalesce(hits.n, 0) >= len(w) contaminated
from d left join hits using (rid) left join found using (rid)
"""

LINE_DEDUP = r"""
with recursive ln as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) k from documents where text is not null),
tk as (select doc_id, k, line, list_transform(regexp_extract_all(line, '[UNSPACED]|[^ \t\r\x0b\fUNSPACED]+'), lambda x: case when regexp_matches(x, '[0-9@]|://') then '<*>' else x end) t from ln),
leaf as (select t, len(t) n, t[1:3] head, row_number() over (order by t) id from (select distinct t from tk where len(t) > 0)),
edge as (select a.id x, b.id y from leaf a join leaf b on a.n = b.n and a.head = b.head and a.id <> b.id where a.n >= 5 and 5 * len(list_filter(list_zip(a.t, b.t), lambda p: p[1] <> p[2])) <= a.n),
reach as (select x, x y from edge union select r.x, e.y from reach r join edge e on e.x = r.y),
template as (select leaf.t, n, coalesce(r, id) id from leaf left join (select x, min(y) r from reach group by 1) m on m.x = leaf.id),
own as (select tk.doc_id, tk.k, tk.line, n, id from tk left join template using (t)),
first_ as (select id, min(doc_id) f from own where id is not null group by 1 having count(distinct doc_id) >= case when min(n) < 5 then 10 else 2 end),
kept as (select own.*, f is null or f = doc_id keep from own left join first_ using (id))
select doc_id, coalesce(string_agg(line, chr(10) order by k) filter (where keep), '') "text", count(*) n_lines, count(case when not keep then 1 end) n_dropped from kept group by 1
union all select doc_id, null, null, 0 from documents where text is null
""".replace("UNSPACED", UNSPACED_REGEX[1:-1])

CHAT = r"""
with m as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
union all select -7, k, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(k, r)),
n as (select *, length(r) + length(t) + len(regexp_extract_all(r || chr(10) || t, '<\\*/?s>|\[\\*/?INST\]')) + length('<s>[INST][/INST]</s>') c, md5(t) h from m)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls last, r, h)) turns_sha256,
coalesce(sum(length(t)) filter (where r = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(t, '' order by turn nulls last, r, h) filter (where r = 'assistant'), '')) loss_sha256,
sum(c)::bigint formatted_chars
from n group by 1
"""

_INTEGERS = "list_transform(embedding, lambda x: floor(256 * x::double)::bigint)"
_WHOLE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

HARD_NEGATIVES = f"""
with r as (select row_number() over () rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, {_INTEGERS} v
from embeddings where label is not null and vec_id is not null and {_WHOLE}),
s as (select a.rid, a.vec_id anchor_id, a.l = b.l same, b.vec_id other, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint score
from r a join r b on a.rid <> b.rid where a.vec_id % 100 = 0),
p as (select rid, anchor_id, other positive_id, score positive_score, row_number() over (partition by rid order by score desc, other) k from s where same qualify k <= 5)
select p.anchor_id, positive_id, (row_number() over (partition by p.rid, k order by score desc, other))::int as rank, other negative_id, positive_score, score negative_score
from p join s on p.rid = s.rid and not same and 80 * positive_score <= 100 * score and score <= positive_score qualify rank <= 5
"""


def _rounds(n: int) -> str:
    """The CTEs of ``n`` rounds of assignment and mean, and the last assignment as ``final``."""
    near = (
        "select distinct on (rid, p) rid, p, e, s, d from (select x.rid, x.p, c.e, x.s, "
        "list_sum(list_transform(list_zip(x.s, c.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint d from x join c{k} c using (p)) order by rid, p, d, e"
    )
    out = "c0 as (select p, rid - 1 e, s from x where rid <= 64)"
    for k in range(n):
        out += f", a{k} as ({near.format(k=k)}), i{k} as (select p, e, s, unnest(generate_series(1, len(s))) i from a{k}), m{k} as (select p, e, i, floor(sum(s[i])::double / count(*))::bigint v from i{k} group by all)"
        out += f", c{k + 1} as (select c.p, c.e, coalesce(any_value(g.s), any_value(c.s)) s from c{k} c left join (select p, e, list(v order by i) s from m{k} group by all) g using (p, e) group by all)"
    return out + f", final as ({near.format(k=n)})"


VECTOR_CODES = f"""
with v as (select row_number() over (order by vec_id) rid, vec_id, label, {_INTEGERS} v from embeddings where {_WHOLE}),
x as (select rid, k p, v[k * len(v) // 16 + 1:(k + 1) * len(v) // 16] s from v, generate_series(0, 15) g(k)),
{_rounds(2)},
own as (select rid, string_agg(printf('%02x', e::int), '' order by p) code, sum(d)::bigint error from final group by 1),
book as (select sha256(string_agg(array_to_string(s, ','), ',' order by p, e)) h from c2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, h codebooks_sha256 from v join own using (rid), book
"""

ORACLE = {
    "op5_decontamination": DECONTAMINATION, "op6_line_dedup": LINE_DEDUP, "op11_chat": CHAT, "op12_hard_negatives": HARD_NEGATIVES,
    "op13_vector_codes": VECTOR_CODES,
}
