"""DuckDB SQL for the queries of this subpackage that SQL can express, over the whole tables.

The others learn a model (3, 7, 10), sketch by hash (5, 9) or search segmentations (8); tests hold them against brute
force, round trips and held-out accuracy.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_MINHASH = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                               'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as sh
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, reach) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on e.a = r.reach),
c as (select doc_id, min(reach) as component_id from r group by doc_id)
select c.doc_id, coalesce(n.n, 0) as n_shingles, component_id, c.doc_id = component_id as kept from c left join n using (doc_id)"""


def _escaped(x: str) -> str:
    for control in ("\\", "###", "</turn>", "<|"):
        x = f"replace({x}, '{control}', '\\{control}')"
    return x


_CHAT = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
f as (select *, '### ' || replace({_escaped('role')}, ':', '\\:') || ': ' || {_escaped('text')} || '</turn>' || chr(10) as formatted from t),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, formatted) as said,
             coalesce(string_agg(text, '' order by turn, formatted) filter (where role = 'assistant'), '') as loss,
             sum(length(formatted)) as formatted_chars from f group by conv_id),
a as (select conv_id, turn, unnest(case when role = 'assistant' then [{{'kind': 'audio', 'place': 1, 'tokens': length(text)}}]
             else [{{'kind': 'image', 'place': 1, 'tokens': length(text) % 50 + 1}}, {{'kind': 'document', 'place': 2, 'tokens': turn % 3 * 400}}] end) as x from t),
h as (select conv_id, count(*) as n_attachments, cast(sum(x.tokens) as bigint) as expanded_tokens,
             sha256(string_agg(x.kind || ' ' || x.kind || '-' || conv_id || '-' || turn || ' ' || x.tokens || chr(10), ''
                               order by turn, x.place, x.kind, x.tokens)) as attachments_sha256 from a group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256,
       cast(formatted_chars as bigint) as formatted_chars, n_attachments, expanded_tokens, attachments_sha256
from g join h using (conv_id)"""

_SUBSTRING = f"""
with d as (select doc_id, {_WORDS} as w from documents),
v as (select doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') as win
      from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by win) as c from v) where c > 1),
gone as (select distinct doc_id, i + k as i from rep, range(35) t(k)),
x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
k as (select x.doc_id, x.i, word, gone.i is not null as g,
             coalesce(lag(gone.i is not null) over (partition by x.doc_id order by x.i), false) as before
      from x left join gone on gone.doc_id = x.doc_id and gone.i = x.i),
a as (select doc_id, count(*) as n_words, count(*) filter (where g) as n_removed, count(*) filter (where g and not before) as n_spans,
             coalesce(string_agg(word, ' ' order by i) filter (where not g), '') as kept from k group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256,
       coalesce(n_spans, 0) as n_spans from d left join a using (doc_id)"""

_SUFFIX = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
v as (select doc_id, i, substr(h, 2 * i + 1, 100) as win
      from (select doc_id, h, unnest(range(length(h) // 2 - 49)) as i from d where length(h) >= 100)),
f as (select win, min(doc_id) as first from v group by win having count(distinct doc_id) > 1),
rep as (select v.doc_id, v.i from v join f using (win) where v.doc_id > f.first),
edges as (select doc_id, i, lag(i) over (partition by doc_id order by i) as p from rep),
runs as (select doc_id, i, sum(case when p is null or i > p + 50 then 1 else 0 end) over (partition by doc_id order by i) as run from edges),
spans as (select doc_id, run, min(i) as lo, max(i) + 50 as hi from runs group by 1, 2),
cut as (select doc_id, lo, hi, lag(hi, 1, 0) over (partition by doc_id order by lo) as from_ from spans),
a as (select c.doc_id, sum(hi - lo) as n_removed, count(*) as n_spans, max(hi) as last,
             string_agg(substr(d.h, 2 * from_ + 1, 2 * (lo - from_)), '' order by lo) as head from cut c join d using (doc_id) group by c.doc_id)
select d.doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join a using (doc_id)"""

_LEAF = "||".join(f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT_FIELD = "coalesce(octet_length(encode({t})) || ':' || {t}, '-')"
_CRC32 = ("xor(4294967295, list_reduce(list_prepend(4294967295::bigint, [ascii(c)::bigint for c in string_split(cast(doc_id as varchar), '')]),"
          " lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))")


def _siblings(tree: str) -> str:
    """What stands before and after each node of a level in its run, and whether it has a parent."""
    return f"""select a.g, a.l, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (where b.i < a.i), '') as before,
             coalesce(string_agg(b.h, '' order by b.i) filter (where b.i > a.i), '') as after
      from {tree} a join {tree} b on a.g is not distinct from b.g and a.l = b.l and a.i // 8 = b.i // 8 where a.n > 1 group by all"""


_MERKLE = f"""
with recursive d as (select doc_id, lang as g, sha256({_LEAF} || {_TEXT_FIELD.format(t="text")}) as leaf,
             sha256({_LEAF} || {_TEXT_FIELD.format(t="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) as lower_leaf,
             coalesce({_CRC32} % 3 = 0, false) as hit from documents),
o as (select *, row_number() over (partition by g order by doc_id nulls first) - 1 as i, count(*) over (partition by g) as n from d),
lv as (select g, 0 as l, i, leaf as h, n from o
       union all select g, l + 1, i // 8, sha256(string_agg(h, '' order by i)), (n + 7) // 8 from lv where n > 1 group by g, l, i // 8, n),
tops as (select g, h, row_number() over (order by g is not null, encode(g)) - 1 as i, count(*) over () as n from lv where n = 1),
rv as (select 0 as g, 0 as l, i, h, n from tops
       union all select g, l + 1, i // 8, sha256(string_agg(h, '' order by i)), (n + 7) // 8 from rv where n > 1 group by g, l, i // 8, n),
ls as ({_siblings('lv')}), rs as ({_siblings('rv')}),
low as (select doc_id, i as own, g, 0 as l, i, case when hit then lower_leaf else leaf end as f, '' as proof from o
        union all select c.doc_id, c.own, c.g, c.l + 1, c.i // 8, sha256(s.before || c.f || s.after), c.proof || s.before || s.after
        from low c join ls s on c.g is not distinct from s.g and c.l = s.l and c.i = s.i),
high as (select low.doc_id, low.own, low.g, 0 as l, tops.i, f, proof from low join lv on low.g is not distinct from lv.g and low.l = lv.l and low.i = lv.i and lv.n = 1
         join tops on low.g is not distinct from tops.g
         union all select c.doc_id, c.own, c.g, c.l + 1, c.i // 8, sha256(s.before || c.f || s.after), c.proof || s.before || s.after
         from high c join rs s on c.l = s.l and c.i = s.i)
select o.doc_id, o.leaf, tops.h as subroot, rv.h as root, sha256(high.proof) as proof_sha256, high.f as folded_root, high.f = rv.h as verified
from high join rv on rv.n = 1 and rv.l = high.l join o on o.g is not distinct from high.g and o.i = high.own join tops on tops.g is not distinct from o.g"""

ORACLES = {
    "op1_minhash_dedup": _MINHASH,
    "op2_chat_format": _CHAT,
    "op4_substring_dedup": _SUBSTRING,
    "op6_suffix_dedup": _SUFFIX,
    "op11_merkle_manifest": _MERKLE,
    "op13_ngram_join": _MINHASH.replace("100 * c >= 85", "100 * c >= 80").replace(", c.doc_id = component_id as kept", ""),
}
