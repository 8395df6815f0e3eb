"""Conversation memory queries (H1–H13) over ``mention_steps``.

Oracles find each conflict with a plain self-join over earlier turns (the
reference's definition); the Spark side uses the linear first-conflict
formulation of ``tracewise.operators.memory``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewise.functions.common import WORD_RE, hash_key_sql
from tracewise.operators import memory
from tracewise.plans.registry import register
from tracewise.sources.fixtures import SQL_VIEWS, mention_steps, turn_steps, with_views
from tracewise.sources.tables import table

_NUM = memory.NUMBER_RE
_CLM = memory.CLAIM_RE
_STOP = ", ".join(f"'{w}'" for w in memory.NAME_STOP)

SQL_VIEWS.update({
    "ents": (("mention_steps",), f"""
        select conv_id, turn, step_idx, 0 as k, m, name, 'number' as kind,
               'n:' || cast(cast(v as double) as varchar) as vkey, cast(cast(v as double) as varchar) as value
        from (select conv_id, turn, step_idx, unnest(regexp_extract_all(text, '{_NUM}', 1)) as name,
                     unnest(regexp_extract_all(text, '{_NUM}', 2)) as v,
                     unnest(range(len(regexp_extract_all(text, '{_NUM}', 1)))) as m from mention_steps)
        union all
        select conv_id, turn, step_idx, 1 as k, m, tok as name, 'person' as kind, 's:' || tok as vkey, tok as value
        from (select conv_id, turn, step_idx, unnest(regexp_extract_all(text, '{WORD_RE}')) as tok,
                     unnest(range(len(regexp_extract_all(text, '{WORD_RE}')))) as m from mention_steps)
        where regexp_full_match(tok, '[A-Z][a-z]+') and tok not in ({_STOP})"""),
    "claims": (("mention_steps",), f"""
        select conv_id, turn, step_idx, 0 as k, m, subject, 'is' as predicate, object, object as vkey, object as value
        from (select conv_id, turn, step_idx, unnest(regexp_extract_all(text, '{_CLM}', 1)) as subject,
                     unnest(regexp_extract_all(text, '{_CLM}', 2)) as object,
                     unnest(range(len(regexp_extract_all(text, '{_CLM}', 1)))) as m from mention_steps)"""),
    "ent_conf": (("ents",), """
        select c.conv_id, c.turn, c.step_idx, c.name, c.value as current_value,
               arg_min(p.value, (p.turn, p.step_idx, p.k, p.m)) as previous_value,
               arg_min(p.turn, (p.turn, p.step_idx, p.k, p.m)) as previous_turn
        from ents c join ents p on p.conv_id = c.conv_id and p.name = c.name and p.turn < c.turn and p.vkey <> c.vkey
        group by c.conv_id, c.turn, c.step_idx, c.k, c.m, c.name, c.value"""),
    "claim_conf": (("claims",), """
        select c.conv_id, c.turn, c.step_idx, c.subject, c.predicate, c.value as current_value,
               arg_min(p.value, (p.turn, p.step_idx, p.k, p.m)) as previous_value,
               arg_min(p.turn, (p.turn, p.step_idx, p.k, p.m)) as previous_turn
        from claims c join claims p on p.conv_id = c.conv_id and p.subject = c.subject and p.predicate = c.predicate
                                    and p.turn < c.turn and p.vkey <> c.vkey
        group by c.conv_id, c.turn, c.step_idx, c.k, c.m, c.subject, c.predicate, c.value"""),
})


@register("entity_conflict", "H1 H2 H4", with_views("select * from ent_conf", "ent_conf"))
def q_entity_conflict(spark, sf_dir):
    return memory.entity_conflicts(memory.extract_entities(mention_steps(spark, sf_dir)))


@register("claim_conflict", "H3 H5", with_views("select * from claim_conf", "claim_conf"))
def q_claim_conflict(spark, sf_dir):
    return memory.claim_conflicts(memory.extract_claims(mention_steps(spark, sf_dir)))


@register("memory_features", "H6 H8 H9 H10 H11 H12 H13", with_views("""
    with t as (select distinct conv_id, turn from conversations),
    tc as (select conv_id, turn, row_number() over w - 1 as n_prev,
                  lag(turn, 1) over w as p1, lag(turn, 2) over w as p2, lag(turn, 3) over w as p3
           from t window w as (partition by conv_id order by turn)),
    ctx as (select conv_id, turn, least(n_prev, 10) as num_previous_turns,
                   concat_ws(',', cast(p3 as varchar), cast(p2 as varchar), cast(p1 as varchar)) as recent_turns,
                   least(n_prev, 3) as k,
                   case when least(n_prev, 3) = 0 then 1.0
                        else ((case when p1 is not null then 1.0 else 0 end) + (case when p2 is not null then 0.9 else 0 end)
                              + (case when p3 is not null then 0.8 else 0 end)) / least(n_prev, 3) end as decay_avg,
                   case when least(n_prev, 3) = 0 then 0.0
                        else (coalesce(turn - p1, 0) + coalesce(turn - p2, 0) + coalesce(turn - p3, 0)) / least(n_prev, 3) end
                       as dist_avg,
                   case when least(n_prev, 3) = 0 then 1.0::double else 1.0::double - 0.1::double * (least(n_prev, 3) - 1) end as decay_min
            from tc),
    ec as (select conv_id, turn, count(*) as n_ec from ent_conf group by 1, 2),
    cc as (select conv_id, turn, count(*) as n_cc from claim_conf group by 1, 2),
    em as (select e.conv_id, e.turn, count(*) as mentions,
                  sum(((select min(turn) from ents x where x.conv_id = e.conv_id and x.name = e.name) < e.turn
                       and not coalesce((select min(turn) from ents y where y.conv_id = e.conv_id and y.name = e.name
                                         and y.vkey = e.vkey) < e.turn, false))::int) as changes
           from ents e group by 1, 2),
    sp as (select c.conv_id, c.turn, count(*) as n_claims,
                  sum((select count(*) from claims p where p.conv_id = c.conv_id and p.subject = c.subject
                       and p.predicate = c.predicate and p.object = c.object and p.turn < c.turn)) as support
           from claims c group by 1, 2),
    ns as (select conv_id, turn, count(*) as num_steps from mention_steps group by 1, 2),
    j as (select ctx.*, coalesce(n_ec, 0) as n_ec, coalesce(n_cc, 0) as n_cc, coalesce(mentions, 0) as mentions,
                 coalesce(changes, 0) as changes, coalesce(support, 0) as support, coalesce(n_claims, 0) as n_claims,
                 coalesce(num_steps, 0) as num_steps
          from ctx left join ec using (conv_id, turn) left join cc using (conv_id, turn) left join em using (conv_id, turn)
          left join sp using (conv_id, turn) left join ns using (conv_id, turn))
    select conv_id, turn, cast(n_ec + n_cc as bigint) as num_contradictions, n_ec > 0 as has_entity_contradiction,
           n_cc > 0 as has_claim_contradiction, cast(mentions as bigint) as entity_mentions,
           cast(changes as bigint) as entity_value_changes, cast(support as bigint) as claim_support_count,
           cast(n_cc as bigint) as claim_conflict_count, round(decay_avg, 6) + 0.0 as confidence_decay_avg,
           round(dist_avg, 6) + 0.0 as turn_distance_avg, num_previous_turns, recent_turns,
           round(case when mentions > 0 then 1.0 - changes / mentions else 1.0 end, 6) + 0.0 as entity_consistency_ratio,
           round(coalesce(support / nullif(n_claims, 0), 0), 6) + 0.0 as claim_verification_ratio,
           round(coalesce(n_cc / nullif(n_claims, 0), 0), 6) + 0.0 as claim_conflict_ratio,
           round(decay_min, 6) + 0.0 as confidence_decay_min,
           round(case when n_ec + n_cc = 0 then 0.0
                      else least(1.0, (0.8 * n_ec + 1.0 * n_cc) / (case when num_steps > 0 then num_steps else 1 end)) end, 6)
               + 0.0 as contradiction_score
    from j""", "ent_conf", "claim_conf", "ents", "claims", "mention_steps"))
def q_memory_features(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return memory.memory_features(turns, mention_steps(spark, sf_dir))


@register("mention_history", "H7", with_views("""
    select turn, step_idx, m, name, value from ents where conv_id = 3 and name = 'budget'""", "ents"))
def q_mention_history(spark, sf_dir):
    ents = memory.extract_entities(mention_steps(spark, sf_dir))
    return memory.mention_history(ents, 3, "budget").select("turn", "step_idx", F.col("pos.m").cast("long").alias("m"), "name", "value")


@register("turn_buckets", "H17 H18", with_views("""
    with o as (select o_orderkey, o_custkey,
                      row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as turn_idx
               from orders),
    s as (select o.o_custkey as conv_id, st.chain_id as turn, o.turn_idx, st.is_correct, st.error_type,
                 cast(st.is_correct as bigint) as y, (1 - st.risk > 0.5) as pred
          from order_steps st join o on o.o_orderkey = st.chain_id),
    c as (select conv_id, turn, case when not bool_or(not is_correct) then 'clean'
                                     when bool_or(not is_correct and error_type = 'factual') then 'cross_turn_error'
                                     else 'single_turn_error' end as category from s group by 1, 2),
    g as (select 'all' as bucket, y, pred from s
          union all select c.category, y, pred from s join c using (conv_id, turn)
          union all select 'turn_' || cast(turn_idx + 1 as varchar), y, pred from s),
    m as (select bucket, sum((pred and y = 1)::int) as tp, sum((pred and y <> 1)::int) as fp,
                 sum((not pred and y <> 1)::int) as tn, sum((not pred and y = 1)::int) as fn from g group by bucket),
    r as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as rc from m)
    select bucket, round(coalesce(2 * p * rc / nullif(p + rc, 0), 0), 6) + 0.0 as f1,
           round((tp + tn) / (tp + fp + tn + fn), 6) + 0.0 as accuracy, cast(tp + fp + tn + fn as bigint) as n
    from r""", "order_steps"))
def q_turn_buckets(spark, sf_dir):
    from tracewise.functions.ranking import grouped_position
    from tracewise.sources.fixtures import order_steps

    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("_d"))
    # turn index per customer, ranked without sorting a whole customer in one task
    o = grouped_position(o, ["o_custkey"], "_d", "o_orderkey", out="turn_idx", size_col=None,
                         bucket=F.shiftright(F.col("_d"), 42))  # ~51-day buckets
    st = order_steps(spark, sf_dir)
    s = st.join(o, st["chain_id"] == o["o_orderkey"]).select(
        F.col("o_custkey").alias("conv_id"), F.col("chain_id").alias("turn"), "turn_idx", "is_correct", "error_type",
        F.col("is_correct").cast("long").alias("y"), (1 - F.col("risk") > 0.5).alias("pred"))
    return memory.bucket_metrics(s)


#: DuckDB's word boundary is ASCII-only; with every non-ASCII character turned into '_' it agrees with the
#: Unicode one on texts whose non-ASCII characters are letters or digits, as in these tables
_RICH_STOP = ", ".join(f"'{w}'" for w in memory.RICH_STOP)
_RICH_SQL = f"""
    with t as (select conv_id, turn, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') as x from conversations),
    e as (select conv_id, turn, unnest(list_filter(regexp_extract_all(x, '{memory.RICH_NAME_RE}', 1), lambda n: n not in ({_RICH_STOP}))) as entity from t
          union select conv_id, turn, unnest(list_transform(regexp_extract_all(x, '{memory.RICH_NUM_RE}', 1), lambda n: 'number_' || n)) from t
          union select conv_id, turn, unnest(regexp_extract_all(x, '{memory.RICH_PLACE_RE}', 1)) from t)
    select conv_id, turn, entity, case when starts_with(entity, 'number_') then regexp_replace(entity, '^number_0*(.+)$', '\\1') else entity end as value
    from e"""


@register("rich_entities", "H14", _RICH_SQL)
def q_rich_entities(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return memory.rich_entities(c, ["conv_id", "turn"])


@register("template_chain", "H15", """
    with p as (select q.conv_id, q.turn, q.text as question, a.text as answer
               from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1
               where q.role = 'user' and a.role = 'assistant')
    select conv_id, turn, 0 as step_id, 'I need to find the answer to: ' || question as text, '' as depends_on from p
    union all select conv_id, turn, 1, 'Looking through the story for relevant details...', '0' from p
    union all select conv_id, turn, 2, 'Based on the information, the answer is: ' || answer, '0,1' from p""")
def q_template_chain(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    q = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    t = memory.template_chain(q.join(a, ["conv_id", "turn"]), ["conv_id", "turn"])
    return t.select("conv_id", "turn", "step_id", "text", F.array_join("depends_on", ",").alias("depends_on"))


def _draw(k: int) -> str:
    return hash_key_sql("(conv_id * 1009 + turn)", 42 + k)


_NEG = memory.NEGATIONS
_FAULT_SQL = f"""
    with t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as turn_idx,
                      regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') as x from conversations),
    l as (select conv_id, turn, list_concat(list_concat(
                 list_filter(regexp_extract_all(x, '{memory.RICH_NAME_RE}', 1), lambda n: n not in ({_RICH_STOP})),
                 list_transform(regexp_extract_all(x, '{memory.RICH_NUM_RE}', 1), lambda n: 'number_' || n)),
                 regexp_extract_all(x, '{memory.RICH_PLACE_RE}', 1)) as e from t),
    u as (select conv_id, turn, unnest(e) as entity, unnest(range(len(e))) as pos from l),
    f as (select conv_id, entity, min((turn, pos)) as fs, arg_min(turn, (turn, pos)) as ft from u group by 1, 2),
    r as (select conv_id, entity, row_number() over (partition by conv_id order by fs) - 1 as rank from f),
    k as (select t.conv_id, t.turn, turn_idx, (select count(*) from f where f.conv_id = t.conv_id and f.ft < t.turn) as known from t),
    n as (select conv_id, turn, count(*) as n_steps from turn_steps group by 1, 2),
    d as (select conv_id, turn, 1 + {_draw(1)} % (n_steps - 1) as step_idx, {memory.INJECT_KINDS}[{_draw(2)} % 3 + 1] as kind,
                 {_draw(3)} % known as rank, {_draw(4)} % known as rank2, {_draw(5)} as pick
          from k join n using (conv_id, turn) where turn_idx > 0 and known > 0 and n_steps >= 2 and {_draw(0)} % 1000 < 400),
    x as (select d.conv_id, d.turn, d.step_idx, d.kind, s.text, a.entity as old, b.entity as note, pick, starts_with(a.entity, 'number_') as is_num,
                 case when starts_with(a.entity, 'number_') then regexp_replace(a.entity, '^number_0*(.+)$', '\\1') else a.entity end as old_v
          from d join r a on a.conv_id = d.conv_id and a.rank = d.rank join r b on b.conv_id = d.conv_id and b.rank = d.rank2
          join turn_steps s on s.conv_id = d.conv_id and s.turn = d.turn and s.step_idx = d.step_idx),
    c as (select *, list_filter({memory.NEW_NAMES}, lambda m: m <> old_v) as cands, {' or '.join(f"contains(lower(text), '{p}')" for p, _ in _NEG)} as hit from x),
    y as (select *, case when is_num then cast(try_cast(old_v as bigint) + {memory.NUM_SHIFTS}[pick % 6 + 1] as varchar)
                         else cands[pick % len(cands) + 1] end as new_v,
                 kind = 'entity' or (kind = 'claim' and hit) as marked from c),
    z as (select *, case kind when 'entity' then replace(text, old_v, new_v)
                         when 'claim' then case {' '.join(f"when contains(lower(text), '{p}') then replace(text, '{q}', '{w}')" for (p, w), q in zip(_NEG, (p for p, _ in _NEG)))} else text end
                         else text || ' (Note: ' || note || ' was mentioned)' end as new_text from y)
    select conv_id, turn, step_idx, kind, new_text, new_text <> text as changed, not marked as is_correct, marked as is_origin,
           case when kind = 'entity' then 'factual' when marked then 'logical' end as error_type from z"""


@register("fault_injection", "H16", with_views(_FAULT_SQL, "turn_steps"))
def q_fault_injection(spark, sf_dir):
    """Deterministic cross-turn fault injection over the conversations."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return memory.fault_injection(turns, turn_steps(spark, sf_dir))
