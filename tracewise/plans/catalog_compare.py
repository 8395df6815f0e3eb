"""Cross-model queries (X1–X5) over ``order_steps``."""

from __future__ import annotations

from tracewise.operators import compare
import tracewise.plans.catalog_risk  # noqa: F401  (its views are used)
from tracewise.plans.registry import register
from tracewise.sources.fixtures import order_steps, with_views


@register("error_rate_by_model_domain", "X1 X2 X5", with_views("""
    with md as (select model_type, domain, count(*) as total_steps,
                       cast(sum(case when is_correct then 1 else 0 end) as bigint) as correct_steps
                from order_steps group by model_type, domain),
         m as (select model_type, 1 - sum(correct_steps)::double / sum(total_steps) as error_rate
               from md group by model_type),
         r as (select model_type, error_rate, row_number() over (order by error_rate, model_type) as rnk from m)
    select md.model_type, md.domain, md.total_steps,
           round(correct_steps::double / total_steps, 6) + 0.0 as accuracy,
           round(r.error_rate, 6) + 0.0 as error_rate, r.rnk
    from md join r using (model_type)""", "order_steps"))
def q_error_rate_by_model_domain(spark, sf_dir):
    return compare.error_rate_by_model_domain(order_steps(spark, sf_dir))


@register("error_type_mix", "X3", with_views("""
    select model_type, error_type, count(*) as n,
           round(count(*) * 100.0::double / sum(count(*)) over (partition by model_type), 6) + 0.0 as pct
    from order_steps where not is_correct and error_type is not null
    group by model_type, error_type""", "order_steps"))
def q_error_type_mix(spark, sf_dir):
    return compare.error_type_mix(order_steps(spark, sf_dir))


@register("model_similarity", "X4", with_views("""
    with acc as (select model_type, domain,
                        sum(case when is_correct then 1 else 0 end)::double / count(*) as accuracy
                 from order_steps group by model_type, domain),
         models as (select distinct model_type from acc),
         pairs as (select a.model_type as model_a, b.model_type as model_b
                   from models a join models b on a.model_type < b.model_type),
         dom as (select p.model_a, p.model_b, x.domain from pairs p join acc x on x.model_type = p.model_a
                 union
                 select p.model_a, p.model_b, x.domain from pairs p join acc x on x.model_type = p.model_b)
    select d.model_a, d.model_b,
           round(avg(1 - abs(coalesce(a.accuracy, 0) - coalesce(b.accuracy, 0))), 6) + 0.0 as similarity
    from dom d
    left join acc a on a.model_type = d.model_a and a.domain = d.domain
    left join acc b on b.model_type = d.model_b and b.domain = d.domain
    group by d.model_a, d.model_b""", "order_steps"))
def q_model_similarity(spark, sf_dir):
    return compare.model_similarity(order_steps(spark, sf_dir))


@register("comparative_report", "X6", with_views("""
    with er as (select model_type, sum((not is_correct)::int)::double / count(*) as e from order_steps group by 1),
    acc as (select model_type, domain, sum(is_correct::int)::double / count(*) as a from order_steps group by 1, 2),
    pairs as (select a.model_type as ma, b.model_type as mb from er a join er b on a.model_type < b.model_type),
    dom as (select p.ma, p.mb, x.domain from pairs p join acc x on x.model_type = p.ma
            union select p.ma, p.mb, x.domain from pairs p join acc x on x.model_type = p.mb),
    sim as (select d.ma, d.mb, round(avg(1 - abs(coalesce(a.a, 0) - coalesce(b.a, 0))), 6) + 0.0 as s
            from dom d left join acc a on a.model_type = d.ma and a.domain = d.domain
            left join acc b on b.model_type = d.mb and b.domain = d.domain group by 1, 2),
    vs as (select m.model_type, round(coalesce(sum(frequency * severity) / sum(frequency), 0), 6) + 0.0 as v
           from (select distinct model_type from order_steps) m left join pstore using (model_type) group by m.model_type)
    select 'error_rate' as section, model_type as key, round(e, 6) + 0.0 as value from er
    union all select 'accuracy', model_type || '|' || domain, round(a, 6) + 0.0 from acc
    union all select 'ranking', model_type, row_number() over (order by e, model_type)::double from er
    union all select 'similarity', ma || '|' || mb, s from sim
    union all select 'error_mix', model_type || '|' || error_type,
                     round(count(*) * 100.0::double / sum(count(*)) over (partition by model_type), 6) + 0.0
              from order_steps where not is_correct and error_type is not null group by model_type, error_type
    union all select 'vulnerability', model_type, v from vs
    union all select 'vulnerability_ranking', model_type, row_number() over (order by v desc, model_type)::double from vs
    union all select 'totals', 'total_chains', count(distinct chain_id)::double from order_steps
    union all select 'totals', 'models', count(distinct model_type)::double from order_steps""", "order_steps", "pstore"))
def q_comparative_report(spark, sf_dir):
    return compare.comparative_report(order_steps(spark, sf_dir))


@register("dataset_balance", "Q3", with_views("""
    select count(distinct chain_id) as total_chains, count(*) as total_nodes,
           cast(sum(is_correct::int) as bigint) as correct_nodes, cast(count(*) - sum(is_correct::int) as bigint) as incorrect_nodes,
           round(sum(is_correct::int) * 100.0::double / count(*), 1) as correct_pct,
           round((count(*) - sum(is_correct::int)) * 100.0::double / count(*), 1) as incorrect_pct,
           cast(sum(is_origin::int) as bigint) as origin_nodes
    from order_steps""", "order_steps"))
def q_dataset_balance(spark, sf_dir):
    from tracewise.operators.synth import dataset_balance
    return dataset_balance(order_steps(spark, sf_dir))
