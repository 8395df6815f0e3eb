"""Validation (V1–V5) and split (S1–S7) queries.

The validation input plants defects into ``order_steps`` by arithmetic on
chain_id (duplicate ids, reversed ids, extra origins, an origin marked
correct, an edge to a missing node, a 3-element edge, an invalid
dependency) so that every rule fires at every scale factor.  The planting
only builds input rows; all detection runs in ``tracewise.operators``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewise.functions.common import hash_key_sql
from tracewise.operators import split, validate
from tracewise.plans.registry import register
from tracewise.sources.fixtures import (SQL_VIEWS, order_chains, order_edges, order_steps,
                                        with_views)
from tracewise.sources.tables import table
from tracewise.session import cut_lineage

# --- planted-defect input (Spark) ------------------------------------------


def validation_input(spark, sf_dir):
    # the rules read the steps many times: materialise them once
    s = cut_lineage(order_steps(spark, sf_dir).select("chain_id", "idx", "domain", "is_correct", "is_origin"))
    m = F.col("chain_id") % 50
    idx = F.col("idx")
    steps = s.select(
        "chain_id", "idx", "domain", "is_correct",
        F.when((m == 1) & (idx == 1), F.lit(0)).when(m == 2, 100 - idx).otherwise(idx).cast("long").alias("step_id"),
        F.when(m == 3, ~F.col("is_correct")).when((m == 4) & (idx == 0), F.lit(True))
         .otherwise(F.col("is_origin")).alias("is_origin"),
        F.when(idx == 0, F.when(m == 6, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")))
         .otherwise(F.array(idx - 1)).alias("depends_on"),
    )
    nodes = s.select("chain_id", F.col("idx").alias("node"))
    first = s.filter(idx == 0)
    edges = (order_edges(s).select("chain_id", F.array("src", "dst").alias("edge"))
             .unionByName(first.filter(m == 5).select("chain_id", F.array(idx, idx + 100).alias("edge")))
             .unionByName(first.filter(m == 7).select("chain_id", F.array(idx, idx + 1, idx + 2).alias("edge"))))
    return steps, nodes, edges


SQL_VIEWS.update({
    "vsteps": (("order_steps",), """
        select chain_id, idx, domain, is_correct,
               case when chain_id % 50 = 1 and idx = 1 then 0 when chain_id % 50 = 2 then 100 - idx else idx end as step_id,
               case when chain_id % 50 = 3 then not is_correct when chain_id % 50 = 4 and idx = 0 then true
                    else is_origin end as is_origin,
               case when idx = 0 then (case when chain_id % 50 = 6 then [-1::bigint] else []::bigint[] end)
                    else [idx - 1] end as depends_on
        from order_steps"""),
    "vnodes": (("order_steps",), "select chain_id, idx as node from order_steps"),
    "vedges": (("order_edges", "order_steps"), """
        select chain_id, [src, dst] as edge from order_edges
        union all select chain_id, [idx, idx + 100] from order_steps where chain_id % 50 = 5 and idx = 0
        union all select chain_id, [idx, idx + 1, idx + 2] from order_steps where chain_id % 50 = 7 and idx = 0"""),
    "vmsgs": (("vsteps", "vnodes", "vedges"), """
        select chain_id, 'duplicate_step_ids' as rule, 'Duplicate step_ids found' as message
        from vsteps group by chain_id having count(*) <> count(distinct step_id)
        union all
        select chain_id, 'unsorted_step_ids', 'step_ids must be sorted'
        from (select chain_id, step_id, lag(step_id) over (partition by chain_id order by idx) as p from vsteps)
        where step_id < p group by chain_id
        union all
        select chain_id, 'multiple_origins',
               'Multiple origin steps found: [' || string_agg(cast(step_id as varchar), ', ' order by idx) || ']'
        from vsteps where is_origin group by chain_id having count(*) > 1
        union all
        select chain_id, 'origin_marked_correct', 'Origin step ' || cast(step_id as varchar) || ' is marked as correct'
        from vsteps where is_origin and is_correct
        union all
        select distinct chain_id, 'nodes_mismatch', 'Dependency graph nodes don''t match step_ids'
        from ((select chain_id, step_id as node from vsteps except select chain_id, node from vnodes)
              union all (select chain_id, node from vnodes except select chain_id, step_id from vsteps))
        union all
        select chain_id, 'invalid_edge_format', 'Invalid edge format: [' || array_to_string(edge, ', ') || ']'
        from vedges where len(edge) <> 2
        union all
        select chain_id, 'edge_invalid_node', 'Edge references invalid node: [' || array_to_string(edge, ', ') || ']'
        from vedges e where len(edge) = 2
          and (not exists (select 1 from vnodes n where n.chain_id = e.chain_id and n.node = e.edge[1])
               or not exists (select 1 from vnodes n where n.chain_id = e.chain_id and n.node = e.edge[2]))
        union all
        select chain_id, 'invalid_dependency',
               'Step ' || cast(step_id as varchar) || ' depends on invalid step_id ' || cast(dep as varchar)
        from (select chain_id, step_id, unnest(depends_on) as dep from vsteps) d
        where not exists (select 1 from vsteps s where s.chain_id = d.chain_id and s.step_id = d.dep)"""),
})


@register("validation_report", "V1 V2", with_views("""
    select rule, count(distinct chain_id) as n_chains, count(*) as n_messages from vmsgs group by rule""", "vmsgs"))
def q_validation_report(spark, sf_dir):
    steps, nodes, edges = validation_input(spark, sf_dir)
    return validate.validation_report(validate.validation_messages(steps, nodes, edges))


@register("quality_report", "V2 V3", with_views("""
    with prof as (
        select o.chain_id, o.domain, coalesce(a.n_steps, 0) as n_steps,
               coalesce(a.n_wrong::double / nullif(a.n_steps, 0), 0) as error_rate, a.origin_pos
        from order_chains o left join (
            select chain_id, count(*) as n_steps, sum(case when is_correct then 0 else 1 end) as n_wrong,
                   arg_min(step_id, idx) filter (where is_origin) as origin_pos
            from vsteps group by chain_id) a using (chain_id)),
    bad as (select distinct chain_id, 1 as inv from vmsgs),
    md as (select o.domain, count(*) as total_errors, count(distinct message) as unique_errors
           from vmsgs m join order_chains o using (chain_id) group by o.domain),
    rep as (select p.domain, count(*) as total_samples, cast(sum(coalesce(b.inv, 0)) as bigint) as invalid_samples,
                   avg(n_steps) as len_mean, median(n_steps) as len_median, min(n_steps) as len_min,
                   max(n_steps) as len_max, stddev_pop(n_steps) as len_std,
                   avg(error_rate) as err_mean, median(error_rate) as err_median,
                   avg(origin_pos) as origin_mean, median(origin_pos) as origin_median
            from prof p left join bad b using (chain_id) group by p.domain)
    select r.domain, total_samples, total_samples - invalid_samples as valid_samples, invalid_samples,
           round((total_samples - invalid_samples)::double / total_samples, 6) + 0.0 as validity_rate,
           round(len_mean, 6) + 0.0 as len_mean, round(len_median, 6) + 0.0 as len_median,
           len_min, len_max, round(len_std, 6) + 0.0 as len_std,
           round(err_mean, 6) + 0.0 as err_mean, round(err_median, 6) + 0.0 as err_median,
           round(coalesce(origin_mean, 0), 6) + 0.0 as origin_mean,
           round(coalesce(origin_median, 0), 6) + 0.0 as origin_median,
           coalesce(total_errors, 0) as total_errors, coalesce(unique_errors, 0) as unique_errors
    from rep r left join md using (domain)""", "vmsgs", "order_chains"))
def q_quality_report(spark, sf_dir):
    steps, nodes, edges = validation_input(spark, sf_dir)
    msgs = validate.validation_messages(steps, nodes, edges)
    return validate.quality_report(steps, order_chains(spark, sf_dir), msgs)


@register("error_histogram", "V3", with_views("""
    select message, count(*) as n from vmsgs group by message""", "vmsgs"))
def q_error_histogram(spark, sf_dir):
    steps, nodes, edges = validation_input(spark, sf_dir)
    return validate.error_histogram(validate.validation_messages(steps, nodes, edges))


@register("unreached_nodes", "V4", with_views("""
    with recursive e as (select chain_id, src, dst from order_edges where not (chain_id % 7 = 0 and dst = 2)),
    u as (select chain_id, src as a, dst as b from e union select chain_id, dst, src from e),
    r(chain_id, node) as (select distinct chain_id, 0::bigint from order_steps
                          union select r.chain_id, u.b from r join u on r.chain_id = u.chain_id and r.node = u.a),
    n as (select chain_id, idx as node from order_steps)
    select chain_id, node
    from n where not exists (select 1 from r where r.chain_id = n.chain_id and r.node = n.node)""",
                                            "order_steps", "order_edges"))
def q_unreached_nodes(spark, sf_dir):
    s = order_steps(spark, sf_dir)
    e = order_edges(s).filter(~((F.col("chain_id") % 7 == 0) & (F.col("dst") == 2)))
    return validate.unreached_nodes(s.select("chain_id", F.col("idx").alias("node")), e, s)


@register("label_inconsistency", "V5", with_views("""
    with ve as (select chain_id, edge[1] as src, edge[2] as dst from vedges where len(edge) = 2),
    f as (select chain_id, arg_min(step_id, idx) as step_id, arg_min(is_correct, idx) as oc, count(*) as n
          from vsteps where is_origin group by chain_id)
    select chain_id, null::bigint as step_id, 'multiple_origins' as issue from f where n > 1
    union all select chain_id, step_id, 'origin_marked_correct' from f where oc
    union all
    select s.chain_id, s.step_id, 'dependent_marked_correct'
    from (select distinct f.chain_id, e.dst from f join ve e on e.chain_id = f.chain_id and e.src = f.step_id) d
    join vsteps s on s.chain_id = d.chain_id and s.step_id = d.dst and s.is_correct""", "vsteps", "vedges"))
def q_label_inconsistency(spark, sf_dir):
    steps, nodes, edges = validation_input(spark, sf_dir)
    e2 = edges.filter(F.size("edge") == 2).select("chain_id", F.col("edge")[0].alias("src"), F.col("edge")[1].alias("dst"))
    return validate.label_inconsistency(steps, e2)


# --- splits ----------------------------------------------------------------

_SPLIT_SQL = f"""
    with st as (select o.chain_id, o.domain, coalesce(e.he, false) as has_error
                from order_chains o left join (select chain_id, bool_or(not is_correct) as he
                                               from order_steps group by chain_id) e using (chain_id)),
    k as (select *, {hash_key_sql('chain_id')} as key from st),
    p as (select *, row_number() over (partition by domain, has_error order by key, chain_id) - 1 as pos,
                 count(*) over (partition by domain, has_error) as n from k),
    s as (select chain_id, domain, has_error,
                 case when pos < floor(n * 0.7::double) then 'train'
                      when pos < floor(n * 0.7::double) + floor(n * 0.15::double) then 'val' else 'test' end as split
          from p)
"""


def _split_chains(spark, sf_dir):
    strata = split.chain_strata(order_steps(spark, sf_dir), order_chains(spark, sf_dir))
    return split.assign_splits(strata, ["domain", "has_error"])


@register("stratified_split", "S1 S2", with_views(_SPLIT_SQL + " select * from s", "order_chains", "order_steps"))
def q_stratified_split(spark, sf_dir):
    return _split_chains(spark, sf_dir).select("chain_id", "domain", "has_error", "split")


@register("split_stats", "S3", with_views(_SPLIT_SQL + """
    select split, domain, has_error, count(*) as n from s
    group by grouping sets ((split), (split, domain), (split, has_error))""", "order_chains", "order_steps"))
def q_split_stats(spark, sf_dir):
    return split.split_stats(_split_chains(spark, sf_dir))


@register("split_leakage", "S6", with_views(f"""
    with k as (select doc_id, text, lang, {hash_key_sql('doc_id')} as key from documents),
    p as (select *, row_number() over (partition by lang order by key, doc_id) - 1 as pos,
                 count(*) over (partition by lang) as n from k),
    s as (select doc_id, text, case when pos < floor(n * 0.7::double) then 'train'
                                    when pos < floor(n * 0.7::double) + floor(n * 0.15::double) then 'val'
                                    else 'test' end as split from p),
    fi as (select doc_id, max((split = 'train')::int) as tr, max((split = 'val')::int) as va,
                  max((split = 'test')::int) as te from s group by doc_id),
    ft as (select lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as t, max((split = 'train')::int) as tr,
                  max((split = 'val')::int) as va, max((split = 'test')::int) as te from s group by t),
    ci as (select 'train' as split_a, 'val' as split_b, cast(sum(tr * va) as bigint) as shared_ids from fi
           union all select 'train', 'test', cast(sum(tr * te) as bigint) from fi
           union all select 'val', 'test', cast(sum(va * te) as bigint) from fi),
    ct as (select 'train' as split_a, 'val' as split_b, cast(sum(tr * va) as bigint) as shared_texts from ft
           union all select 'train', 'test', cast(sum(tr * te) as bigint) from ft
           union all select 'val', 'test', cast(sum(va * te) as bigint) from ft)
    select * from ci join ct using (split_a, split_b)"""))
def q_split_leakage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("domain"))
    s = split.assign_splits(d, ["domain"], id_col="doc_id")
    return split.split_leakage(s, "text", "doc_id")


@register("plain_split", "S4", with_views(f"""
    with q as (select 'query_' || cast(o_orderkey as varchar) as query_id from orders),
    p as (select query_id, row_number() over (order by {hash_key_sql('query_id')}, query_id) - 1 as pos, count(*) over () as n from q)
    select query_id, case when pos < floor(n * 0.7::double) then 'train'
                          when pos < floor(n * 0.7::double) + floor(n * 0.15::double) then 'val' else 'test' end as split from p"""))
def q_plain_split(spark, sf_dir):
    # string ids, one stratum
    q = table(spark, sf_dir, "orders").select(F.concat(F.lit("query_"), F.col("o_orderkey").cast("string")).alias("query_id"))
    return split.assign_splits(q, [], id_col="query_id")


@register("class_balance", "S7 D6", with_views("""
    with t(domain, origin_threshold) as (values ('math', 0.5::double), ('code', 0.3::double), ('medical', 0.25::double))
    select domain, cast(sum(is_origin::int) as bigint) as pos, cast(sum((not is_origin)::int) as bigint) as neg,
           round(sum((not is_origin)::int) / (sum(is_origin::int) + 1e-8), 6) + 0.0 as pos_weight, t.origin_threshold
    from order_steps left join t using (domain) group by domain, t.origin_threshold""", "order_steps"))
def q_class_balance(spark, sf_dir):
    # Per-domain origin thresholds of the reference runs (0.5 / 0.3 / 0.25).
    th = spark.createDataFrame([("math", 0.5), ("code", 0.3), ("medical", 0.25)], "domain string, origin_threshold double")
    return split.class_balance(order_steps(spark, sf_dir), th)
