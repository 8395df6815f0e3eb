"""Proactive risk (R1–R6, R10–R17, C12) and pattern mining (P3–P10) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewise.functions.common import hash_key_sql
from tracewise.operators import patterns, risk, split
from tracewise.plans.registry import register
from tracewise.sources.fixtures import SQL_VIEWS, event_steps, order_steps, with_views

_BAND = "case when {x} < 0.3 then 'LOW' when {x} < 0.7 then 'MEDIUM' else 'HIGH' end"

SQL_VIEWS.update({
    "r1_labels": (("order_steps",), f"""
        select chain_id, idx, coalesce(nx - idx, -1) as steps_until_error, fc as future_error_count,
               coalesce(nx - idx, -1) > 0 as is_vulnerable,
               case when nx is null then 'LOW' when nx - idx = 1 then 'HIGH' when nx - idx <= 3 then 'MEDIUM' else 'LOW' end
                   as risk_level
        from (select chain_id, idx,
                     min(case when not is_correct then idx end) over w as nx,
                     count(case when not is_correct then 1 end) over w as fc
              from order_steps
              window w as (partition by chain_id order by idx rows between 1 following and unbounded following))"""),
    "r2_samples": (("order_steps", "r1_labels"), """
        select p.chain_id, p.k, p.idx, l.steps_until_error, l.future_error_count, l.is_vulnerable, l.risk_level
        from (select s.chain_id, s.idx, unnest(range(greatest(s.idx + 1, 3), n.n + 1)) as k
              from order_steps s join (select chain_id, count(*) as n from order_steps group by chain_id
                                       having count(*) >= 3) n using (chain_id)) p
        join r1_labels l using (chain_id, idx)"""),
    "replay": (("event_day_steps",), """
        select p.chain_id, p.idx as k, s.idx as j, s.risk, s.is_correct
        from event_day_steps p join event_day_steps s on s.chain_id = p.chain_id and s.idx <= p.idx"""),
    "occ": (("order_steps",), """
        select model_type || '_' || domain || '_' || coalesce(error_type, 'unknown') || '_' || cast(idx as varchar) as pattern_id,
               model_type, domain, coalesce(error_type, 'unknown') as hallucination_type,
               'Error in step ' || cast(idx as varchar) || ': ' || text as description,
               text as example, case when is_origin then 0.7::double else 0.5::double end as severity, chain_id, idx
        from order_steps where not is_correct"""),
    "pstore": (("occ",), """
        select pattern_id, model_type, domain, hallucination_type, count(*) as frequency,
               arg_min(description, (chain_id, idx)) as description, arg_min(severity, (chain_id, idx)) as severity,
               min((chain_id, idx)) as first_seen,
               array_to_string(list_slice(list_sort(list_distinct(list(example))), 1, 5), '|') as examples
        from occ group by pattern_id, model_type, domain, hallucination_type"""),
})


def _day_steps(spark, sf_dir):
    return event_steps(spark, sf_dir, per_day=True)


@register("lookahead_labels", "R1", with_views("select * from r1_labels", "r1_labels"))
def q_lookahead_labels(spark, sf_dir):
    return risk.lookahead_labels(order_steps(spark, sf_dir))


@register("prefix_samples", "R2 C12", with_views("select * from r2_samples", "r2_samples"))
def q_prefix_samples(spark, sf_dir):
    return risk.prefix_samples(order_steps(spark, sf_dir)).select(
        "chain_id", "k", "idx", "steps_until_error", "future_error_count", "is_vulnerable", "risk_level")


@register("prefix_edges", "C12", with_views("""
    with n as (select chain_id, count(*) as n from order_steps group by chain_id having count(*) >= 3)
    select e.chain_id, e.src, e.dst, unnest(range(greatest(greatest(e.src, e.dst) + 1, 3), n.n + 1)) as k
    from order_edges e join n using (chain_id)""", "order_steps", "order_edges"))
def q_prefix_edges(spark, sf_dir):
    from tracewise.sources.fixtures import order_edges
    s = order_steps(spark, sf_dir)
    _, pe = risk.prefix_chains(s, order_edges(s))
    return pe.select("chain_id", "src", "dst", "k")


@register("sample_stats", "R3 S5", with_views(f"""
    with c as (select distinct chain_id from order_steps),
    h as (select chain_id, row_number() over (order by key, chain_id) - 1 as pos, count(*) over () as n
          from (select chain_id, {hash_key_sql('chain_id')} as key from c)),
    sp as (select chain_id, case when pos < floor(n * 0.2::double) then 'val' else 'train' end as split from h),
    per as (select chain_id, k, max(is_vulnerable::int) as v from r2_samples group by chain_id, k)
    select count(*) filter (where split = 'train') as train_samples, count(*) filter (where split = 'val') as val_samples,
           count(*) filter (where split = 'train' and v = 1) as vulnerable_samples,
           count(*) filter (where split = 'train' and v = 0) as safe_samples
    from per join sp using (chain_id)""", "order_steps", "r2_samples"))
def q_sample_stats(spark, sf_dir):
    s = order_steps(spark, sf_dir)
    sp = split.holdout(s.select("chain_id").distinct(), "chain_id", 0.2)
    return risk.sample_stats(risk.prefix_samples(s), sp)


@register("risk_bands", "R4", with_views(f"""
    select chain_id, count(*) as num_steps, round(max(risk), 6) + 0.0 as overall_risk_score,
           cast(sum((risk >= 0.3)::int) as bigint) as n_vulnerable,
           {_BAND.format(x='max(risk)')} as overall_risk_level
    from event_day_steps group by chain_id""", "event_day_steps"))
def q_risk_bands(spark, sf_dir):
    return risk.risk_bands(_day_steps(spark, sf_dir))


@register("vulnerable_steps", "R5", with_views(f"""
    select chain_id, idx, round(risk, 6) + 0.0 as risk, {_BAND.format(x='risk')} as risk_level
    from event_day_steps where risk >= 0.3""", "event_day_steps"))
def q_vulnerable_steps(spark, sf_dir):
    s = risk.steps_at_level(_day_steps(spark, sf_dir), "MEDIUM")
    return s.select("chain_id", "idx", F.round("risk", 6).alias("risk"), risk.band("risk").alias("risk_level"))


@register("running_risk", "R6", with_views(f"""
    select chain_id, idx, round(risk, 6) + 0.0 as risk, round(m, 6) + 0.0 as prefix_risk, {_BAND.format(x='m')} as prefix_level
    from (select *, max(risk) over (partition by chain_id order by idx rows between unbounded preceding and current row) as m
          from event_day_steps)""", "event_day_steps"))
def q_running_risk(spark, sf_dir):
    return risk.running_risk(_day_steps(spark, sf_dir))


_IV_SQL = f"""
    iv as (select chain_id, idx as step_id, case when risk >= 0.7 then 'CORRECTION' else 'WARNING' end as intervention_type,
                  {_BAND.format(x='risk')} as risk_level, round(risk, 6) + 0.0 as risk_score,
                  case when risk < 0.7 then 'CAUTION: Step ' || cast(idx as varchar) || ' shows moderate vulnerability (risk: '
                       || cast(floor(risk * 100 + 0.5)::bigint // 100 as varchar) || '.'
                       || lpad(cast(floor(risk * 100 + 0.5)::bigint % 100 as varchar), 2, '0') || ')' end as warning_message,
                  case when risk >= 0.7 then 'Step ' || cast(idx as varchar) || ': ' || list_extract([
                       'Double-check calculations and verify with the previous step',
                       'Review the logical flow and ensure assumptions are valid',
                       'Verify that all dependencies are correctly satisfied',
                       'Consider alternative approaches to this reasoning step',
                       'Cross-reference with domain knowledge and best practices'], (idx % 5) + 1) end as correction_suggestion
           from event_day_steps where risk >= 0.3)"""


@register("interventions", "R10 R11", with_views(f"with {_IV_SQL} select * from iv", "event_day_steps"))
def q_interventions(spark, sf_dir):
    return risk.interventions(_day_steps(spark, sf_dir))


@register("intervention_stats", "R13", with_views(f"""
    with {_IV_SQL}
    select count(*) as total_interventions, count(*) filter (where intervention_type = 'WARNING') as warnings,
           count(*) filter (where intervention_type = 'CORRECTION') as corrections, 0::bigint as low_count,
           count(*) filter (where risk_level = 'MEDIUM') as medium_count, count(*) filter (where risk_level = 'HIGH') as high_count,
           count(distinct chain_id) as unique_chains
    from iv""", "event_day_steps"))
def q_intervention_stats(spark, sf_dir):
    return risk.intervention_stats(risk.interventions(_day_steps(spark, sf_dir)))


def _replay_sql(warn: str) -> str:
    """Expanded replay in SQL (every prefix re-scores all its steps)."""
    return f"""
    pm as (select chain_id, k, max(risk) as mr, count(*) filter (where risk >= {warn}) as iv from replay group by chain_id, k),
    ch as (select chain_id, min(idx) filter (where not is_correct) as fe from event_day_steps group by chain_id),
    pc as (select pm.chain_id, min(k) filter (where mr >= 0.3) as ff, sum(iv) as ivs from pm group by pm.chain_id),
    r as (select ch.chain_id, fe is not null as has_error, fe is not null and ff is not null as det,
                 fe is not null and ff is not null and ff < fe as early, fe - ff as lead, ivs from ch join pc using (chain_id))"""


_METRICS_SQL = """
    select count(*) as total_chains, count(*) filter (where has_error) as chains_with_errors,
           count(*) filter (where det) as vulnerability_detected, count(*) filter (where early) as early_detections,
           cast(sum(ivs) as bigint) as interventions_triggered,
           count(*) filter (where not has_error and ivs > 0) as false_positives,
           count(*) filter (where has_error and not det) as false_negatives,
           round(coalesce(count(*) filter (where det) / nullif(count(*) filter (where has_error), 0), 0), 6) + 0.0 as detection_rate,
           round(coalesce(count(*) filter (where early) / nullif(count(*) filter (where has_error), 0), 0), 6) + 0.0 as early_detection_rate,
           round(coalesce(avg(lead) filter (where early), 0), 6) + 0.0 as avg_time_to_detection,
           round(coalesce(count(*) filter (where not has_error and ivs > 0) / nullif(count(*) filter (where not has_error), 0), 0), 6) + 0.0
               as false_positive_rate
    from r"""


@register("proactive_eval", "R14 R15", with_views(f"with {_replay_sql('0.3')} {_METRICS_SQL}", "event_day_steps", "replay"))
def q_proactive_eval(spark, sf_dir):
    return risk.proactive_metrics(risk.chain_replay(_day_steps(spark, sf_dir)))


@register("target_assessment", "R17", with_views(f"""
    with {_replay_sql('0.3')}, m as ({_METRICS_SQL}),
    t(metric, target, direction) as (values ('detection_rate', 0.8::double, '>='), ('false_positive_rate', 0.2::double, '<='),
                                            ('early_detection_rate', 0.7::double, '>=')),
    l as (select 'detection_rate' as metric, detection_rate as actual from m
          union all select 'false_positive_rate', false_positive_rate from m
          union all select 'early_detection_rate', early_detection_rate from m)
    select metric, actual, target, direction,
           case when direction = '<=' then actual <= target else actual >= target end as passed
    from l join t using (metric)""", "event_day_steps", "replay"))
def q_target_assessment(spark, sf_dir):
    m = risk.proactive_metrics(risk.chain_replay(_day_steps(spark, sf_dir)))
    t = spark.createDataFrame(risk.TARGETS, "metric string, target double, direction string")
    return risk.target_assessment(m, t)


def _grid_sql() -> str:
    parts = []
    for w in risk.WARN_GRID:
        parts.append(f"select {w}::double as warn_threshold, * from (with {_replay_sql(str(w))} {_METRICS_SQL})")
    per = "\n union all ".join(parts)
    vals = ", ".join(f"({w}::double, {c}::double)" for w in risk.WARN_GRID for c in risk.CORRECT_GRID)
    return f"""
    with g(warn_threshold, correct_threshold) as (values {vals}),
    pw as ({per}),
    j as (select g.correct_threshold, pw.*, pw.detection_rate >= 0.8 and pw.false_positive_rate <= 0.2 as valid
          from g join pw using (warn_threshold) where g.correct_threshold > g.warn_threshold)
    select warn_threshold, correct_threshold, detection_rate, false_positive_rate, early_detection_rate, avg_time_to_detection,
           interventions_triggered, valid,
           case when valid then row_number() over (partition by valid order by early_detection_rate desc, warn_threshold,
                                                   correct_threshold) end as rank_valid,
           row_number() over (order by detection_rate desc, false_positive_rate asc, warn_threshold, correct_threshold) as rank_tradeoff
    from j"""


@register("threshold_grid", "R16", with_views(_grid_sql(), "event_day_steps", "replay"))
def q_threshold_grid(spark, sf_dir):
    return risk.threshold_grid(_day_steps(spark, sf_dir))


# --- patterns ----------------------------------------------------------------

def _store(spark, sf_dir):
    return patterns.pattern_store(patterns.extract_occurrences(order_steps(spark, sf_dir)))


@register("pattern_store", "P3 P4 IO9", with_views("""
    select pattern_id, model_type, domain, hallucination_type, description, frequency, examples, severity from pstore""",
                                                "pstore"))
def q_pattern_store(spark, sf_dir):
    return _store(spark, sf_dir).select("pattern_id", "model_type", "domain", "hallucination_type", "description",
                                        "frequency", F.array_join("examples", "|").alias("examples"), "severity")


@register("pattern_stats", "P5", with_views("""
    with g as (select model_type, count(*) as total_patterns, sum(frequency) as total_frequency,
                      avg(severity * frequency) as m from pstore group by model_type),
    t as (select model_type, string_agg(hallucination_type || ':' || f, ',' order by hallucination_type || ':' || f) as type_dist
          from (select model_type, hallucination_type, sum(frequency) as f from pstore group by 1, 2) group by model_type),
    d as (select model_type, string_agg(domain || ':' || f, ',' order by domain || ':' || f) as domain_dist
          from (select model_type, domain, sum(frequency) as f from pstore group by 1, 2) group by model_type)
    select model_type, total_patterns, cast(total_frequency as bigint) as total_frequency,
           round(m / total_frequency, 6) + 0.0 as avg_severity, type_dist, domain_dist
    from g join t using (model_type) join d using (model_type)""", "pstore"))
def q_pattern_stats(spark, sf_dir):
    return patterns.model_stats(_store(spark, sf_dir))


@register("pattern_profile", "P7 P8", with_views("""
    with g as (select model_type, count(*) as total_patterns, sum(frequency) as total_frequency,
                      sum(frequency * severity) as fs from pstore group by model_type),
    tt as (select model_type, arg_min(hallucination_type, (-f, fs)) as most_common_type
           from (select model_type, hallucination_type, sum(frequency) as f, min(first_seen) as fs from pstore group by 1, 2)
           group by model_type),
    td as (select model_type, arg_min(domain, (-f, fs)) as most_vulnerable_domain
           from (select model_type, domain, sum(frequency) as f, min(first_seen) as fs from pstore group by 1, 2)
           group by model_type),
    p as (select model_type, total_patterns, cast(total_frequency as bigint) as total_frequency,
                 round(fs / total_frequency, 6) + 0.0 as vulnerability_score, most_common_type, most_vulnerable_domain
          from g join tt using (model_type) join td using (model_type))
    select *, round(case when max(vulnerability_score) over () > 0
                         then vulnerability_score / max(vulnerability_score) over () else 0 end, 6) + 0.0 as relative_vulnerability
    from p""", "pstore"))
def q_pattern_profile(spark, sf_dir):
    store = _store(spark, sf_dir)
    models = store.select("model_type").distinct()
    prof = patterns.vulnerability_profile(store, models)
    rel = patterns.compare_models(prof).select("model_type", "relative_vulnerability")
    return prof.join(rel, "model_type")


@register("pattern_similar", "P9", with_views("""
    with probe as (select * from pstore order by frequency desc, pattern_id limit 1)
    select probe.pattern_id as probe_id, s.pattern_id,
           round((case when s.hallucination_type = probe.hallucination_type then 0.4 else 0 end)
                 + (case when s.domain = probe.domain then 0.3 else 0 end)
                 + 0.3 * (1 - abs(s.severity - probe.severity)), 6) + 0.0 as similarity
    from pstore s, probe
    where s.pattern_id <> probe.pattern_id
      and (case when s.hallucination_type = probe.hallucination_type then 0.4 else 0 end)
          + (case when s.domain = probe.domain then 0.3 else 0 end)
          + 0.3 * (1 - abs(s.severity - probe.severity)) >= 0.7 - 1e-12""", "pstore"))
def q_pattern_similar(spark, sf_dir):
    store = _store(spark, sf_dir)
    probe = store.orderBy(F.col("frequency").desc(), "pattern_id").limit(1)
    return patterns.similar_patterns(store, probe, 0.7)


@register("pattern_summary", "P10", with_views("""
    select count(*) as total_patterns, count(distinct model_type) as total_models,
           string_agg(distinct model_type, ',' order by model_type) as models,
           string_agg(distinct hallucination_type, ',' order by hallucination_type) as hallucination_types,
           string_agg(distinct domain, ',' order by domain) as domains
    from pstore""", "pstore"))
def q_pattern_summary(spark, sf_dir):
    return patterns.store_summary(_store(spark, sf_dir))


@register("pattern_filter", "P6", with_views("""
    select pattern_id, frequency, severity from pstore where model_type = 'model_0' and domain = 'math'""", "pstore"))
def q_pattern_filter(spark, sf_dir):
    return patterns.filter_patterns(_store(spark, sf_dir), model_type="model_0", domain="math").select(
        "pattern_id", "frequency", "severity")
