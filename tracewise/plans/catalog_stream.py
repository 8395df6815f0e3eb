"""Streaming queries.

Each streaming key runs a real Structured Streaming query to completion
(``availableNow``) into a parquet table in the shared checkpoint folder and
returns that table; its oracle is the equivalent *batch* SQL, so the check
is "stream result = batch result".
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewise.plans.registry import register
from tracewise.sources.fixtures import mention_lines, with_views
from tracewise.sources.tables import table
from tracewise.streaming import stream as S
from tracewise.functions.common import r6

_FMT = "yyyy-MM-dd HH:mm:ss"


def _run(spark, sf_dir, operator, name):
    """``operator`` over the step events, run to completion."""
    ev = S.events_stream(spark, sf_dir)
    return S.run_to_table(operator(S.step_events(ev.df)), name, flush=ev.flush)


_EV_SQL = """ev as (select user_id, event_id, ts, event_type <> 'error' as is_correct,
                   round(least(value / 100, 1.0), 6) as risk from events)"""


@register("stream_windows", "R18", with_views(f"""
    with {_EV_SQL}
    select strftime(time_bucket(interval '1 day', ts), '%Y-%m-%d %H:%M:%S') as window_start,
           strftime(time_bucket(interval '1 day', ts) + interval '1 day', '%Y-%m-%d %H:%M:%S') as window_end,
           count(*) as n_steps, round(avg((not is_correct)::int::double), 6) + 0.0 as error_rate,
           round(max(risk), 6) + 0.0 as max_risk
    from ev group by time_bucket(interval '1 day', ts)"""))
def q_stream_windows(spark, sf_dir):
    out = _run(spark, sf_dir, S.tumbling_metrics, "windows")
    return out.select(F.date_format("window_start", _FMT).alias("window_start"),
                      F.date_format("window_end", _FMT).alias("window_end"), "n_steps",
                      r6("error_rate").alias("error_rate"), r6("max_risk").alias("max_risk"))


@register("stream_sliding", "R18", with_views(f"""
    with {_EV_SQL},
    x as (select time_bucket(interval '6 hours', ts) - to_hours(k * 6) as ws, is_correct
          from ev, range(4) t(k))
    select strftime(ws, '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n_steps,
           round(avg((not is_correct)::int::double), 6) + 0.0 as error_rate
    from x group by ws"""))
def q_stream_sliding(spark, sf_dir):
    out = _run(spark, sf_dir, S.sliding_error_rate, "sliding")
    return out.select(F.date_format("window_start", _FMT).alias("window_start"), "n_steps",
                      r6("error_rate").alias("error_rate"))


@register("stream_sessions", "R18", with_views(f"""
    with {_EV_SQL},
    g as (select *, sum(case when lag_ts is null or ts - lag_ts >= interval '6 hours' then 1 else 0 end)
                        over (partition by user_id order by ts, event_id) as sid
          from (select *, lag(ts) over (partition by user_id order by ts, event_id) as lag_ts from ev))
    select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as session_start,
           strftime(max(ts) + interval '6 hours', '%Y-%m-%d %H:%M:%S.%f') as session_end,
           count(*) as n_steps, round(max(risk), 6) + 0.0 as max_risk, cast(sum((not is_correct)::int) as bigint) as n_errors
    from g group by user_id, sid"""))
def q_stream_sessions(spark, sf_dir):
    out = _run(spark, sf_dir, S.sessions, "sessions")
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return out.filter(F.col("user_id") != S.SENTINEL_USER).select(
        "user_id", F.date_format("session_start", fmt).alias("session_start"),
        F.date_format("session_end", fmt).alias("session_end"), "n_steps", r6("max_risk").alias("max_risk"),
        F.col("n_errors").cast("long").alias("n_errors"))


@register("stream_dedup", "R19", """
    select user_id, count(distinct event_id) as n_events from events group by user_id""")
def q_stream_dedup(spark, sf_dir):
    # the same events arrive twice (two sources); each (user, event) must survive once
    again = S.step_events(S.events_stream(spark, sf_dir, sentinel=False).df)
    out = _run(spark, sf_dir, lambda steps: S.dedup_steps(steps.unionByName(again), ["user_id", "event_id"]), "dedup")
    return (out.filter(F.col("user_id") != S.SENTINEL_USER).groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("n_events")))


@register("stream_chain_state", "R7 R9", with_views("""
    select chain_id, count(*) as num_steps, cast(sum((not is_correct)::int) as bigint) as num_errors,
           round(max(risk), 6) + 0.0 as max_risk,
           case when max(risk) < 0.3 then 'LOW' when max(risk) < 0.7 then 'MEDIUM' else 'HIGH' end as overall_risk_level,
           coalesce(min(idx) filter (where not is_correct), -1) as first_error_step,
           coalesce(min(idx) filter (where risk >= 0.3), -1) as first_flag_step,
           cast(coalesce(sum(cnt - idx) filter (where risk >= 0.3), 0) as bigint) as replay_interventions
    from (select *, count(*) over (partition by chain_id) as cnt from event_day_steps)
    group by chain_id""", "event_day_steps"))
def q_stream_chain_state(spark, sf_dir):
    out = _run(spark, sf_dir, S.chain_state, "chain_state")
    return out.filter(F.col("chain_id") >= 0).select(
        "chain_id", "num_steps", "num_errors", r6("max_risk").alias("max_risk"), "overall_risk_level",
        "first_error_step", "first_flag_step", "replay_interventions")


@register("stream_step_status", "R7 R8", with_views("""
    select chain_id, idx, event_id, case when idx > 0 then idx - 1 end as parent_idx, risk, running_max_risk, running_errors,
           case when coalesce(running_max_risk, 0) < 0.3 then 'LOW' when running_max_risk < 0.7 then 'MEDIUM' else 'HIGH' end as running_risk_level
    from (select *, max(risk) over w as running_max_risk, cast(sum((not is_correct)::int) over w as bigint) as running_errors
          from event_day_steps window w as (partition by chain_id order by idx rows between unbounded preceding and current row))""",
    "event_day_steps"))
def q_stream_step_status(spark, sf_dir):
    return _run(spark, sf_dir, S.chain_steps, "step_status").filter(F.col("chain_id") >= 0)


#: what a user asks for right after an event of each type
COMMANDS = {"error": "status", "view": "status", "click": "list", "purchase": "end", "signup": "clear"}


@register("stream_lifecycle", "R7", with_views("""
    with x as (select s.*, e.event_type, s.chain_id // 100000 as uid from event_day_steps s join events e using (event_id)),
    y as (select *, coalesce(sum((event_type in ('purchase', 'signup'))::int) over (partition by chain_id order by idx
                             rows between unbounded preceding and 1 preceding), 0) as part from x),
    z as (select *, count(*) over w as n, cast(sum((not is_correct)::int) over w as bigint) as wrong, max(risk) over w as top
          from y window w as (partition by chain_id, part order by idx rows between unbounded preceding and current row))
    select user_id, event_id, case event_type when 'click' then 'list' when 'purchase' then 'end' when 'signup' then 'clear' else 'status' end as command,
           case event_type when 'view' then chain_id - 1 when 'signup' then null else chain_id end as chain_id,
           case event_type when 'view' then 'not_found' when 'signup' then 'cleared' when 'purchase' then 'ended' else 'active' end as status,
           case event_type when 'view' then null when 'signup' then 1 else n end as step_count,
           case when event_type not in ('view', 'signup') then wrong end as num_errors,
           case when event_type not in ('view', 'signup') then top end as max_risk
    from (select z.* exclude (user_id), e.user_id from z join events e using (event_id))""", "event_day_steps"))
def q_stream_lifecycle(spark, sf_dir):
    """Each event is a step of its user's chain of the day and a command behind it; a look at the day before finds no live chain."""
    ev = S.events_stream(spark, sf_dir)
    steps = S.step_events(ev.df, keep=("event_type",))
    command = F.element_at(F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv]), F.col("event_type"))
    asked = steps.withColumn("command", command).withColumn("target", F.col("chain_id") - F.when(F.col("event_type") == "view", 1).otherwise(0))
    return S.run_to_table(S.chain_commands(asked), "lifecycle", flush=ev.flush).filter(F.col("user_id") != S.SENTINEL_USER)


@register("stream_memory", "R20", with_views("""
    select conv_id, turn, step_idx, 'entity' as kind, name as key, current_value, previous_value, previous_turn from ent_conf
    union all
    select conv_id, turn, step_idx, 'claim', subject || '|' || predicate, current_value, previous_value, previous_turn
    from claim_conf""", "ent_conf", "claim_conf"))
def q_stream_memory(spark, sf_dir):
    # stand-in for the turns' event time: conversations start an hour apart, turns a minute apart
    conv = S.conversations_stream(spark, sf_dir).df
    ts = (F.lit(1_700_000_000) + F.col("conv_id") * 3600 + F.col("turn") * 60).cast("timestamp")
    steps = mention_lines(conv.withColumn("ts", ts), "ts")
    return S.run_to_table(S.memory_conflicts(S.mention_stream(steps)), "memory")


@register("session_counters", "R21", """
    select count(*) as total_queries, count(*) filter (where round(least(value / 100, 1.0), 6) >= 0.3) as total_interventions,
           count(distinct user_id) as active_sessions,
           cast(floor(epoch(max(ts))) as bigint) - cast(floor(epoch(min(ts))) as bigint) as uptime_seconds
    from events""")
def q_session_counters(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.session_counters(S.step_events(ev))


@register("prior_turn", "R22", """
    select conv_id, turn, lag(turn) over w as prior_turn, lag(role) over w as prior_role
    from conversations window w as (partition by conv_id order by turn)""")
def q_prior_turn(spark, sf_dir):
    return S.prior_turn(table(spark, sf_dir, "conversations"))

