"""Rule lookups (L1–L4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewise.operators import lookup
from tracewise.plans.registry import register
from tracewise.sources.fixtures import doc_steps, order_scores, with_views
from tracewise.sources.tables import table

_OR = lambda col, words: " or ".join(f"contains({col}, '{w}')" for w in words)


@register("safety_explanation", "L1", with_views("""
    select chain_id, idx, case when node_prob > 0.6 then 'SAFE' else 'UNSAFE' end as status,
           cast(floor(abs(node_prob - 0.5) * 2 * 10000 + 0.5)::bigint // 100 as varchar) || '.'
             || lpad(cast(floor(abs(node_prob - 0.5) * 2 * 10000 + 0.5)::bigint % 100 as varchar), 2, '0') || '%' as confidence,
           case when node_prob > 0.6 then 'This query complies with safety guidelines.'
                else 'This query was flagged as potentially harmful.' end as reason
    from order_scores""", "order_scores"))
def q_safety_explanation(spark, sf_dir):
    return lookup.safety_explanation(order_scores(spark, sf_dir), "node_prob").select(
        "chain_id", "idx", "status", "confidence", "reason")


@register("allow_rule", "L2", with_views(f"""
    select chain_id, bool_or({_OR('lower(text)', lookup.ALLOW_PHRASES)}) as allowed from doc_steps group by chain_id""",
                                         "doc_steps"))
def q_allow_rule(spark, sf_dir):
    return lookup.allow_rule(doc_steps(spark, sf_dir))


@register("step_status", "L4", with_views(f"""
    select chain_id, idx, case when {_OR('lower(text)', lookup.SAFE_WORDS)} then 'safe'
                               when {_OR('lower(text)', lookup.RISK_WORDS)} then 'risk' else 'neutral' end as status
    from doc_steps""", "doc_steps"))
def q_step_status(spark, sf_dir):
    return lookup.step_status(doc_steps(spark, sf_dir)).select("chain_id", "idx", "status")


@register("context_lookup", "L3", """
    with q as (select conv_id || '_' || turn as qid, text from conversations where role = 'user'),
    h as (select qid, case when contains(text, 'sqrt') or contains(text, '-16') then 0
                           when contains(text, 'delete') then 1 end as r from q)
    select qid, case r when 0 then 'sqrt' when 1 then 'delete' else '' end as matched from h""")
def q_context_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user").select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"),
        F.col("text").alias("query"))
    out = lookup.context_lookup(c, lookup.CONTEXT_RULES)
    return out.select("qid", F.when(F.col("context") == "", "").when(F.col("context").contains("square root"), "sqrt")
                      .otherwise("delete").alias("matched"))


def _prompt_sql() -> str:
    from tracewise.operators.prompts import SYSTEM_PROMPTS, TASK_PROMPTS

    def q(s):
        return "'" + s.replace("'", "''") + "'"
    vals = ", ".join(f"({q(d)}, {q(SYSTEM_PROMPTS[d])}, {q(TASK_PROMPTS[d])})" for d in SYSTEM_PROMPTS)
    return f"""
    with t(domain, sp, tp) as (values {vals}),
    u as (select conv_id || '_' || turn as qid, text as query,
                 case conv_id % 3 when 0 then 'math' when 1 then 'code' else 'medical' end as domain
          from conversations where role = 'user'),
    r as (select qid, sp, replace(tp, '{{query}}', query) as task from u join t using (domain))
    select qid, 'openai' as style, sp as system, task as "user" from r
    union all select qid, 'google', '', sp || chr(10) || chr(10) || task from r
    union all select qid, 'instruct', '', '<|system|>' || chr(10) || sp || chr(10) || '<|user|>' || chr(10) || task
                                         || chr(10) || '<|assistant|>' || chr(10) from r"""


@register("prompt_rendering", "P1", _prompt_sql())
def q_prompt_rendering(spark, sf_dir):
    from tracewise.operators import prompts

    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user").select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"),
        F.col("text").alias("query"),
        F.when(F.col("conv_id") % 3 == 0, "math").when(F.col("conv_id") % 3 == 1, "code").otherwise("medical").alias("domain"))
    t = prompts.template_table(spark)
    out = None
    for style in prompts.STYLES:
        r = prompts.render(c, t, style).select("qid", F.lit(style).alias("style"), "system", "user")
        out = r if out is None else out.unionByName(r)
    return out
