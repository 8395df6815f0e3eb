"""Text fingerprint queries (F1–F7, F14, F16) over ``doc_steps``.

Oracles concatenate each chain's text in SQL and apply the reference's
formulas to the joined text literally, so they check the per-step
decomposition used on the Spark side independently.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewise.functions.common import PY_NON_WS, PY_WS
from tracewise.operators import fingerprint as fpm
from tracewise.plans.registry import register
from tracewise.plans.shared import fingerprints
from tracewise.sources.fixtures import SQL_VIEWS, doc_steps, with_views
from tracewise.sources.tables import table


def _cnt(col: str, markers: list[str]) -> str:
    parts = [f"(length({col}) - length(replace({col}, '{m.replace(chr(39), chr(39) * 2)}', ''))) // {len(m)}"
             for m in markers]
    return "(" + " + ".join(parts) + ")"


SQL_VIEWS.update({
    "fp_text": (("doc_steps",), f"""
        select chain_id, string_agg(text, ' ' order by idx) as tx, count(*) as n,
               avg(nw) as avg_step_length, stddev_pop(nw) as std_step_length,
               avg(case when idx > 0 then 1 else 0 end) as avg_dependencies,
               sum(regexp_matches(st, '^\\p{{Nd}}+\\.?{PY_WS}')::int) as numbered,
               sum(regexp_matches(st, '^[-*•]{PY_WS}')::int) as bullet,
               sum({_cnt('text', ['```'])} + {_cnt('text', ['`'])}) as code,
               sum({_cnt('text', ['$', '=', '+', '*'])}) as math
        from (select *, len(list_filter(regexp_split_to_array(lower(text), '{PY_WS}+'), lambda x: x <> '')) as nw,
                     regexp_replace(text, '^{PY_WS}+|{PY_WS}+$', '', 'g') as st
              from doc_steps)
        group by chain_id"""),
    "fp_all": (("fp_text",), f"""
        select chain_id, n, tx, lower(tx) as lt, length(tx) as tl, avg_step_length, std_step_length, avg_dependencies,
               numbered, bullet, code, math,
               list_filter(regexp_split_to_array(lower(tx), '{PY_WS}+'), lambda x: x <> '') as ws,
               len(list_filter(regexp_split_to_array(tx, '[.!?]+'), lambda x: regexp_matches(x, '{PY_NON_WS}'))) as ns
        from fp_text"""),
    "fp": (("fp_all",), f"""
        select chain_id,
               round(coalesce(len(list_distinct(ws)) / nullif(len(ws), 0), 0), 6) + 0.0 as vocab_richness,
               round(coalesce(list_sum(list_transform(ws, lambda x: length(x))) / nullif(len(ws), 0), 0), 6) + 0.0 as avg_word_length,
               round(coalesce(len(ws) / nullif(ns, 0), 0), 6) + 0.0 as avg_words_per_sentence,
               round(coalesce(len(list_filter(ws, lambda x: length(x) > 8)) / nullif(len(ws), 0), 0), 6) + 0.0 as technical_density,
               round(coalesce(len(regexp_extract_all(tx, '[,;:!?]')) / nullif(tl, 0), 0), 6) + 0.0 as punctuation_density,
               cast(len(ws) as bigint) as total_words, cast(ns as bigint) as total_sentences,
               n as num_steps, round(avg_step_length, 6) + 0.0 as avg_step_length,
               round(coalesce(std_step_length, 0), 6) + 0.0 as std_step_length,
               round(avg_dependencies, 6) + 0.0 as avg_dependencies, n as graph_depth, 0.0::double as branching_factor,
               round(len(ws) / n, 6) + 0.0 as verbosity,
               round(coalesce({_cnt('lt', fpm.EXPLANATION_MARKERS)} / nullif(tl, 0), 0), 6) + 0.0 as explanation_density,
               round({_cnt('tx', ['?'])} / n, 6) + 0.0 as question_density,
               round(coalesce({_cnt('lt', fpm.FIRST_PERSON)} / nullif(len(ws), 0), 0), 6) + 0.0 as first_person_density,
               round(coalesce({_cnt('lt', fpm.PASSIVE_MARKERS)} / nullif(len(ws), 0), 0), 6) + 0.0 as passive_density,
               coalesce({_cnt('lt', fpm.HEDGE_WORDS)} / nullif(len(ws), 0), 0) as h,
               coalesce({_cnt('lt', fpm.CONFIDENCE_HIGH)} / nullif(len(ws), 0), 0) as hi,
               coalesce({_cnt('lt', fpm.CONFIDENCE_LOW)} / nullif(len(ws), 0), 0) as lo,
               round(numbered / n, 6) + 0.0 as numbered_ratio, round(bullet / n, 6) + 0.0 as bullet_ratio,
               round(code / n, 6) + 0.0 as code_density, round(math / n, 6) + 0.0 as math_density
        from fp_all"""),
})

_GROUPS = {
    "fingerprint_linguistic": ("F2", ["vocab_richness", "avg_word_length", "avg_words_per_sentence", "technical_density",
                                         "punctuation_density", "total_words", "total_sentences"]),
    "fingerprint_structural": ("F3", ["num_steps", "avg_step_length", "std_step_length", "avg_dependencies", "graph_depth",
                                      "branching_factor"]),
    "fingerprint_stylistic": ("F4", ["verbosity", "explanation_density", "question_density", "first_person_density",
                                     "passive_density"]),
    "fingerprint_confidence": ("F5", ["hedge_density", "high_confidence_density", "low_confidence_density", "certainty_score"]),
    "fingerprint_formatting": ("F6", ["numbered_ratio", "bullet_ratio", "code_density", "math_density"]),
}


def _fp_sql(cols: list[str]) -> str:
    exprs = []
    for c in cols:
        if c == "hedge_density":
            exprs.append("round(h, 6) + 0.0 as hedge_density")
        elif c == "high_confidence_density":
            exprs.append("round(hi, 6) + 0.0 as high_confidence_density")
        elif c == "low_confidence_density":
            exprs.append("round(lo, 6) + 0.0 as low_confidence_density")
        elif c == "certainty_score":
            exprs.append("round(hi - h - lo, 6) + 0.0 as certainty_score")
        else:
            exprs.append(c)
    return with_views(f"select chain_id, {', '.join(exprs)} from fp", "fp")


def _make(key: str, ops: str, cols: list[str]):
    @register(key, ops, _fp_sql(cols))
    def q(spark, sf_dir):
        return fingerprints(spark, sf_dir).select("chain_id", *cols)
    return q


for _k, (_ops, _cols) in _GROUPS.items():
    _make(_k, _ops, _cols)


@register("signature", "F14", with_views("""
    select chain_id, round(0.5 + round(hi - h - lo, 6) * 0.4, 2) as propagation, num_steps as depth,
           case when branching_factor > 0.1 then 'Branching' when technical_density > 0.3 then 'Exponential' else 'Linear' end
               as pattern,
           round(round(hi - h - lo, 6), 2) as certainty, round(vocab_richness, 2) as richness
    from fp""", "fp"))
def q_signature(spark, sf_dir):
    return fpm.signature(fingerprints(spark, sf_dir))


@register("step_certainty", "F16", with_views(f"""
    with s as (select d.chain_id, d.idx, lower(d.text) as lt,
                      len(list_filter(regexp_split_to_array(lower(d.text), '{PY_WS}+'), lambda x: x <> '')) as nw,
                      coalesce(l.quality = 1, true) as clean,
                      idx = max(idx) over (partition by d.chain_id) as is_last
               from doc_steps d left join labels l on l.doc_id = d.chain_id),
    c as (select chain_id, idx, clean, is_last,
                 least(0.99, greatest(0.1, 1.0 - coalesce({_cnt('lt', fpm.HEDGE_WORDS)} / nullif(nw, 0), 0) * 5.0)) as conf from s)
    select chain_id, idx, round(case when is_last and not clean then least(conf, 0.45) else conf end, 6) + 0.0 as certainty
    from c""", "doc_steps"))
def q_step_certainty(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chain_id"), (F.col("quality") == 1).alias("clean"))
    return fpm.step_certainty(doc_steps(spark, sf_dir), lab)


@register("source_classifier", "F8 F9 F10 F11")
def q_source_classifier(spark, sf_dir):
    """Rows-only: random-forest quality numbers (per-class P/R/F1, accuracy,
    macro / weighted averages) of predicting a document's language from its
    fingerprint, on a stratified 80/20 hash split."""
    from tracewise.operators import classify

    fp = fingerprints(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chain_id"), "lang")
    train, test = classify.train_test(fp.join(docs, "chain_id"), "lang")
    model = classify.fit(train)
    return classify.multiclass_metrics(classify.predict(model, test))
