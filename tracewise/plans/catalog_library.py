"""Listings, look-ups, logs, preference pairs, file sinks, feature vectors and
the classifier's surface, on the given tables (V6, V7, R12, P11-P13, IO2, IO4,
IO5, IO7, IO8, IO12-IO14, F7, F9, F10, F12, F13, F15, G8)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewise.functions.common import strip_ws
from tracewise.operators import classify, convert, risk, validate
from tracewise.operators import fingerprint as fpm
from tracewise.operators import graph as G
from tracewise.plans.catalog_convert import math_raw
from tracewise.plans.catalog_graph import _nodes
from tracewise.plans.catalog_risk import _IV_SQL, _day_steps
from tracewise.plans.catalog_text import _fp_sql
from tracewise.plans.registry import ORACLES, QUERIES, register
from tracewise.plans.shared import fingerprints
from tracewise.session import checkpoint_dir, cut_lineage
from tracewise.sources import io
from tracewise.sources.fixtures import doc_steps, order_chains, order_edges, order_steps, with_views
from tracewise.sources.tables import table

_QUERY = "Which parts does order "


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


@register("chain_listing", "V6", with_views(f"""
    select c.chain_id, c.domain, '{_QUERY}' || cast(c.chain_id as varchar) || ' hold?' as query, count(s.idx) as num_steps,
           count(*) filter (where not s.is_correct) > 0 as has_errors, count(*) filter (where not s.is_correct) as error_count
    from order_chains c left join order_steps s using (chain_id) group by c.chain_id, c.domain""", "order_chains", "order_steps"))
def q_chain_listing(spark, sf_dir):
    chains = order_chains(spark, sf_dir).withColumn("query", F.concat(F.lit(_QUERY), F.col("chain_id").cast("string"), F.lit(" hold?")))
    return validate.chain_listing(order_steps(spark, sf_dir), chains)


@register("chain_lookup", "V7", with_views("select chain_id, domain from order_chains where chain_id = 7", "order_chains"))
def q_chain_lookup(spark, sf_dir):
    return validate.lookup_chain(order_chains(spark, sf_dir), 7).select("chain_id", "domain")


@register("intervention_history", "R12", with_views(f"""
    with {_IV_SQL} select * from iv where chain_id = (select min(chain_id) from iv)""", "event_day_steps"))
def q_intervention_history(spark, sf_dir):
    iv = risk.interventions(_day_steps(spark, sf_dir))
    return risk.intervention_history(iv, iv.agg(F.min("chain_id")).first()[0])


# --- inference logs: every assistant turn is one model call --------------------------

_LOG_SQL = """
    log as (select 'model_' || cast(conv_id % 3 as varchar) as model_type,
                   'conv ' || cast(conv_id as varchar) || ' turn ' || cast(turn as varchar) as query,
                   ((conv_id * 13 + turn * 7) % 50) / 10.0::double as latency, conv_id, turn,
                   (conv_id + turn) % 9 = 0 as failed from conversations where role = 'assistant')"""


def _log(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    lines = F.filter(F.transform(F.split("text", "\n"), strip_ws), lambda s: s != "")
    return c.select(
        F.concat(F.lit("model_"), (F.col("conv_id") % 3).cast("string")).alias("model_type"),
        F.concat(F.lit("conv "), F.col("conv_id").cast("string"), F.lit(" turn "), F.col("turn").cast("string")).alias("query"),
        F.col("text").alias("response"), lines.alias("reasoning_steps"),
        (F.pmod(F.col("conv_id") * 13 + F.col("turn") * 7, F.lit(50)) / 10.0).alias("latency"),
        F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, "timeout").alias("error"))


@register("inference_chains", "P11", with_views(f"""
    with {_LOG_SQL}
    select l.query || '_' || l.model_type as chain_id, t.step_idx as idx, t.text, l.query
    from log l join turn_steps t on t.conv_id = l.conv_id and t.turn = l.turn where not l.failed""", "turn_steps"))
def q_inference_chains(spark, sf_dir):
    ch = convert.inference_log_to_chains(_log(spark, sf_dir))
    steps = F.transform("reasoning_steps", lambda s, i: F.struct(i.cast("long").alias("idx"), s["text"].alias("text")))
    return ch.select(F.col("query_id").alias("chain_id"), "query", F.inline(steps)).select("chain_id", "idx", "text", "query")


@register("inference_metrics", "P12", with_views(f"""
    with {_LOG_SQL},
    n as (select conv_id, turn, count(*) as n from turn_steps group by 1, 2)
    select model_type, count(*) as calls, count(*) filter (where failed) as errors, round(avg(latency), 6) as avg_latency,
           quantile_disc(latency, 0.5) as p50_latency, quantile_disc(latency, 0.95) as p95_latency,
           round(avg(coalesce(n.n, 0)), 6) as avg_steps
    from log left join n using (conv_id, turn) group by model_type""", "turn_steps"))
def q_inference_metrics(spark, sf_dir):
    return convert.inference_log_metrics(_log(spark, sf_dir))


@register("fenced_json", "P13", with_views("""
    select conv_id, turn, step_idx as idx, text from turn_steps where role = 'assistant' and turn % 4 <> 3""", "turn_steps"))
def q_fenced_json(spark, sf_dir):
    """The assistants' texts as a model would answer with them: a list of steps in a json fence or a bare one, or cut off (no valid JSON)."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    lines = F.filter(F.transform(F.split("text", "\n"), strip_ws), lambda s: s != "")
    body = F.to_json(F.transform(lines, lambda s, i: F.create_map(F.when(i % 2 == 0, "text").otherwise("step"), s)))
    reply = (F.when(F.col("turn") % 4 == 3, F.concat(F.lit("```json\n"), F.expr("text"), F.lit(" [{\n```")))
             .when(F.col("turn") % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone.")))
             .otherwise(F.concat(F.lit("```\n"), body, F.lit("\n```"))))
    return c.select("conv_id", "turn", F.posexplode(convert.fenced_json_steps(reply)).alias("idx", "text")).filter(
        F.col("text").isNotNull()).select("conv_id", "turn", F.col("idx").cast("long").alias("idx"), "text")


# --- preference pairs ----------------------------------------------------------------

_MODELS = ("gpt-4-0613", "claude-v1", "vicuna-13b")
_MODELS_SQL = "['" + "', '".join(_MODELS) + "']"


def _pairs(spark, sf_dir):
    """Each turn of an even number and the one behind it as the sides of a pair."""
    c = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.col("conv_id") * 1000 + F.floor(F.col("turn") / 2)).alias("pair_id"), F.array(F.struct("role", F.col("text").alias("content"))).alias("said"))
    name = lambda k: F.element_at(F.array(*[F.lit(m) for m in _MODELS]), ((F.col("conv_id") + k) % 3 + 1).cast("int"))
    a, b = (c.filter(F.col("turn") % 2 == t).select("conv_id", "pair_id", F.col("said").alias(n)) for t, n in ((0, "chosen"), (1, "rejected")))
    return a.join(b, ["conv_id", "pair_id"]).select("pair_id", name(0).alias("chosen_model"), "chosen", name(1).alias("rejected_model"), "rejected")


_PAIRS_SQL = """select a.conv_id as k, a.conv_id * 1000 + a.turn // 2 as pair_id, a.text as ta, b.text as tb
               from conversations a join conversations b on a.conv_id = b.conv_id and a.turn % 2 = 0 and b.turn = a.turn + 1"""


@register("preference_pairs", "IO13", f"""
    with p as ({_PAIRS_SQL}),
    s as (select pair_id, 0 as side, {_MODELS_SQL}[k % 3 + 1] as model_name, ta as content from p
          union all select pair_id, 1, {_MODELS_SQL}[(k + 1) % 3 + 1], tb from p)
    select pair_id, side, model_name, case when contains(model_name, 'gpt-4') then 'gpt4' else 'claude' end as model_type, content
    from s where not contains(model_name, 'vicuna')""")
def q_preference_pairs(spark, sf_dir):
    out = io.preference_pairs(_pairs(spark, sf_dir), [("gpt-4", "gpt4"), ("claude", "claude")])
    return out.select("pair_id", "side", "model_name", "model_type", F.col("conversation")[0]["content"].alias("content"))


@register("distinct_models", "IO14", f"""
    with p as ({_PAIRS_SQL})
    select distinct model from (select {_MODELS_SQL}[k % 3 + 1] as model from p union all select {_MODELS_SQL}[(k + 1) % 3 + 1] from p)""")
def q_distinct_models(spark, sf_dir):
    return io.distinct_models(_pairs(spark, sf_dir), "chosen_model", "rejected_model")


# --- reads and sinks -----------------------------------------------------------------

@register("read_capped", "IO2", "select o_orderkey, o_custkey from orders order by o_orderkey limit 100")
def q_read_capped(spark, sf_dir):
    return io.read_capped(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 100, ["o_orderkey"])


@register("read_dataset", "IO4", with_views("select chain_id, domain from order_chains where chain_id % 10 < 7", "order_chains"))
def q_read_dataset(spark, sf_dir):
    path = _scratch(spark, "dataset")
    split = F.when(F.col("chain_id") % 10 < 7, "train").otherwise("test")
    order_chains(spark, sf_dir).withColumn("split", split).write.partitionBy("split").parquet(path)
    return io.read_dataset(spark, path).select("chain_id", "domain")


FILES = 4  # parts of a model at least
FILE_CHAINS = 50_000  # chains of a part, about, where that asks for more
MODELS = 4


@register("chain_files", "IO5 IO7 IO12", with_views("""
    with o as (select distinct chain_id, first_supp from order_base)
    select 'model' || cast(first_supp % 4 as varchar) as model_type, 'math' as file_domain, count(*) as total,
           count(*) filter (where chain_id % 89 <> 0) as valid, count(*) filter (where chain_id % 89 = 0) as invalid
    from o group by 1""", "order_base"))
def q_chain_files(spark, sf_dir):
    """Several JSONL files a model, gzipped and named ``{model}_{domain}_chains-NNNNN.jsonl.gz``: every task writes one for each model that
    its chains have; every 89th chain has a domain that the schema lacks."""
    # as many parts as keep a task's share the same, however many chains there are
    files = max(FILES, -(-table(spark, sf_dir, "orders").count() // (MODELS * FILE_CHAINS)))
    # the lines are dealt out once, by order; the chains are built and written where their lines are
    chains = convert.convert_math(math_raw(spark, sf_dir, files, ["first_supp"]), keep=["first_supp"]).filter(F.col("query_id").isNotNull())
    chains = chains.withColumn("model", F.concat(F.lit("model"), (F.col("first_supp") % 4).cast("string"))).drop("first_supp")
    chains = chains.withColumn("domain", F.when(F.col("query_id").cast("long") % 89 == 0, "poetry").otherwise(F.col("domain")))
    path = _scratch(spark, "chains")
    io.write_chains_jsonl(chains, path, compression="gzip", partition_by=["model"])
    io.name_files(spark, path, "model", "{}_math_chains-{:05d}.jsonl.gz")
    keyed = io.key_from_file_name(io.read_chains(spark, f"{path}/*.jsonl.gz"))
    stats = io.key_from_file_name(io.file_stats(keyed))
    return stats.groupBy("model_type", "file_domain").agg(*[F.sum(c).alias(c) for c in ("total", "valid", "invalid")])


@register("report_sink", "IO8", ORACLES["error_rate_by_model_domain"])
def q_report_sink(spark, sf_dir):
    report, path = QUERIES["error_rate_by_model_domain"](spark, sf_dir), _scratch(spark, "report")
    io.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


# --- vectors -------------------------------------------------------------------------

_F24 = fpm.FEATURE_NAMES


@register("feature_vector", "F7", f"""
    select chain_id, {', '.join(f'coalesce(cast({c} as double), 0.0) as f{k}' for k, c in enumerate(_F24))} from ({_fp_sql(_F24)})""")
def q_feature_vector(spark, sf_dir):
    v = fpm.feature_vector(fingerprints(spark, sf_dir))
    return v.select("chain_id", *[F.col("features")[k].alias(f"f{k}") for k in range(len(_F24))])


_TASK = ["is_math", "is_code", "is_medical", "depth", "position", "factual_density"]


@register("node_features", "G8", f"""
    select t.chain_id, t.idx, t.in_deg::double as f0, t.out_deg::double as f1, t.clustering::double as f2, s.path_length::double as f3,
           b.betweenness::double as f4, {', '.join(f't.{c}::double as f{k + 5}' for k, c in enumerate(_TASK))}
    from ({ORACLES['topology_basic']}) t join ({ORACLES['shortest_path']}) s on s.chain_id = t.chain_id and s.node = t.idx
    join ({ORACLES['betweenness']}) b on b.chain_id = t.chain_id and b.node = t.idx""")
def q_node_features(spark, sf_dir):
    s = order_steps(spark, sf_dir)
    top = cut_lineage(G.topology(_nodes(s), order_edges(s)))  # all five measures and the chain's depth at once
    blocks = [(top.withColumnRenamed("node", "idx"), ["in_deg", "out_deg", "clustering", "path_length", "betweenness"]),
              (G.task_features(s, top), _TASK)]
    f = G.assemble_features([b for b, _ in blocks], [c for _, c in blocks])
    return f.select("chain_id", "idx", *[F.col("features")[k].alias(f"f{k}") for k in range(5 + len(_TASK))])


@register("feature_cache", "IO10", f"select chain_id, vocab_richness, num_steps from ({_fp_sql(['vocab_richness', 'num_steps'])})")
def q_feature_cache(spark, sf_dir):
    """The fingerprint table built into the cache, and read from it the second time."""
    path = _scratch(spark, "features")
    build = lambda: fpm.fingerprint(doc_steps(spark, sf_dir)).select("chain_id", "vocab_richness", "num_steps")
    io.cached(spark, path, build)

    def never():
        raise AssertionError("the cache was not used")

    return io.cached(spark, path, never)


@register("chain_text", "F1", with_views("select chain_id, string_agg(text, ' ' order by idx) as text from doc_steps group by chain_id", "doc_steps"))
def q_chain_text(spark, sf_dir):
    return fpm.concat_steps(doc_steps(spark, sf_dir))


# --- the classifier's surface ---------------------------------------------------------

def _languages(spark, sf_dir):
    fp = fingerprints(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chain_id"), "lang")
    return classify.train_test(fp.join(docs, "chain_id"), "lang")


@register("classifier_report", "F9 F10 F12")
def q_classifier_report(spark, sf_dir):
    """Rows-only: 5-fold cross-validated accuracy, the ten most important
    features and the confusion counts on the test rows."""
    train, test = _languages(spark, sf_dir)
    model = classify.fit(train, cv_folds=5)
    row = lambda d, kind, a, b, v: d.select(F.lit(kind).alias("section"), a.alias("name"), b.alias("other"), v.cast("double").alias("value"))
    none = F.lit(None).cast("string")
    accuracy = spark.range(1).select(F.lit("accuracy").alias("section"), F.lit("5-fold").alias("name"), none.alias("other"), F.lit(float(model.avgMetrics[0])).alias("value"))
    confusion = classify.confusion_matrix(classify.predict(model, test))
    return accuracy.unionByName(row(classify.feature_importance(model), "importance", F.col("feature"), none, F.col("importance"))).unionByName(
        row(confusion, "confusion", F.col("label_name"), F.col("predicted"), F.col("n")))


@register("classifier_verdict", "F13 F15")
def q_classifier_verdict(spark, sf_dir):
    """Rows-only: the model saved, loaded again, and its verdict on the test rows."""
    train, test = _languages(spark, sf_dir)
    path = _scratch(spark, "model")
    classify.save_model(classify.fit(train), path)
    model = classify.load_model(path)
    shown = spark.createDataFrame([("en", "English"), ("fr", "French"), ("de", "German")], "label_name string, display string")
    return classify.verdict(classify.predict(model, test), model.stages[0].labels, shown)


@register("label_index", "F8", "select lang as label_name, cast(row_number() over (order by lang) - 1 as double) as label from (select distinct lang from documents)")
def q_label_index(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("label_name"))
    return classify.pipeline().getStages()[0].fit(d).transform(d).distinct()


@register("multiclass_metrics", "F10", """
    with p as (select lang as t, case when doc_id % 5 = 0 then 'en' when doc_id % 7 = 0 then 'fr' else lang end as p from documents),
    cls as (select t as cls from p union select p from p),
    c as (select cls, (select count(*) from p where t = cls) as support, (select count(*) from p where p.p = cls) as pn,
                 (select count(*) from p where t = cls and p.p = cls) as tp from cls),
    m as (select cls, support, round(coalesce(tp / nullif(pn, 0), 0), 6) + 0.0 as precision, round(coalesce(tp / nullif(support, 0), 0), 6) + 0.0 as recall,
                 round(coalesce(2 * (tp / nullif(pn, 0)) * (tp / nullif(support, 0)) / nullif(tp / nullif(pn, 0) + tp / nullif(support, 0), 0), 0), 6) + 0.0 as f1, tp
          from c)
    select cls, precision, recall, f1, support from m
    union all select 'accuracy', a, a, a, n from (select round(sum(tp) / sum(support), 6) + 0.0 as a, cast(sum(support) as bigint) as n from m)
    union all select 'macro avg', round(avg(precision), 6) + 0.0, round(avg(recall), 6) + 0.0, round(avg(f1), 6) + 0.0, cast(sum(support) as bigint) from m
    union all select 'weighted avg', round(sum(precision * support) / sum(support), 6) + 0.0, round(sum(recall * support) / sum(support), 6) + 0.0,
                     round(sum(f1 * support) / sum(support), 6) + 0.0, cast(sum(support) as bigint) from m""")
def q_multiclass_metrics(spark, sf_dir):
    # predictions by arithmetic on the id: the metrics are what is checked
    d = table(spark, sf_dir, "documents")
    guess = F.when(F.col("doc_id") % 5 == 0, "en").when(F.col("doc_id") % 7 == 0, "fr").otherwise(F.col("lang"))
    return classify.multiclass_metrics(d.select(F.col("lang").alias("label_name"), guess.alias("predicted")))
