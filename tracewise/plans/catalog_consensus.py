"""Consensus (M1–M11) and evaluation (D1–D13, X7, X8) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewise.functions.common import r6
from tracewise.operators import compare, consensus, evaluate
from tracewise.plans.registry import register
from tracewise.sources.fixtures import (order_model_scores, order_scores, order_steps, order_votes,
                                        with_views)

# The reference demo's model weights (1.5 / 1.0; others default 1.0).
WEIGHTS = [("a", 1.5), ("b", 1.0)]
# Labeller -> home domain, and domain -> routed model.
HOME = [("a", "math"), ("b", "code"), ("c", "medical")]


def _weights(spark):
    return spark.createDataFrame(WEIGHTS, "model_type string, weight double")


def _rounded(step_votes):
    return step_votes.withColumn("agreement", r6("agreement"))


_W_SQL = "w(model_type, weight) as (values ('a', 1.5::double), ('b', 1.0::double))"


@register("vote_majority", "M2 M7", with_views("""
    select chain_id, idx, sum(pred::int) > count(*) - sum(pred::int) as pred,
           round(greatest(sum(pred::int), count(*) - sum(pred::int)) / count(*), 6) + 0.0 as agreement
    from order_votes group by chain_id, idx""", "order_votes"))
def q_vote_majority(spark, sf_dir):
    return _rounded(consensus.majority_vote(order_votes(spark, sf_dir)))


@register("vote_weighted", "M3", with_views(f"""
    with {_W_SQL},
    g as (select chain_id, idx, sum(case when pred then coalesce(w.weight, 1.0) else 0 end) as cw,
                 sum(case when pred then 0 else coalesce(w.weight, 1.0) end) as ew
          from order_votes v left join w using (model_type) group by chain_id, idx)
    select chain_id, idx, cw > ew as pred, round(greatest(cw, ew) / (cw + ew), 6) + 0.0 as agreement from g""",
                                      "order_votes"))
def q_vote_weighted(spark, sf_dir):
    return _rounded(consensus.weighted_vote(order_votes(spark, sf_dir), _weights(spark)))


@register("vote_unanimous", "M4", with_views("""
    with g as (select chain_id, idx, sum(pred::int) as c, count(*) as n from order_votes group by chain_id, idx)
    select chain_id, idx, c = n as pred,
           round(case when c = n or c = 0 then 1.0 else greatest(c, n - c) / n end, 6) + 0.0 as agreement
    from g""", "order_votes"))
def q_vote_unanimous(spark, sf_dir):
    return _rounded(consensus.unanimous_vote(order_votes(spark, sf_dir)))


@register("vote_expert", "M5", with_views(f"""
    with {_W_SQL},
    v as (select chain_id, idx, model_type, pred, coalesce(w.weight, 1.0) as weight
          from order_votes left join w using (model_type)),
    g as (select chain_id, idx, arg_min(pred, (-weight, model_type)) as ep, sum(pred::int) as c, count(*) as n
          from v group by chain_id, idx)
    select chain_id, idx, ep as pred, round((case when ep then c else n - c end) / n, 6) + 0.0 as agreement
    from g""", "order_votes"))
def q_vote_expert(spark, sf_dir):
    return _rounded(consensus.expert_vote(order_votes(spark, sf_dir), _weights(spark)))


_MAJ_SQL = """maj as (select chain_id, idx, sum(pred::int) > count(*) - sum(pred::int) as pred,
                     greatest(sum(pred::int), count(*) - sum(pred::int)) / count(*) as agreement
              from order_votes group by chain_id, idx)"""


@register("consensus_chain", "M6", with_views(f"""
    with {_MAJ_SQL}
    select chain_id, bool_and(agreement >= 0.8) as consensus_exists,
           round(avg(agreement), 6) + 0.0 as consensus_confidence, count(*) as num_steps,
           cast(sum((agreement < 0.8)::int) as bigint) as num_disagreements
    from maj group by chain_id""", "order_votes"))
def q_consensus_chain(spark, sf_dir):
    return consensus.chain_consensus(consensus.majority_vote(order_votes(spark, sf_dir)), threshold=0.8)


@register("disagreement_points", "M6 M9", with_views(f"""
    with {_MAJ_SQL}
    select chain_id, idx, round(agreement, 6) + 0.0 as agreement from maj where agreement < 0.8""", "order_votes"))
def q_disagreement_points(spark, sf_dir):
    return _rounded(consensus.disagreement_points(consensus.majority_vote(order_votes(spark, sf_dir)), 0.8))


@register("agreement_patterns", "M11", with_views(f"""
    with {_MAJ_SQL},
    pc as (select chain_id, min((agreement >= 0.8)::int) as cons from maj group by chain_id),
    a as (select count(*) as total_chains, cast(sum(cons) as bigint) as chains_with_consensus from pc),
    b as (select count(*) as total_steps, cast(sum((agreement < 0.8)::int) as bigint) as total_disagreements,
                 avg(agreement) as m, stddev_pop(agreement) as sd, min(agreement) as mn, max(agreement) as mx from maj)
    select total_chains, chains_with_consensus, round(chains_with_consensus / total_chains, 6) + 0.0 as consensus_rate,
           round(m, 6) + 0.0 as avg_agreement_rate, total_disagreements,
           round(total_disagreements / total_steps, 6) + 0.0 as disagreement_rate,
           round(sd, 6) + 0.0 as agreement_std, round(mn, 6) + 0.0 as agreement_min, round(mx, 6) + 0.0 as agreement_max
    from a, b""", "order_votes"))
def q_agreement_patterns(spark, sf_dir):
    return consensus.agreement_patterns(consensus.majority_vote(order_votes(spark, sf_dir)), threshold=0.8)


@register("combine_predictors", "M8", with_views(f"""
    with {_MAJ_SQL}
    select m.chain_id, m.idx,
           case when m.agreement * 0.7 + (1 - m.agreement) * 0.3 > 0.5 then m.pred else s.node_prob > 0.5 end as combined
    from maj m join order_scores s using (chain_id, idx)""", "order_votes", "order_scores"))
def q_combine_predictors(spark, sf_dir):
    other = order_scores(spark, sf_dir).select("chain_id", "idx", (F.col("node_prob") > 0.5).alias("other_pred"))
    return consensus.combine_predictors(consensus.majority_vote(order_votes(spark, sf_dir)), other, other_weight=0.3)[0]


@register("combine_rejects", "M8", with_views("""
    select chain_id, idx, case when chain_id % 11 = 5 and idx = 0 then 'no second prediction' else 'no consensus' end as reason
    from (select distinct chain_id, idx from order_votes) where (chain_id % 11 = 5 and idx = 0) <> (chain_id % 7 = 2 and idx = 1)""",
                                              "order_votes"))
def q_combine_rejects(spark, sf_dir):
    # defects planted by id: the second predictor lacks some first steps, the votes lack some second steps
    other = order_scores(spark, sf_dir).select("chain_id", "idx", (F.col("node_prob") > 0.5).alias("other_pred")).filter("not (chain_id % 11 = 5 and idx = 0)")
    votes = order_votes(spark, sf_dir).filter("not (chain_id % 7 = 2 and idx = 1)")
    return consensus.combine_predictors(consensus.majority_vote(votes), other)[1]


@register("disagreement_analysis", "M9", with_views(f"""
    with {_MAJ_SQL}
    select chain_id, sum((agreement < 0.8)::int) > 0 as has_disagreement,
           cast(sum((agreement < 0.8)::int) as bigint) as num_disagreements,
           round(sum((agreement < 0.8)::int) / count(*), 6) + 0.0 as disagreement_rate
    from maj group by chain_id""", "order_votes"))
def q_disagreement_analysis(spark, sf_dir):
    return consensus.disagreement_analysis(consensus.majority_vote(order_votes(spark, sf_dir)), threshold=0.8)


@register("disagreement_details", "M9", with_views(f"""
    with {_MAJ_SQL}
    select v.chain_id, v.idx, v.model_type, v.pred
    from order_votes v join maj m using (chain_id, idx) where m.agreement < 0.8""", "order_votes"))
def q_disagreement_details(spark, sf_dir):
    v = order_votes(spark, sf_dir)
    return consensus.disagreement_details(consensus.majority_vote(v), v, threshold=0.8)


@register("vote_input_check", "M1", with_views("""
    with v as (select * from order_votes where not (chain_id % 10 = 3 and model_type = 'c' and idx = 1)),
    pm as (select chain_id, model_type, count(*) as n from v group by chain_id, model_type)
    select chain_id, 'unequal prediction lengths' as reason from pm group by chain_id having min(n) <> max(n)""",
                                           "order_votes"))
def q_vote_input_check(spark, sf_dir):
    v = order_votes(spark, sf_dir)
    v = v.filter(~((F.col("chain_id") % 10 == 3) & (F.col("model_type") == "c") & (F.col("idx") == 1)))
    _, bad = consensus.check_inputs(v)
    return bad


@register("pair_chains", "M10", with_views("""
    with a as (select distinct chain_id from order_steps where model_type = 'model_0'),
         b as (select distinct chain_id from order_steps where model_type = 'model_1'),
         pa as (select chain_id, row_number() over (order by chain_id) - 1 as pos from a),
         pb as (select chain_id, row_number() over (order by chain_id) - 1 as pos from b)
    select pa.chain_id as chain_a, pb.chain_id as chain_b, pos from pa join pb using (pos)""", "order_steps"))
def q_pair_chains(spark, sf_dir):
    s = order_steps(spark, sf_dir)
    return consensus.pair_by_position(s.filter(F.col("model_type") == "model_0"),
                                      s.filter(F.col("model_type") == "model_1"))


@register("pair_by_query", "M10", with_views("""
    with s as (select distinct chain_id, model_type, 'query_' || cast(chain_id // 8 as varchar) as query_id from order_steps)
    select a.query_id, a.chain_id as chain_a, b.chain_id as chain_b
    from s a join s b on a.query_id = b.query_id and a.model_type = 'model_0' and b.model_type = 'model_1'""", "order_steps"))
def q_pair_by_query(spark, sf_dir):
    # stand-in for the query id that both models answered: neighbouring orders ask the same
    s = order_steps(spark, sf_dir).withColumn("query_id", F.concat(F.lit("query_"), F.floor(F.col("chain_id") / 8).cast("string")))
    return consensus.pair_by_query(s.filter(F.col("model_type") == "model_0"), s.filter(F.col("model_type") == "model_1"))


# --- evaluation ---------------------------------------------------------------

def _scores(spark, sf_dir):
    return order_scores(spark, sf_dir).withColumnRenamed("node_prob", "score")


@register("binary_metrics", "D1 D2", with_views("""
    with c as (select domain, cast(sum((node_prob > 0.5 and y = 1)::int) as bigint) as tp,
                      cast(sum((node_prob > 0.5 and y <> 1)::int) as bigint) as fp,
                      cast(sum((node_prob <= 0.5 and y <> 1)::int) as bigint) as tn,
                      cast(sum((node_prob <= 0.5 and y = 1)::int) as bigint) as fn
               from order_scores group by domain),
    m as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r from c)
    select domain, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) + 0.0 as accuracy,
           round(p, 6) + 0.0 as precision, round(r, 6) + 0.0 as recall,
           round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) + 0.0 as f1,
           case when tp + fn > 0 and tn + fp > 0 then round(coalesce(tn / nullif(tn + fp, 0), 0), 6) + 0.0 end as specificity,
           case when tp + fn > 0 and tn + fp > 0 then round(coalesce(tn / nullif(tn + fn, 0), 0), 6) + 0.0 end as npv
    from m""", "order_scores"))
def q_binary_metrics(spark, sf_dir):
    return evaluate.binary_metrics(_scores(spark, sf_dir), ["domain"])


@register("origin_metrics", "D6", with_views("""
    with o as (select domain, y_origin = 1 as y, origin_prob > case domain when 'math' then 0.5 when 'code' then 0.3 else 0.25 end as p from order_scores),
    c as (select domain, cast(sum((p and y)::int) as bigint) as tp, cast(sum((p and not y)::int) as bigint) as fp,
                 cast(sum((not p and not y)::int) as bigint) as tn, cast(sum((not p and y)::int) as bigint) as fn from o group by domain),
    m as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as pr, coalesce(tp / nullif(tp + fn, 0), 0) as r from c)
    select domain, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) + 0.0 as accuracy,
           round(pr, 6) + 0.0 as precision, round(r, 6) + 0.0 as recall,
           round(coalesce(2 * pr * r / nullif(pr + r, 0), 0), 6) + 0.0 as f1,
           case when tp + fn > 0 and tn + fp > 0 then round(coalesce(tn / nullif(tn + fp, 0), 0), 6) + 0.0 end as specificity,
           case when tp + fn > 0 and tn + fp > 0 then round(coalesce(tn / nullif(tn + fn, 0), 0), 6) + 0.0 end as npv
    from m""", "order_scores"))
def q_origin_metrics(spark, sf_dir):
    # Per-domain origin thresholds of the reference runs (0.5 / 0.3 / 0.25).
    return evaluate.metrics_at_thresholds(order_scores(spark, sf_dir), {"math": 0.5, "code": 0.3, "medical": 0.25}, label="y_origin", score="origin_prob")


@register("per_class", "D5 F10", with_views("""
    with c as (select domain, sum((node_prob > 0.5 and y = 1)::int) as tp, sum((node_prob > 0.5 and y <> 1)::int) as fp,
                      sum((node_prob <= 0.5 and y <> 1)::int) as tn, sum((node_prob <= 0.5 and y = 1)::int) as fn
               from order_scores group by domain),
    k as (select domain, 1 as cls, tp as a, fp as b, fn as c from c
          union all select domain, 0, tn, fn, fp from c),
    m as (select domain, cls, a, c, coalesce(a / nullif(a + b, 0), 0) as p, coalesce(a / nullif(a + c, 0), 0) as r from k)
    select domain, cast(cls as bigint) as cls, round(p, 6) + 0.0 as precision, round(r, 6) + 0.0 as recall,
           round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) + 0.0 as f1, cast(a + c as bigint) as support
    from m""", "order_scores"))
def q_per_class(spark, sf_dir):
    return evaluate.per_class_metrics(_scores(spark, sf_dir), ["domain"])


_RANK_SQL = """
    d as (select domain, node_prob as s, sum((y = 1)::int) as pos, sum((y <> 1)::int) as neg
          from order_scores group by domain, node_prob),
    c as (select *, coalesce(sum(neg) over (partition by domain order by s rows between unbounded preceding and 1 preceding), 0) as neg_below,
                 coalesce(sum(pos) over (partition by domain order by s rows between unbounded preceding and 1 preceding), 0) as pos_below,
                 sum(pos) over (partition by domain) as P, sum(neg) over (partition by domain) as N
          from d)"""


@register("auroc", "D3", with_views(f"""
    with {_RANK_SQL}
    select domain, round(case when max(P) > 0 and max(N) > 0
                              then sum(pos * (neg_below + 0.5 * neg)) / (max(P) * max(N)) else 0 end, 6) + 0.0 as auroc
    from c group by domain""", "order_scores"))
def q_auroc(spark, sf_dir):
    return evaluate.auroc(_scores(spark, sf_dir), ["domain"])


@register("auprc", "D4", with_views(f"""
    with {_RANK_SQL}
    select domain, round(coalesce(sum(pos * coalesce((P - pos_below) / nullif((P - pos_below) + (N - neg_below), 0), 0))
                                  / nullif(max(P), 0), 0), 6) + 0.0 as auprc
    from c group by domain""", "order_scores"))
def q_auprc(spark, sf_dir):
    return evaluate.auprc(_scores(spark, sf_dir), ["domain"])


def _cross_preds(spark, sf_dir):
    v = order_votes(spark, sf_dir)
    s = order_steps(spark, sf_dir).select("chain_id", "idx", "domain", F.col("is_correct").cast("long").alias("y"))
    return (v.join(s, ["chain_id", "idx"])
            .select(F.col("model_type").alias("trained_on"), F.col("domain").alias("test_domain"), "y",
                    F.col("pred").cast("double").alias("score")))


_CROSS_SQL = """
    h(trained_on, home_domain) as (values ('a', 'math'), ('b', 'code'), ('c', 'medical')),
    x as (select v.model_type as trained_on, s.domain as test_domain, s.is_correct::int as y, v.pred::int as pr
          from order_votes v join order_steps s using (chain_id, idx)),
    c as (select trained_on, test_domain, sum((pr = 1 and y = 1)::int) as tp, sum((pr = 1 and y <> 1)::int) as fp,
                 sum((pr = 0 and y <> 1)::int) as tn, sum((pr = 0 and y = 1)::int) as fn from x group by 1, 2),
    m as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r from c),
    f as (select trained_on, test_domain, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) + 0.0 as f1,
                 round((tp + tn) / (tp + fp + tn + fn), 6) + 0.0 as accuracy from m)"""


@register("cross_domain", "D7", with_views(f"""
    with {_CROSS_SQL}
    select f.trained_on, test_domain, f1, accuracy, test_domain = h.home_domain as in_domain
    from f left join h using (trained_on)""", "order_votes", "order_steps"))
def q_cross_domain(spark, sf_dir):
    home = spark.createDataFrame(HOME, "trained_on string, home_domain string")
    return evaluate.cross_domain_matrix(_cross_preds(spark, sf_dir), home)


@register("transfer_gap", "X8", with_views(f"""
    with {_CROSS_SQL},
    g as (select f.trained_on, max(case when test_domain = h.home_domain then f1 * 100 end) as ind,
                 avg(case when test_domain <> h.home_domain then f1 * 100 end) as crs
          from f join h using (trained_on) group by f.trained_on)
    select trained_on, round(coalesce(ind, 0), 6) + 0.0 as in_domain_f1, round(coalesce(crs, 0), 6) + 0.0 as cross_domain_f1,
           round(coalesce(ind, 0) - coalesce(crs, 0), 6) + 0.0 as gap,
           case when coalesce(ind, 0) - coalesce(crs, 0) < 10 then 'good'
                when coalesce(ind, 0) - coalesce(crs, 0) < 20 then 'moderate' else 'specific' end as transfer
    from g""", "order_votes", "order_steps"))
def q_transfer_gap(spark, sf_dir):
    home = spark.createDataFrame(HOME, "trained_on string, home_domain string")
    m = evaluate.cross_domain_matrix(_cross_preds(spark, sf_dir), home)
    return compare.transfer_gap(m.select("trained_on", "f1", F.coalesce("in_domain", F.lit(False)).alias("in_domain")))


@register("signature_distance", "X7", with_views("""
    with b as (select domain, cast(sum((node_prob > 0.5 and y = 1)::int) as double) as tp,
                      sum((node_prob > 0.5 and y <> 1)::int) as fp, sum((node_prob <= 0.5 and y = 1)::int) as fn,
                      sum((origin_prob > 0.5 and y_origin = 1)::int) as otp, sum((origin_prob > 0.5 and y_origin <> 1)::int) as ofp,
                      sum((origin_prob <= 0.5 and y_origin = 1)::int) as ofn
               from order_scores group by domain),
    m as (select domain, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r,
                 coalesce(otp / nullif(otp + ofp, 0), 0) as op, coalesce(otp / nullif(otp + ofn, 0), 0) as orr from b),
    v as (select domain, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) + 0.0 as node_f1, round(r, 6) + 0.0 as node_recall,
                 round(coalesce(2 * op * orr / nullif(op + orr, 0), 0), 6) + 0.0 as origin_f1, round(orr, 6) + 0.0 as origin_recall
          from m)
    select a.domain as domain_a, b.domain as domain_b,
           round(sqrt(pow(a.node_f1 - b.node_f1, 2) + pow(a.node_recall - b.node_recall, 2)
                      + pow(a.origin_f1 - b.origin_f1, 2) + pow(a.origin_recall - b.origin_recall, 2)), 6) + 0.0 as distance
    from v a join v b on a.domain < b.domain""", "order_scores"))
def q_signature_distance(spark, sf_dir):
    sc = order_scores(spark, sf_dir)
    node = evaluate.binary_metrics(sc.withColumnRenamed("node_prob", "score"), ["domain"])
    origin = evaluate.binary_metrics(sc.select("domain", F.col("y_origin").alias("y"), F.col("origin_prob").alias("score")),
                                     ["domain"])
    vec = node.select("domain", F.col("f1").alias("node_f1"), F.col("recall").alias("node_recall")).join(
        origin.select("domain", F.col("f1").alias("origin_f1"), F.col("recall").alias("origin_recall")), "domain")
    return compare.signature_distance(vec, "domain", ["node_f1", "node_recall", "origin_f1", "origin_recall"])


@register("ensemble_weighted", "D8", with_views("""
    with m as (select *, (abs(node_prob - 0.5) * 2 + abs(origin_prob - 0.5) * 2) / 2 as w from order_model_scores)
    select chain_id, idx, round(sum(node_prob * w) / greatest(sum(w), 1e-8), 6) + 0.0 as node_pred,
           round(sum(origin_prob * w) / greatest(sum(w), 1e-8), 6) + 0.0 as origin_pred
    from m group by chain_id, idx""", "order_model_scores"))
def q_ensemble_weighted(spark, sf_dir):
    return evaluate.ensemble_weighted(order_model_scores(spark, sf_dir))


@register("ensemble_max_conf", "D9", with_views("""
    with m as (select *, (abs(node_prob - 0.5) + abs(origin_prob - 0.5)) / 2 as c from order_model_scores)
    select chain_id, idx, round(arg_min(node_prob, (-c, model_order)), 6) + 0.0 as node_pred,
           round(arg_min(origin_prob, (-c, model_order)), 6) + 0.0 as origin_pred,
           arg_min(model_type, (-c, model_order)) as selected_model
    from m group by chain_id, idx""", "order_model_scores"))
def q_ensemble_max_conf(spark, sf_dir):
    return evaluate.ensemble_max_confidence(order_model_scores(spark, sf_dir))


@register("ensemble_mean", "D10", with_views("""
    select chain_id, idx, round(avg(node_prob), 6) + 0.0 as node_pred, round(avg(origin_prob), 6) + 0.0 as origin_pred
    from order_model_scores group by chain_id, idx""", "order_model_scores"))
def q_ensemble_mean(spark, sf_dir):
    return evaluate.ensemble_mean(order_model_scores(spark, sf_dir))


@register("ensemble_routed", "D10", with_views("""
    with r(domain, model_type) as (values ('math', 'a'), ('code', 'b'), ('medical', 'c')),
    cd as (select distinct chain_id, domain from order_steps)
    select m.chain_id, m.idx, round(m.node_prob, 6) + 0.0 as node_pred, round(m.origin_prob, 6) + 0.0 as origin_pred
    from order_model_scores m join cd using (chain_id) join r on r.domain = cd.domain and r.model_type = m.model_type""",
                                        "order_model_scores", "order_steps"))
def q_ensemble_routed(spark, sf_dir):
    routes = spark.createDataFrame([(d, m) for m, d in HOME], "domain string, model_type string")
    cd = order_steps(spark, sf_dir).select("chain_id", "domain").distinct()
    return evaluate.ensemble_routed(order_model_scores(spark, sf_dir), cd, routes)


@register("origin_recall", "D11", with_views("""
    select domain, round(avg((origin_prob > 0.5)::int::double), 6) + 0.0 as origin_recall, count(*) as n_origins
    from order_scores where y_origin = 1 group by domain""", "order_scores"))
def q_origin_recall(spark, sf_dir):
    return evaluate.origin_recall(order_scores(spark, sf_dir), ["domain"])


@register("loss_columns", "D12", with_views("""
    with p as (select domain, y::double as y, least(greatest(node_prob, 1e-7), 1 - 1e-7) as p from order_scores),
    b as (select domain, y, -(y * ln(p) + (1 - y) * ln(1 - p)) as bce from p),
    f as (select domain, bce, 0.25 * pow(1 - exp(-bce), 2.0) * bce as focal,
                 (0.75 * y + 0.25 * (1 - y)) * pow(1 - exp(-bce), 3.0) * bce * (2.0 * y + (1 - y)) as imp from b)
    select domain, round(avg(bce), 6) + 0.0 as bce, round(avg(focal), 6) + 0.0 as focal,
           round(avg(imp), 6) + 0.0 as improved_focal from f group by domain""", "order_scores"))
def q_loss_columns(spark, sf_dir):
    return evaluate.loss_columns(order_scores(spark, sf_dir), ["domain"])


@register("perturbation_report", "D13", with_views("""
    with a as (select chain_id, idx, node_prob as cs from order_model_scores where model_type = 'a'),
    b as (select chain_id, idx, node_prob as ps from order_model_scores where model_type = 'b'),
    x as (select s.domain, s.y, a.cs, b.ps, abs(a.cs - b.ps) as l2, (a.cs > 0.5)::int as cp, (b.ps > 0.5)::int as rp
          from order_scores s join a using (chain_id, idx) join b using (chain_id, idx))
    select domain, round(avg((cp = y)::int::double), 6) + 0.0 as acc_clean, round(avg((rp = y)::int::double), 6) + 0.0 as acc_robust,
           round(avg((cp = y)::int::double) - avg((rp = y)::int::double), 6) + 0.0 as acc_drop,
           round(avg(l2), 6) + 0.0 as avg_perturbation,
           round(coalesce(sum((cp = y and rp <> y)::int) / nullif(sum((cp = y)::int), 0), 0), 6) + 0.0 as attack_success_rate
    from x group by domain""", "order_scores", "order_model_scores"))
def q_perturbation_report(spark, sf_dir):
    ms = order_model_scores(spark, sf_dir)
    a = ms.filter(F.col("model_type") == "a").select("chain_id", "idx", F.col("node_prob").alias("clean_score"))
    b = ms.filter(F.col("model_type") == "b").select("chain_id", "idx", F.col("node_prob").alias("pert_score"))
    s = order_scores(spark, sf_dir).select("chain_id", "idx", "domain", "y")
    pairs = (s.join(a, ["chain_id", "idx"]).join(b, ["chain_id", "idx"])
             .withColumn("l2", F.abs(F.col("clean_score") - F.col("pert_score"))))
    return evaluate.perturbation_report(pairs, ["domain"])
