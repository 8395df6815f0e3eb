"""Multi-model consensus (M1–M11) on long-form votes.

``votes``: (chain_id, idx, model_type, pred boolean).  Model weights are a
small dimension table (model_type, weight) and are broadcast; a missing model
gets weight 1.0.  Each strategy is a single partial-aggregating ``groupBy``
on (chain_id, idx); chain-level results are a second ``groupBy`` on
chain_id.  Agreement rates are exact doubles; callers round for display.  Ties follow the reference: a tied majority is *false*, the expert
is the highest weight with ties going to the first model in input order
(``model_order`` column, else model name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.functions.common import broadcast_if_small, r6, safe_div


def check_inputs(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M1: split into (accepted votes, rejected chains).  A chain is rejected
    when its models do not all predict the same number of steps."""
    per_model = votes.groupBy("chain_id", "model_type").agg(F.count(F.lit(1)).alias("n"))
    per_chain = per_model.groupBy("chain_id").agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"),
                                                   F.count(F.lit(1)).alias("n_models"))
    bad = per_chain.filter(F.col("min_n") != F.col("max_n")).select(
        "chain_id", F.lit("unequal prediction lengths").alias("reason"))
    ok = votes.join(bad.select("chain_id"), "chain_id", "left_anti")
    return ok, bad


def _with_weights(votes: DataFrame, weights: DataFrame | None) -> DataFrame:
    if weights is None:
        return votes.withColumn("weight", F.lit(1.0))
    w = broadcast_if_small(weights.select("model_type", F.col("weight").cast("double")))
    return votes.join(w, "model_type", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def majority_vote(votes: DataFrame) -> DataFrame:
    """M2 + M7: pred = correct votes > wrong votes (tie -> false); agreement = max/n, for all chains at once."""
    g = votes.groupBy("chain_id", "idx").agg(F.sum(F.col("pred").cast("int")).alias("c"),
                                              F.count(F.lit(1)).alias("n"))
    return g.select("chain_id", "idx", (F.col("c") > F.col("n") - F.col("c")).alias("pred"),
                    (F.greatest("c", F.col("n") - F.col("c")) / F.col("n")).alias("agreement"))


def weighted_vote(votes: DataFrame, weights: DataFrame | None) -> DataFrame:
    """M3: strict weighted majority; agreement = max weight / total weight."""
    v = _with_weights(votes, weights)
    g = v.groupBy("chain_id", "idx").agg(F.sum(F.when(F.col("pred"), F.col("weight")).otherwise(0.0)).alias("cw"),
                                          F.sum(F.when(F.col("pred"), 0.0).otherwise(F.col("weight"))).alias("ew"))
    return g.select("chain_id", "idx", (F.col("cw") > F.col("ew")).alias("pred"),
                    safe_div(F.greatest("cw", "ew"), F.col("cw") + F.col("ew")).alias("agreement"))


def unanimous_vote(votes: DataFrame) -> DataFrame:
    """M4: pred = all correct; agreement 1 when unanimous else majority share."""
    g = votes.groupBy("chain_id", "idx").agg(F.sum(F.col("pred").cast("int")).alias("c"),
                                              F.count(F.lit(1)).alias("n"))
    unan = (F.col("c") == F.col("n")) | (F.col("c") == 0)
    return g.select("chain_id", "idx", (F.col("c") == F.col("n")).alias("pred"),
                    F.when(unan, F.lit(1.0)).otherwise(F.greatest("c", F.col("n") - F.col("c")) / F.col("n")).alias("agreement"))


def expert_vote(votes: DataFrame, weights: DataFrame | None) -> DataFrame:
    """M5: the highest-weight model decides; agreement = share equal to it."""
    v = _with_weights(votes, weights)
    order = F.col("model_order") if "model_order" in v.columns else F.col("model_type")
    g = v.groupBy("chain_id", "idx").agg(
        F.min(F.struct((-F.col("weight")).alias("nw"), order.alias("o"), F.col("pred").alias("p"))).alias("ex"),
        F.sum(F.col("pred").cast("int")).alias("c"), F.count(F.lit(1)).alias("n"))
    agree = F.when(F.col("ex.p"), F.col("c")).otherwise(F.col("n") - F.col("c"))
    return g.select("chain_id", "idx", F.col("ex.p").alias("pred"), (agree / F.col("n")).alias("agreement"))


def chain_consensus(step_votes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """M6: per chain, consensus exists iff every step's agreement >= threshold;
    confidence = mean agreement; the disagreement points themselves are the
    rows of ``disagreement_points`` (a per-chain list would put a long
    chain's whole list in one task)."""
    ok = F.col("agreement") >= F.lit(threshold)
    return step_votes.groupBy("chain_id").agg(
        F.min(ok.cast("int")).cast("boolean").alias("consensus_exists"),
        r6(F.avg("agreement")).alias("consensus_confidence"),
        F.count(F.lit(1)).alias("num_steps"),
        F.sum((~ok).cast("int")).cast("long").alias("num_disagreements"),
    )


def disagreement_points(step_votes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """M6 / M9: (chain_id, idx, agreement) of the steps below the threshold."""
    return step_votes.filter(F.col("agreement") < F.lit(threshold)).select("chain_id", "idx", "agreement")


def combine_predictors(step_votes: DataFrame, other: DataFrame, other_weight: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """M8: w = a(1-g) + (1-a)g; keep the consensus when w > 0.5 else the other
    predictor.  ``other``: (chain_id, idx, other_pred).  Returns the combined
    steps, and the steps that only one side has (chain_id, idx, reason): the
    reference raises on unequal lengths."""
    g = F.lit(other_weight)
    j = step_votes.withColumn("_a", F.lit(True)).join(other.withColumn("_b", F.lit(True)), ["chain_id", "idx"], "full")
    w = F.col("agreement") * (1 - g) + (1 - F.col("agreement")) * g
    both = j.filter("_a and _b").select("chain_id", "idx", F.when(w > 0.5, F.col("pred")).otherwise(F.col("other_pred")).alias("combined"))
    one = j.filter("_a is null or _b is null").select(
        "chain_id", "idx", F.when(F.col("_b").isNull(), "no second prediction").otherwise("no consensus").alias("reason"))
    return both, one


def disagreement_analysis(step_votes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """M9 summary: per chain has / count / rate of disagreement."""
    ok = F.col("agreement") >= F.lit(threshold)
    summ = step_votes.groupBy("chain_id").agg(F.count(F.lit(1)).alias("num_steps"),
                                               F.sum((~ok).cast("int")).cast("long").alias("num_disagreements"))
    return summ.select("chain_id", (F.col("num_disagreements") > 0).alias("has_disagreement"), "num_disagreements",
                       r6(safe_div("num_disagreements", "num_steps")).alias("disagreement_rate"))


def disagreement_details(step_votes: DataFrame, votes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """M9 details: every model's prediction at every disagreement point, as
    rows (chain_id, idx, model_type, pred) – a semi-join, no per-chain list."""
    pts = disagreement_points(step_votes, threshold).select("chain_id", "idx")
    return votes.join(pts, ["chain_id", "idx"], "left_semi").select("chain_id", "idx", "model_type", "pred")


def agreement_patterns(step_votes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row over all chains: totals, consensus rate, agreement mean,
    population std, min, max, disagreements and their rate.  One aggregate over
    steps, one over chains; their single rows meet in a last aggregate."""
    ok = (F.col("agreement") >= F.lit(threshold)).cast("int")
    steps = step_votes.agg(F.count(F.lit(1)).alias("total_steps"), F.sum(1 - ok).alias("total_disagreements"),
                           F.avg("agreement").alias("mean"), F.stddev_pop("agreement").alias("std"),
                           F.min("agreement").alias("mn"), F.max("agreement").alias("mx"))
    chains = step_votes.groupBy("chain_id").agg(F.min(ok).alias("cons")).agg(
        F.count(F.lit(1)).alias("total_chains"), F.sum("cons").cast("long").alias("chains_with_consensus"))
    both = steps.unionByName(chains, allowMissingColumns=True)
    a = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return a.select(
        "total_chains", "chains_with_consensus",
        r6(safe_div("chains_with_consensus", "total_chains")).alias("consensus_rate"),
        r6("mean").alias("avg_agreement_rate"), F.col("total_disagreements").cast("long").alias("total_disagreements"),
        r6(safe_div("total_disagreements", "total_steps")).alias("disagreement_rate"),
        r6("std").alias("agreement_std"), r6("mn").alias("agreement_min"), r6("mx").alias("agreement_max"))


def pair_by_position(chains_a: DataFrame, chains_b: DataFrame, order_col: str = "chain_id") -> DataFrame:
    """Pair the i-th chain of model A with the i-th chain of model B (by
    ``order_col``, of any type), up to the shorter list - an equi-join on the
    position, which is counted off over range partitions."""
    from tracewise.functions.ranking import global_position

    def pos(df, tag):
        return global_position(df.select(F.col(order_col).alias(f"chain_{tag}")).distinct(), f"chain_{tag}", out="pos")

    return pos(chains_a, "a").join(pos(chains_b, "b"), "pos")


def pair_by_query(chains_a: DataFrame, chains_b: DataFrame, query_col: str = "query_id") -> DataFrame:
    """Pair the chains of two models that answer the same query (equi-join
    on the query id, of any type)."""
    a = chains_a.select(query_col, F.col("chain_id").alias("chain_a")).distinct()
    b = chains_b.select(query_col, F.col("chain_id").alias("chain_b")).distinct()
    return a.join(b, query_col)
