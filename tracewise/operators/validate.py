"""Validation and profiling (V1–V7) on the long chain form.

Inputs
* ``steps``  (chain_id, idx, step_id, is_correct, is_origin, depends_on array<long>)
* ``nodes``  (chain_id, node)
* ``edges``  (chain_id, edge array<long>)  – an edge of length != 2 is malformed
* ``chains`` (chain_id, domain)            – every chain, including empty ones

Each structural rule is a per-chain aggregate or an anti-join keyed by
chain_id, so the work is one or two shuffles on chain_id regardless of how
many rules are checked; nothing is gathered per chain except the message
payloads the reference itself reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions.common import broadcast_if_small, r6, safe_div
from tracewise.operators import chain_arrays as A
from tracewise.operators.stars import components
from tracewise.session import cut_lineage

# Fixed message texts (must equal the reference's wording).
MSG_DUPLICATE = "Duplicate step_ids found"
MSG_UNSORTED = "step_ids must be sorted"
MSG_NODES = "Dependency graph nodes don't match step_ids"


def _list_repr(arr) -> F.Column:
    return F.concat(F.lit("["), F.array_join(arr, ", "), F.lit("]"))


def validation_messages(steps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """V1: one row per (chain_id, rule, message)."""
    w = Window.partitionBy("chain_id").orderBy("idx")
    per_step = steps.select(
        "chain_id", "idx", "step_id", "is_origin",
        F.lag("step_id").over(w).alias("_prev_id"),
    )
    per_chain = per_step.groupBy("chain_id").agg(
        F.max(F.when(F.col("step_id") < F.col("_prev_id"), 1).otherwise(0)).alias("_unsorted"),
        F.array_sort(F.collect_list(F.when(F.col("is_origin"), F.struct("idx", "step_id")))).alias("_origins"),
    )
    row = lambda cond, rule, message: F.when(cond, F.struct(F.lit(rule).alias("rule"), message.alias("message")))
    found = F.array_compact(F.array(
        row(F.col("_unsorted") == 1, "unsorted_step_ids", F.lit(MSG_UNSORTED)),
        row(F.size("_origins") > 1, "multiple_origins",
            F.concat(F.lit("Multiple origin steps found: "), _list_repr(F.transform("_origins", lambda s: s["step_id"]))))))
    of_chain = per_chain.select("chain_id", found.alias("_found")).filter(F.size("_found") > 0).select("chain_id", F.inline("_found"))
    origin_ok = steps.filter(F.col("is_origin") & F.col("is_correct")).select(
        "chain_id", F.lit("origin_marked_correct").alias("rule"),
        F.concat(F.lit("Origin step "), F.col("step_id").cast("string"), F.lit(" is marked as correct")).alias("message"))
    bad_fmt = edges.filter(F.size("edge") != 2).select(
        "chain_id", F.lit("invalid_edge_format").alias("rule"),
        F.concat(F.lit("Invalid edge format: "), _list_repr("edge")).alias("message"))
    e2 = edges.filter(F.size("edge") == 2).select(
        "chain_id", "edge", F.col("edge")[0].alias("src"), F.col("edge")[1].alias("dst"))
    deps = steps.select("chain_id", "step_id", F.explode("depends_on").alias("dep"))
    odd = _odd_nodes(steps, nodes, e2, deps)
    any_of = lambda cond: F.coalesce(F.max(F.expr(cond)), F.lit(False))
    # node set vs step-id set; a null equals nothing
    by_chain = odd.groupBy("chain_id").agg(
        any_of("_steps > 1 or (node is null and _steps > 0)").alias("_dup"),
        any_of("(_steps > 0) <> _node or (_steps > 0 and (node is null or chain_id is null))").alias("_mism"))
    of_ids = by_chain.select("chain_id", F.inline(F.array_compact(F.array(
        row(F.col("_dup"), "duplicate_step_ids", F.lit(MSG_DUPLICATE)), row(F.col("_mism"), "nodes_mismatch", F.lit(MSG_NODES))))))
    lost = odd.filter("_edge and (not _node or node is null or chain_id is null)").select("chain_id", "node")
    bad_ref = (_referring(_referring(_of_chains(e2, lost), lost, "src", "_ls"), lost, "dst", "_ld").filter("_ls or _ld")
               .select("chain_id", F.lit("edge_invalid_node").alias("rule"),
                       F.concat(F.lit("Edge references invalid node: "), _list_repr("edge")).alias("message")))
    gone = odd.filter("_dep and (_steps = 0 or node is null or chain_id is null)").select("chain_id", "node")
    bad_dep = (_referring(_of_chains(deps, gone), gone, "dep", "_l").filter("_l")
               .select("chain_id", F.lit("invalid_dependency").alias("rule"),
                       F.concat(F.lit("Step "), F.col("step_id").cast("string"), F.lit(" depends on invalid step_id "),
                                F.col("dep").cast("string")).alias("message")))
    return (of_ids.unionByName(of_chain).unionByName(origin_ok)
            .unionByName(bad_fmt).unionByName(bad_ref).unionByName(bad_dep))


def _odd_nodes(steps: DataFrame, nodes: DataFrame, e2: DataFrame, deps: DataFrame) -> DataFrame:
    """(chain_id, node, _steps, _node, _edge, _dep): how many steps have the id, whether it is a node, an edge's end, a
    dependency - of those ids only that break a rule.  One aggregate over all mentions of an id instead of a join a rule."""
    of = lambda d, node, kind: d.select("chain_id", F.col(node).cast("long").alias("node"), F.lit(kind).alias("_kind"))
    ends = e2.select("chain_id", F.explode(F.array(F.col("src").cast("long"), F.col("dst").cast("long"))).alias("node"), F.lit(2).alias("_kind"))
    said = of(steps, "step_id", 0).unionByName(of(nodes, "node", 1)).unionByName(ends).unionByName(of(deps, "dep", 3))
    kind = lambda k: F.coalesce(F.max(F.col("_kind") == k), F.lit(False))
    state = said.groupBy("chain_id", "node").agg(F.count(F.when(F.col("_kind") == 0, 1)).alias("_steps"), kind(1).alias("_node"),
                                                 kind(2).alias("_edge"), kind(3).alias("_dep"))
    return cut_lineage(state.filter("_steps > 1 or (_steps > 0) <> _node or (_edge and not _node) or (_dep and _steps = 0) "
                                    "or node is null or chain_id is null"))


def _of_chains(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the chains that ``ids`` names: few, where few chains break a rule."""
    chains = broadcast_if_small(ids.select(F.col("chain_id").alias("_c")), 1_000_000)
    return rows.join(chains, F.col("chain_id").eqNullSafe(F.col("_c")), "left_semi")


def _referring(rows: DataFrame, ids: DataFrame, node: str, out: str) -> DataFrame:
    """``out``: whether the row's ``node`` is one of ``ids`` (distinct; nulls are ids too)."""
    ids = broadcast_if_small(ids.select(F.col("chain_id").alias("_c"), F.col("node").alias("_n"), F.lit(True).alias("_hit")))
    on = F.col("chain_id").eqNullSafe(F.col("_c")) & F.col(node).eqNullSafe(F.col("_n"))
    return rows.join(ids, on, "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_c", "_n", "_hit")


def validation_report(messages: DataFrame) -> DataFrame:
    """V1 summary: per rule, chains violating it and messages emitted."""
    return messages.groupBy("rule").agg(F.countDistinct("chain_id").alias("n_chains"),
                                        F.count(F.lit(1)).alias("n_messages"))


def chain_profile(steps: DataFrame, chains: DataFrame) -> DataFrame:
    """Per chain: length, error rate (0 if empty), first origin step_id (null if none)."""
    agg = steps.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.sum((~F.col("is_correct")).cast("int")).alias("n_wrong"),
        F.min(F.when(F.col("is_origin"), F.struct("idx", "step_id"))).alias("_first_origin"),
    )
    return (chains.join(agg, "chain_id", "left")
            .select("chain_id", "domain",
                    F.coalesce("n_steps", F.lit(0)).cast("long").alias("n_steps"),
                    safe_div("n_wrong", "n_steps").alias("error_rate"),
                    F.col("_first_origin.step_id").alias("origin_pos")))


BINS = 1024  # of a pass over a value range


def exact_medians(rows: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Per ``key`` the exact median of each column (nulls skipped).

    Selection by narrowing: rows become counts of distinct values; each pass cuts the range in which a middle value lies into BINS
    bins, sums the counts of each bin and goes on in the bin that holds the middle rank, until it holds one value.  So a task
    sorts at most BINS rows of a group, however many distinct values it has; a pass narrows a range BINS times."""
    long = rows.select(F.col(key).alias("_k"), F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in cols])))
    counts = cut_lineage(long.filter(F.col("_v").isNotNull()).groupBy("_k", "_c", "_v").agg(F.count(F.lit(1)).alias("_n")))
    whole = counts.groupBy("_k", "_c").agg(F.sum("_n").alias("_all"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # the two middle ranks (from 0), equal for an odd count
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("_w"), F.floor((F.col("_all") - 1) / 2).alias("_rank")), F.struct(F.lit(1).alias("_w"), F.floor(F.col("_all") / 2).alias("_rank"))))
    asked = cut_lineage(whole.select("_k", "_c", ranks.alias("_r"), "_lo", "_hi").select("_k", "_c", "_r.*", "_lo", "_hi"))
    group = ["_k", "_c", "_w"]
    while asked.filter("_lo < _hi").limit(1).count():
        wide = asked.filter("_lo < _hi")
        q = broadcast_if_small(wide.withColumnsRenamed({"_k": "_qk", "_c": "_qc"}))
        within = counts.join(q, F.expr("_k <=> _qk and _c = _qc and _v between _lo and _hi"))
        # halves: no overflow; where they leave no width at all, the least value and the others
        share = F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
        share = F.coalesce(share, (F.col("_v") > F.col("_lo")).cast("double"))
        bins = within.withColumn("_b", F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        bins = bins.groupBy(*group, "_rank", "_b").agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hit = bins.withColumn("_upto", upto).filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
        hit = hit.select(*group, (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), "_lo", "_hi")
        asked = cut_lineage(asked.filter("_lo = _hi").unionByName(hit))
    m = asked.groupBy(F.col("_k").alias(key), "_c").agg(F.avg("_lo").alias("_m"))
    return m.groupBy(key).agg(*[F.max(F.when(F.col("_c") == c, F.col("_m"))).alias(f"{c}_median") for c in cols])


def quality_report(steps: DataFrame, chains: DataFrame, messages: DataFrame) -> DataFrame:
    """V2 + V3 per domain: validity, length stats (population std), error-rate
    and origin-position mean/median, total and distinct messages."""
    messages = cut_lineage(messages.select("chain_id", "message"))  # read twice, as are the profiles
    prof = chain_profile(steps, chains)
    bad = messages.select("chain_id").distinct().withColumn("_invalid", F.lit(1))
    prof = cut_lineage(prof.join(bad, "chain_id", "left").drop("chain_id"))
    msg_dom = messages.join(chains.select("chain_id", "domain"), "chain_id").groupBy("domain").agg(
        F.count(F.lit(1)).alias("total_errors"), F.countDistinct("message").alias("unique_errors"))
    rep = prof.groupBy("domain").agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.sum(F.coalesce("_invalid", F.lit(0))).cast("long").alias("invalid_samples"),
        F.avg("n_steps").alias("len_mean"),
        F.min("n_steps").alias("len_min"), F.max("n_steps").alias("len_max"),
        F.stddev_pop("n_steps").alias("len_std"),
        F.avg("error_rate").alias("err_mean"), F.avg("origin_pos").alias("origin_mean"),
    )
    medians = exact_medians(prof, "domain", ["n_steps", "error_rate", "origin_pos"]).select(
        "domain", F.col("n_steps_median").alias("len_median"), F.col("error_rate_median").alias("err_median"),
        F.col("origin_pos_median").alias("origin_median"))
    rep = rep.join(msg_dom, "domain", "left").join(medians, "domain", "left")
    return rep.select(
        "domain", "total_samples", (F.col("total_samples") - F.col("invalid_samples")).alias("valid_samples"),
        "invalid_samples", r6(safe_div(F.col("total_samples") - F.col("invalid_samples"), "total_samples")).alias("validity_rate"),
        r6("len_mean").alias("len_mean"), r6("len_median").alias("len_median"),
        F.col("len_min").cast("long").alias("len_min"), F.col("len_max").cast("long").alias("len_max"),
        r6("len_std").alias("len_std"), r6("err_mean").alias("err_mean"), r6("err_median").alias("err_median"),
        r6(F.coalesce("origin_mean", F.lit(0.0))).alias("origin_mean"),
        r6(F.coalesce("origin_median", F.lit(0.0))).alias("origin_median"),
        F.coalesce("total_errors", F.lit(0)).cast("long").alias("total_errors"),
        F.coalesce("unique_errors", F.lit(0)).cast("long").alias("unique_errors"),
    )


def error_histogram(messages: DataFrame) -> DataFrame:
    """V3 error_types: message -> count."""
    return messages.groupBy("message").agg(F.count(F.lit(1)).alias("n"))


def unreached_nodes(nodes: DataFrame, edges: DataFrame, has_steps: DataFrame, limit: int = A.ROW_ENDS) -> DataFrame:
    """V4: nodes not reachable (undirected) from node 0, one row per node
    (chain_id, node); per-chain counts are a group-by away.

    Chains of more than ``limit`` edges get component labels by star contraction (rounds in the logarithm of the longest path),
    which are compared with node 0's."""
    start = has_steps.select("chain_id").distinct().withColumn("node", F.lit(0).cast("long"))
    (e, s), long = A.split_long([edges.select("chain_id", "src", "dst"), start], limit)
    reach = A.reached(e, s, both_ways=True).select("chain_id", "node")
    if long is not None:
        labels = cut_lineage(components(long[0]))
        home = labels.filter("node = 0").join(long[1].select("chain_id"), "chain_id", "left_semi").select("chain_id", "component")
        reach = reach.unionByName(labels.join(home, ["chain_id", "component"]).select("chain_id", "node")).unionByName(long[1])
    return nodes.select("chain_id", "node").distinct().join(reach, ["chain_id", "node"], "left_anti")


def label_inconsistency(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """V5: (chain_id, step_id, issue) – multiple origins, first origin marked
    correct, direct successors of the first origin marked correct."""
    first = (steps.filter("is_origin").groupBy("chain_id")
             .agg(F.min(F.struct("idx", "step_id", "is_correct")).alias("o"), F.count(F.lit(1)).alias("n_origin")))
    multi = first.filter(F.col("n_origin") > 1).select(
        "chain_id", F.lit(None).cast("long").alias("step_id"), F.lit("multiple_origins").alias("issue"))
    oc = first.filter(F.col("o.is_correct")).select(
        "chain_id", F.col("o.step_id").alias("step_id"), F.lit("origin_marked_correct").alias("issue"))
    succ = (first.select("chain_id", F.col("o.step_id").alias("src"))
            .join(edges.select("chain_id", "src", "dst"), ["chain_id", "src"])
            .select("chain_id", F.col("dst").alias("step_id")).distinct())
    dep = (succ.join(steps.filter("is_correct").select("chain_id", "step_id"), ["chain_id", "step_id"])
           .select("chain_id", "step_id", F.lit("dependent_marked_correct").alias("issue")))
    return multi.unionByName(oc).unionByName(dep)


def chain_listing(steps: DataFrame, chains: DataFrame, domain: str | None = None, limit: int | None = None,
                  query_chars: int | None = None, after=None) -> DataFrame:
    """V6: query (cut to ``query_chars`` characters and '...' when given, 100 in
    the reference), num_steps, has_errors, error_count.  ``limit`` is a page, which
    starts behind the chain ``after`` (the last of the page before): chains up to there
    are filtered out of both scans, and only a page of keys is kept of each task."""
    if after is not None:
        chains, steps = (d.filter(F.col("chain_id") > F.lit(after)) for d in (chains, steps))
    if domain is not None:
        chains = chains.filter(F.col("domain") == domain)
    if limit is not None:
        chains = chains.orderBy("chain_id").limit(limit)
        steps = steps.join(broadcast_if_small(chains.select("chain_id")), "chain_id", "left_semi")
    shown = F.col("query")
    if query_chars is not None:
        shown = F.when(F.length("query") > query_chars, F.concat(F.substring("query", 1, query_chars), F.lit("..."))).otherwise(shown)
    agg = steps.groupBy("chain_id").agg(F.count(F.lit(1)).alias("num_steps"),
                                        F.sum((~F.col("is_correct")).cast("int")).alias("error_count"))
    out = chains.join(agg, "chain_id", "left").select(
        "chain_id", "domain",
        shown.alias("query"),
        F.coalesce("num_steps", F.lit(0)).cast("long").alias("num_steps"),
        (F.coalesce("error_count", F.lit(0)) > 0).alias("has_errors"),
        F.coalesce("error_count", F.lit(0)).cast("long").alias("error_count"))
    return out


def lookup_chain(chains: DataFrame, chain_id) -> DataFrame:
    """V7: point lookup.  The filter reaches the scan; on a table of ``io.write_lookup`` bloom filters and the statistics of
    sorted row groups leave one row group to read."""
    return chains.filter(F.col("chain_id") == F.lit(chain_id)).limit(1)
