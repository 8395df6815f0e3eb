"""Graph (G1–G19) and error-propagation (E1–E6) queries.

Graphs: ``order_steps`` nodes with ``order_edges`` (sequential plus skip
edges), and ``vec_steps`` for the embedding-based operators.  Oracles use
recursive CTEs (walk / path enumeration), independent of the BFS rounds on
the Spark side.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewise.functions.common import r6
from tracewise.operators import graph as G
from tracewise.operators import propagate as E
from tracewise.plans.catalog_validate import validation_input
from tracewise.plans.registry import register
from tracewise.session import cut_lineage
from tracewise.sources.fixtures import (SQL_VIEWS, order_edges, order_model_scores, order_scores, order_steps, step_scores, vec_steps,
                                        with_views)

SQL_VIEWS.update({
    "gnodes": (("order_steps",), "select chain_id, idx as node from order_steps"),
    # planted cycle 2 -> 0 in every 13th chain (exercises the is_dag / n-1 rule)
    "cyc_edges": (("order_edges", "order_steps"), """
        select chain_id, src, dst from order_edges
        union all select chain_id, 2, 0 from order_steps where chain_id % 13 = 0 and idx = 2"""),
    "vec_edges": (("vec_steps",), "select chain_id, idx - 1 as src, idx as dst from vec_steps where idx >= 1"),
})


def _nodes(s):
    return s.select("chain_id", F.col("idx").alias("node"))


def _cyc_edges(s):
    return order_edges(s).unionByName(
        s.filter((F.col("chain_id") % 13 == 0) & (F.col("idx") == 2))
        .select("chain_id", F.lit(2).cast("long").alias("src"), F.lit(0).cast("long").alias("dst")))


@register("node_labels", "G1 G15", with_views("""
    select chain_id, idx, is_correct::double as y, is_origin::double as y_origin,
           cast(case lower(coalesce(error_type, '')) when 'factual' then 1 when 'logical' then 2 when 'syntax' then 3 else 0 end
                as bigint) as y_error_type,
           cast(case lower(domain) when 'math' then 0 when 'code' then 1 when 'medical' then 2 else 0 end as bigint) as domain_id,
           case when is_origin then 'origin' when not is_correct then 'propagated' else 'correct' end as role
    from order_steps""", "order_steps"))
def q_node_labels(spark, sf_dir):
    s = order_steps(spark, sf_dir)
    return G.node_table(s).join(G.node_roles(s), ["chain_id", "idx"])


@register("edge_table", "G1", with_views("""
    with ve as (select * from vedges where chain_id % 11 <> 0),
    valid as (select chain_id, edge[1] as src, edge[2] as dst from ve where len(edge) = 2)
    select chain_id, src, dst, 1.0::double as weight from valid
    union all
    select chain_id, idx - 1, idx, 1.0::double from vsteps
    where idx >= 1 and chain_id not in (select chain_id from valid)""", "vedges", "vsteps"))
def q_edge_table(spark, sf_dir):
    steps, _, edges = validation_input(spark, sf_dir)
    return G.edge_table(steps, edges.filter(F.col("chain_id") % 11 != 0))


@register("topology_basic", "G2 G3 G7", with_views("""
    with recursive e as (select distinct chain_id, src, dst from order_edges),
    ind as (select chain_id, dst as node, count(*) as c from e group by 1, 2),
    outd as (select chain_id, src as node, count(*) as c from e group by 1, 2),
    u as (select distinct chain_id, least(src, dst) as a, greatest(src, dst) as b from e where src <> dst),
    nb as (select chain_id, a as v, b as w from u union all select chain_id, b, a from u),
    deg as (select chain_id, v, count(*) as d from nb group by 1, 2),
    tri as (select x.chain_id, x.v, count(*) as t from nb x join nb y on x.chain_id = y.chain_id and x.v = y.v and x.w < y.w
            join u on u.chain_id = x.chain_id and u.a = x.w and u.b = y.w group by 1, 2),
    w(chain_id, node, k) as (select chain_id, node, 0 from gnodes
                             union select w.chain_id, e.dst, w.k + 1 from w join e on e.chain_id = w.chain_id and e.src = w.node
                             where w.k + 1 <= (select count(*) from gnodes g where g.chain_id = w.chain_id)),
    nn as (select chain_id, count(*) as n from gnodes group by 1),
    lp as (select nn.chain_id, case when max(k) >= n then n - 1 else max(k) end as depth
           from w join nn using (chain_id) group by nn.chain_id, n),
    s as (select chain_id, idx, domain from order_steps)
    select s.chain_id, s.idx, coalesce(ind.c, 0) as in_deg, coalesce(outd.c, 0) as out_deg,
           round(case when coalesce(deg.d, 0) < 2 then 0.0 else 2.0 * coalesce(tri.t, 0) / (deg.d * (deg.d - 1)) end, 6) + 0.0
               as clustering,
           (s.domain = 'math')::int::double as is_math, (s.domain = 'code')::int::double as is_code,
           (s.domain = 'medical')::int::double as is_medical, lp.depth::double as depth,
           round(s.idx / greatest(nn.n - 1, 1), 6) + 0.0 as position, 0.5::double as factual_density
    from s left join ind on ind.chain_id = s.chain_id and ind.node = s.idx
    left join outd on outd.chain_id = s.chain_id and outd.node = s.idx
    left join deg on deg.chain_id = s.chain_id and deg.v = s.idx
    left join tri on tri.chain_id = s.chain_id and tri.v = s.idx
    join nn on nn.chain_id = s.chain_id join lp on lp.chain_id = s.chain_id""", "order_steps", "order_edges", "gnodes"))
def q_topology_basic(spark, sf_dir):
    s = order_steps(spark, sf_dir)
    top = cut_lineage(G.topology(_nodes(s), order_edges(s), ("in_deg", "out_deg", "clustering", "max_depth")))
    return top.withColumnRenamed("node", "idx").join(G.task_features(s, top), ["chain_id", "idx"]).select(
        "chain_id", "idx", "in_deg", "out_deg", "clustering", "is_math", "is_code", "is_medical", "depth", "position",
        "factual_density")


@register("shortest_path", "G4", with_views("""
    with recursive d(chain_id, node, dist) as (
        select distinct chain_id, 0::bigint, 0 from gnodes where node = 0
        union select d.chain_id, e.dst, d.dist + 1 from d join order_edges e on e.chain_id = d.chain_id and e.src = d.node
        where d.dist < 64),
    m as (select chain_id, node, min(dist) as dist from d group by 1, 2)
    select g.chain_id, g.node, cast(coalesce(m.dist, -1) as bigint) as path_length
    from gnodes g left join m using (chain_id, node)""", "gnodes", "order_edges"))
def q_shortest_path(spark, sf_dir):
    s = order_steps(spark, sf_dir)
    return G.root_distance(_nodes(s), order_edges(s))


@register("longest_path", "G6", with_views("""
    with recursive nn as (select chain_id, count(*) as n from gnodes group by 1),
    w(chain_id, node, k) as (select chain_id, node, 0 from gnodes
                             union select w.chain_id, e.dst, w.k + 1 from w join cyc_edges e on e.chain_id = w.chain_id
                                   and e.src = w.node join nn on nn.chain_id = w.chain_id where w.k + 1 <= nn.n)
    select nn.chain_id, max(k) < n as is_dag, cast(case when max(k) >= n then n - 1 else max(k) end as bigint) as max_depth
    from w join nn using (chain_id) group by nn.chain_id, n""", "gnodes", "cyc_edges"))
def q_longest_path(spark, sf_dir):
    s = order_steps(spark, sf_dir)
    return G.longest_paths(_nodes(s), _cyc_edges(s))


_STATS_SQL = """
    nn as (select chain_id, count(*) as n from gnodes group by 1),
    w(chain_id, node, k) as (select chain_id, node, 0 from gnodes
                             union select w.chain_id, e.dst, w.k + 1 from w join cyc_edges e on e.chain_id = w.chain_id
                                   and e.src = w.node join nn on nn.chain_id = w.chain_id where w.k + 1 <= nn.n),
    lp as (select nn.chain_id, max(k) < n as is_dag, case when max(k) >= n then n - 1 else max(k) end as max_depth
           from w join nn using (chain_id) group by nn.chain_id, n),
    ne as (select chain_id, count(*) as e from cyc_edges group by 1),
    st as (select s.chain_id, count(*) as num_nodes, cast(sum((not is_correct)::int) as bigint) as num_errors,
                  arg_min(step_id, idx) filter (where is_origin) as origin_position, bool_or(is_origin) as has_origin
           from order_steps s group by 1),
    gs as (select st.chain_id, num_nodes, cast(coalesce(ne.e, 0) as bigint) as num_edges,
                  round(2.0 * coalesce(ne.e, 0) / greatest(num_nodes, 1), 6) + 0.0 as avg_degree,
                  round(case when num_nodes > 1 then coalesce(ne.e, 0) / (num_nodes * (num_nodes - 1)) else 0 end, 6) + 0.0
                      as density,
                  is_dag, cast(max_depth as bigint) as max_depth, num_errors,
                  round(num_errors / greatest(num_nodes, 1), 6) + 0.0 as error_rate, has_origin, origin_position
           from st left join ne using (chain_id) left join lp using (chain_id))"""


@register("graph_stats", "G12", with_views(f"with recursive {_STATS_SQL} select * from gs",
                                         "gnodes", "cyc_edges", "order_steps"))
def q_graph_stats(spark, sf_dir):
    s = order_steps(spark, sf_dir)
    return G.graph_stats(s, _cyc_edges(s))


@register("domain_comparison", "G16", with_views(f"""
    with recursive {_STATS_SQL}
    select c.domain, count(*) as num_chains, round(avg(num_nodes), 6) + 0.0 as avg_nodes,
           round(avg(num_edges), 6) + 0.0 as avg_edges, round(avg(max_depth), 6) + 0.0 as avg_depth,
           round(avg(error_rate), 6) + 0.0 as avg_error_rate
    from gs join (select distinct chain_id, domain from order_steps) c using (chain_id) group by c.domain""",
                                              "gnodes", "cyc_edges", "order_steps"))
def q_domain_comparison(spark, sf_dir):
    s = order_steps(spark, sf_dir)
    return G.domain_comparison(G.graph_stats(s, _cyc_edges(s)), s.select("chain_id", "domain").distinct())


@register("betweenness", "G5", with_views("""
    with recursive e as (select distinct chain_id, src, dst from order_edges),
    d(chain_id, s, v, k) as (select chain_id, node, node, 0 from gnodes
                             union select d.chain_id, d.s, e.dst, d.k + 1 from d join e on e.chain_id = d.chain_id and e.src = d.v
                             where d.k < 64),
    dm as (select chain_id, s, v, min(k) as dist from d group by 1, 2, 3),
    p(chain_id, s, v, k) as (select chain_id, node, node, 0 from gnodes
                             union all select p.chain_id, p.s, e.dst, p.k + 1 from p join e on e.chain_id = p.chain_id and e.src = p.v
                                       join dm on dm.chain_id = p.chain_id and dm.s = p.s and dm.v = e.dst and dm.dist = p.k + 1),
    sg as (select chain_id, s, v, count(*)::double as sigma, min(k) as dist from p group by 1, 2, 3),
    nn as (select chain_id, count(*) as n from gnodes group by 1),
    bc as (select a.chain_id, a.v, sum(a.sigma * b.sigma / st.sigma) as bc
           from sg a join sg b on b.chain_id = a.chain_id and b.s = a.v
           join sg st on st.chain_id = a.chain_id and st.s = a.s and st.v = b.v
           where a.s <> a.v and b.v <> a.v and a.s <> b.v and a.dist + b.dist = st.dist
           group by 1, 2)
    select g.chain_id, g.node,
           round(case when nn.n > 2 then coalesce(bc.bc, 0) / ((nn.n - 1) * (nn.n - 2)) else 0 end, 6) + 0.0 as betweenness
    from gnodes g join nn using (chain_id) left join bc on bc.chain_id = g.chain_id and bc.v = g.node""",
                                        "gnodes", "order_edges"))
def q_betweenness(spark, sf_dir):
    s = order_steps(spark, sf_dir)
    return G.betweenness(_nodes(s), order_edges(s))


@register("degree_hist", "G13", with_views("""
    with e as (select distinct chain_id, src, dst from order_edges),
    dg as (select g.chain_id, g.node, coalesce(i.c, 0) + coalesce(o.c, 0) as d
           from gnodes g left join (select chain_id, dst as node, count(*) as c from e group by 1, 2) i using (chain_id, node)
           left join (select chain_id, src as node, count(*) as c from e group by 1, 2) o using (chain_id, node)),
    r as (select min(d)::double as lo, max(d)::double as hi from dg),
    rr as (select case when lo = hi then lo - 0.5 else lo end as lo, case when lo = hi then hi + 0.5 else hi end as hi from r)
    select cast(least(floor((d - lo) / ((hi - lo) / 20)), 19) as bigint) as bin,
           round(lo + least(floor((d - lo) / ((hi - lo) / 20)), 19) * ((hi - lo) / 20), 6) + 0.0 as lower,
           round(lo + (least(floor((d - lo) / ((hi - lo) / 20)), 19) + 1) * ((hi - lo) / 20), 6) + 0.0 as upper,
           count(*) as n
    from dg, rr group by 1, 2, 3""", "gnodes", "order_edges"))
def q_degree_hist(spark, sf_dir):
    s = order_steps(spark, sf_dir)
    deg = G.degrees(_nodes(s), order_edges(s)).select((F.col("in_deg") + F.col("out_deg")).alias("d"))
    return G.histogram(deg, "d", 20)


@register("length_hist", "G14", with_views("""
    with l as (select chain_id, count(*)::double as n from order_steps group by 1),
    r as (select min(n) as lo, max(n) as hi, avg(n) as m from l),
    rr as (select case when lo = hi then lo - 0.5 else lo end as lo, case when lo = hi then hi + 0.5 else hi end as hi, m from r)
    select cast(least(floor((n - lo) / ((hi - lo) / 30)), 29) as bigint) as bin,
           round(lo + least(floor((n - lo) / ((hi - lo) / 30)), 29) * ((hi - lo) / 30), 6) + 0.0 as lower,
           round(lo + (least(floor((n - lo) / ((hi - lo) / 30)), 29) + 1) * ((hi - lo) / 30), 6) + 0.0 as upper,
           count(*) as n, round(any_value(m), 6) + 0.0 as mean_length
    from l, rr group by 1, 2, 3""", "order_steps"))
def q_length_hist(spark, sf_dir):
    lens = order_steps(spark, sf_dir).groupBy("chain_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    h = G.histogram(lens, "n", 30)
    mean = lens.agg(F.avg("n")).first()[0]
    return h.withColumn("mean_length", F.round(F.lit(float(mean)), 6) + F.lit(0.0))


@register("semantic_edges", "G9 G10", with_views("""
    with a as (select x.chain_id, x.idx as src, y.idx as dst, list_cosine_similarity(x.embedding, y.embedding) as c
               from vec_steps x join vec_steps y on x.chain_id = y.chain_id and x.idx < y.idx)
    select chain_id, src, dst from a where c >= 0.3
    union
    select chain_id, src, dst from vec_edges""", "vec_steps", "vec_edges"))
def q_semantic_edges(spark, sf_dir):
    v = vec_steps(spark, sf_dir)
    existing = v.filter(F.col("idx") >= 1).select("chain_id", (F.col("idx") - 1).alias("src"), F.col("idx").alias("dst"))
    return G.enhance_edges(existing, v, "hybrid", 0.3)


@register("semantic_pruning", "G9")
def q_semantic_pruning(spark, sf_dir):
    """Rows-only: of the pairs of a chain's steps, how many the bound left to be tested, and the edges found."""
    t = G.semantic_tiles(vec_steps(spark, sf_dir), 0.7)
    return t.groupBy("chain_id").agg(F.sum("possible").alias("possible"), F.sum("tested").alias("tested"), F.sum(F.size("edges")).alias("edges"))


@register("edge_eval", "G11", with_views("""
    with pr as (select x.chain_id, x.idx as src, y.idx as dst from vec_steps x join vec_steps y
                on x.chain_id = y.chain_id and x.idx < y.idx
                where list_cosine_similarity(x.embedding, y.embedding) >= 0.3),
    gd as (select distinct chain_id, src, dst from vec_edges),
    pc as (select distinct * from pr),
    j as (select coalesce(p.chain_id, g.chain_id) as chain_id, p.src is not null as hp, g.src is not null as hg
          from pc p full join gd g on p.chain_id = g.chain_id and p.src = g.src and p.dst = g.dst),
    per as (select chain_id, sum((hp and hg)::int) as tp, sum((hp and not hg)::int) as fp, sum((not hp and hg)::int) as fn
            from j group by 1),
    m as (select chain_id, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r from per
          where chain_id in (select chain_id from gd))
    select round(avg(p), 6) + 0.0 as precision, round(avg(r), 6) + 0.0 as recall,
           round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 6) + 0.0 as f1, count(*) as n_chains
    from m""", "vec_steps", "vec_edges"))
def q_edge_eval(spark, sf_dir):
    v = vec_steps(spark, sf_dir)
    gold = v.filter(F.col("idx") >= 1).select("chain_id", (F.col("idx") - 1).alias("src"), F.col("idx").alias("dst"))
    return G.edge_set_eval(G.semantic_edges(v, 0.3), gold)


DIMS = 64  # of the embeddings table


def _each(text: str) -> str:
    return ", ".join(text.replace("#", str(i)).replace("@", str(i + 1)) for i in range(DIMS))


_NM_SQL = f"""
    h0 as (select chain_id, idx, {_each('embedding[@]::double as m#')} from vec_steps),
    g1 as (select e.chain_id, e.dst as idx, {_each('avg(h.m#) as a#')}
           from vec_edges e join h0 h on h.chain_id = e.chain_id and h.idx = e.src group by 1, 2),
    h1 as (select h.chain_id, h.idx, {_each('h.m# + coalesce(a#, 0) as m#')} from h0 h left join g1 using (chain_id, idx)),
    g2 as (select e.chain_id, e.dst as idx, {_each('avg(h.m#) as a#')}
           from vec_edges e join h1 h on h.chain_id = e.chain_id and h.idx = e.src group by 1, 2),
    h2 as (select h.chain_id, h.idx, {_each('h.m# + coalesce(a#, 0) as m#')} from h1 h left join g2 using (chain_id, idx))"""


def _nm(spark, sf_dir):
    v = vec_steps(spark, sf_dir)
    e = v.filter(F.col("idx") >= 1).select("chain_id", (F.col("idx") - 1).alias("src"), F.col("idx").alias("dst"))
    return G.neighbour_mean(v, e, "embedding", rounds=2)


def _spread(df, *keys):
    """One column an entry, rounded."""
    return df.select(*keys, *[r6(F.col("h")[i]).alias(f"m{i}") for i in range(DIMS)])


@register("neighbour_mean", "G17", with_views(f"""
    with {_NM_SQL}
    select chain_id, idx, {_each('round(m#, 6) + 0.0 as m#')} from h2""", "vec_steps", "vec_edges"))
def q_neighbour_mean(spark, sf_dir):
    return _spread(_nm(spark, sf_dir), "chain_id", "idx")


@register("graph_pool", "G18", with_views(f"""
    with {_NM_SQL}
    select chain_id, {_each('round(avg(m#), 6) + 0.0 as m#')} from h2 group by chain_id""", "vec_steps", "vec_edges"))
def q_graph_pool(spark, sf_dir):
    return _spread(G.mean_pool(_nm(spark, sf_dir)), "chain_id")


@register("attention_heatmap", "G19", with_views("""
    with att as (select e.chain_id, e.src, e.dst, m.model_type as head, m.node_prob as alpha
                 from order_edges e join order_model_scores m on m.chain_id = e.chain_id and m.idx = e.dst),
    pe as (select chain_id, src, dst, avg(alpha) as a from att group by 1, 2, 3),
    pn as (select chain_id, dst as idx, sum(a) as s from pe group by 1, 2)
    select s.chain_id, s.idx, round(coalesce(pn.s, 0), 6) + 0.0 as attention,
           'Step ' || cast(s.idx as varchar) || ': ' || s.text as label
    from order_steps s left join pn using (chain_id, idx)""", "order_edges", "order_model_scores", "order_steps"))
def q_attention_heatmap(spark, sf_dir):
    s = order_steps(spark, sf_dir)
    ms = order_model_scores(spark, sf_dir)
    attn = order_edges(s).join(ms.select("chain_id", F.col("idx").alias("dst"), F.col("model_type").alias("head"),
                                         F.col("node_prob").alias("alpha")), ["chain_id", "dst"])
    return G.attention_heatmap(attn, s)


# --- propagation ---------------------------------------------------------------

_PROP_SQL = """
    s as (select chain_id, count(*) as n, sum((not is_correct)::int) as ne, min(idx) filter (where is_origin) as tor
          from order_steps group by 1),
    p as (select chain_id, idx from order_scores where origin_prob > 0.5),
    pm as (select chain_id, min(idx) as por from p group by 1),
    he as (select distinct chain_id from order_edges),
    sm as (select s.*, pm.por, he.chain_id is not null as has_edges,
                  tor is not null and exists (select 1 from p where p.chain_id = s.chain_id and p.idx = s.tor) as detected,
                  tor is not null and por is not null as both_present
           from s left join pm using (chain_id) left join he using (chain_id)),
    g as (select chain_id, tor from sm where ne > 0 and has_edges and tor is not null),
    d(chain_id, node, dist) as (select chain_id, tor, 0 from g
                                union select d.chain_id, e.dst, d.dist + 1 from d join order_edges e
                                      on e.chain_id = d.chain_id and e.src = d.node where d.dist < 64),
    dm as (select chain_id, node, min(dist) as dist from d group by 1, 2),
    dj as (select dm.*, st.is_correct from dm join order_steps st on st.chain_id = dm.chain_id and st.idx = dm.node)"""


@register("propagation", "E1 E2 E3 E4", with_views(f"""
    with recursive {_PROP_SQL},
    r(chain_id, a, b) as (select e.chain_id, e.src, e.dst from order_edges e where e.chain_id in (select chain_id from g)
                          union select r.chain_id, r.a, e.dst from r join order_edges e on e.chain_id = r.chain_id and e.src = r.b),
    ip as (select distinct r.chain_id, r.a from r
           join order_steps x on x.chain_id = r.chain_id and x.idx = r.a and x.is_correct
           join order_steps y on y.chain_id = r.chain_id and y.idx = r.b and not y.is_correct),
    ct as (select chain_id, dist, avg((not is_correct)::int::double) as ratio from dj where dist > 0 group by 1, 2)
    select (select count(*) from sm) as total_graphs, (select count(*) from sm where ne > 0) as graphs_with_errors,
           round((select count(*) from sm where ne > 0 and detected) / greatest((select count(*) from sm where ne > 0), 1), 6) + 0.0
               as origin_detection_rate,
           round(coalesce((select avg(dist) from ct), 0), 6) + 0.0 as avg_propagation_distance,
           round(coalesce((select avg(ratio) from ct), 0), 6) + 0.0 as avg_contamination_ratio,
           (select count(*) from ip) as num_intervention_points""", "order_steps", "order_scores", "order_edges"))
def q_propagation(spark, sf_dir):
    s = order_steps(spark, sf_dir).select("chain_id", "idx", "domain", "model_type", "is_correct", "is_origin", "risk")
    s = cut_lineage(s)  # read by every section
    pred = step_scores(s).filter(F.col("origin_prob") > 0.5).select("chain_id", "idx")
    return E.propagation_summary(s, order_edges(s), pred)


@register("error_by_depth", "E5", with_views(f"""
    with recursive {_PROP_SQL}
    select cast(dist as bigint) as distance, count(*) as total, cast(sum((not is_correct)::int) as bigint) as errors,
           round(sum((not is_correct)::int) / count(*), 6) + 0.0 as ratio
    from dj group by dist""", "order_steps", "order_scores", "order_edges"))
def q_error_by_depth(spark, sf_dir):
    s = order_steps(spark, sf_dir)
    pred = order_scores(spark, sf_dir).filter(F.col("origin_prob") > 0.5).select("chain_id", "idx")
    summ = E.chain_summary(s, order_edges(s), pred)
    return E.depth_stats(E.origin_distances(summ, order_edges(s)), s)


@register("propagation_sample", "E6", with_views(f"""
    with recursive {_PROP_SQL}
    select chain_id as graph_id, n as num_nodes, cast(ne as bigint) as num_errors, both_present as origin_detected,
           detected as origin_in_pred, cast(coalesce(tor, -1) as bigint) as true_origin,
           cast(coalesce(por, -1) as bigint) as pred_origin
    from sm where ne > 0 and has_edges order by chain_id limit 20""", "order_steps", "order_scores", "order_edges"))
def q_propagation_sample(spark, sf_dir):
    s = order_steps(spark, sf_dir)
    pred = order_scores(spark, sf_dir).filter(F.col("origin_prob") > 0.5).select("chain_id", "idx")
    return E.per_graph_sample(E.chain_summary(s, order_edges(s), pred), 20)
