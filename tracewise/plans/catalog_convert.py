"""Conversion (C1–C11) and response-parsing (P2) queries.

The raw corpora of the reference are stood in from the test tables; the
builders below only arrange rows into the raw schemas:

* math ratings   – one record per order: line texts as pre-generated steps,
  rating from the return flag (R -> -1, A -> 1, else 0), no completions when
  the quantity is below 5, label steps one shorter for every 5th order
* code           – document text as the source code
* medical QA     – answer = a conversation turn, truth = the next turn
* chat           – the conversations table as message logs
* free text      – document text
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewise.functions.common import PY_WS
from tracewise.operators import convert, validate
from tracewise.plans.registry import register
from tracewise.sources.fixtures import SQL_VIEWS, order_lines, with_views
from tracewise.sources.tables import table

_STRIP = f"regexp_replace(s, '^{PY_WS}+|{PY_WS}+$', '', 'g')"


def math_raw(spark, sf_dir, partitions=None, keep=()):
    """The raw records of the orders; ``keep`` names columns of the lines that are the same in all lines of an order."""
    x = order_lines(spark, sf_dir, partitions)
    rating = F.when(F.col("l_returnflag") == "R", -1).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    text = F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" qty "),
                    F.floor("l_quantity").cast("long").cast("string"))
    rows = x.select("chain_id", F.struct("idx", text.alias("t"), rating.alias("r"), F.col("l_quantity").alias("q")).alias("s"), *keep)
    g = rows.groupBy("chain_id").agg(F.array_sort(F.collect_list("s")).alias("ls"), *[F.first(c).alias(c) for c in keep])
    labels = F.when(F.col("chain_id") % 5 == 0, F.slice("ls", 1, F.size("ls") - 1)).otherwise(F.col("ls"))
    comp = F.transform(labels, lambda s: F.struct(F.when(s["q"] < 5, F.array().cast("array<struct<rating:int>>"))
                                                  .otherwise(F.array(F.struct(s["r"].cast("int").alias("rating"))))
                                                  .alias("completions")))
    return g.select(F.col("chain_id").cast("string").alias("query_id"),
                    F.struct(F.concat(F.lit("order "), F.col("chain_id").cast("string")).alias("problem"),
                             F.lit("").alias("ground_truth_answer"),
                             F.transform("ls", lambda s: s["t"]).alias("pre_generated_steps")).alias("question"),
                    F.struct(comp.alias("steps")).alias("label"), *keep)


SQL_VIEWS.update({
    "math_in": (("order_base",), """
        select chain_id, idx, 'part ' || cast(l_partkey as varchar) || ' qty ' || cast(cast(floor(l_quantity) as bigint) as varchar)
                   as text,
               case l_returnflag when 'R' then -1 when 'A' then 1 else 0 end as rating, l_quantity,
               count(*) over (partition by chain_id) as n
        from order_base"""),
    "math_steps": (("math_in",), """
        select cast(chain_id as varchar) as chain_id, row_number() over (partition by chain_id order by idx) - 1 as idx,
               idx as step_id, text, rating = 1 as is_correct,
               idx = min(case when rating = -1 then idx end) over (partition by chain_id) and rating = -1 as is_origin,
               case when rating = 1 then null else 'logical' end as error_type,
               case when idx > 0 then cast(idx - 1 as varchar) else '' end as depends_on
        from math_in where not (chain_id % 5 = 0 and idx = n - 1) and l_quantity >= 5"""),
})


def _long_out(chains):
    lg = convert.to_long(chains)
    return lg.select("chain_id", "idx", F.col("step_id").cast("long").alias("step_id"), "text", "is_correct",
                     F.coalesce("is_origin", F.lit(False)).alias("is_origin"), "error_type",
                     F.array_join("depends_on", ",").alias("depends_on"))


@register("math_conversion", "C1", with_views("select * from math_steps", "math_steps"))
def q_math_conversion(spark, sf_dir):
    return _long_out(convert.convert_math(math_raw(spark, sf_dir)))


@register("conversion_stats", "C11 V1", with_views("""
    with ids as (select chain_id, step_id from math_steps),
    nodes as (select chain_id, idx as node from math_steps),
    bad as (select chain_id from ((select chain_id, step_id from ids except select chain_id, node from nodes)
                                  union all (select chain_id, node from nodes except select chain_id, step_id from ids))
            union
            select m.chain_id from math_steps m where m.depends_on <> ''
              and not exists (select 1 from ids i where i.chain_id = m.chain_id and i.step_id = cast(m.depends_on as bigint))),
    ch as (select distinct cast(chain_id as varchar) as chain_id from order_base)
    select count(*) as total, count(*) filter (where chain_id not in (select chain_id from bad)) as converted,
           count(*) filter (where chain_id not in (select chain_id from bad)) as valid,
           count(*) filter (where chain_id in (select chain_id from bad)) as invalid
    from ch""", "math_steps", "order_base"))
def q_conversion_stats(spark, sf_dir):
    return convert.conversion_stats(*_converted(spark, sf_dir)).drop("messages")


@register("valid_conversion", "C11", with_views("""
    with ids as (select chain_id, step_id from math_steps),
    nodes as (select chain_id, idx as node from math_steps),
    bad as (select chain_id from ((select chain_id, step_id from ids except select chain_id, node from nodes)
                                  union all (select chain_id, node from nodes except select chain_id, step_id from ids))
            union
            select m.chain_id from math_steps m where m.depends_on <> ''
              and not exists (select 1 from ids i where i.chain_id = m.chain_id and i.step_id = cast(m.depends_on as bigint)))
    select distinct cast(chain_id as varchar) as chain_id from order_base
    where cast(chain_id as varchar) not in (select chain_id from bad)""", "math_steps", "order_base"))
def q_valid_conversion(spark, sf_dir):
    return convert.valid_chains(*_converted(spark, sf_dir))


def _converted(spark, sf_dir):
    """Ids of all converted chains, and the validation messages about them."""
    from tracewise.session import cut_lineage
    # every validation rule reads the converted chains: build them once
    # (the rules judge ids, labels and dependencies; texts need not be kept for them)
    fields = ["step_id", "is_correct", "is_origin", "depends_on"]
    steps = F.transform("reasoning_steps", lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    chains = convert.convert_math(math_raw(spark, sf_dir)).select("domain", "query_id", steps.alias("reasoning_steps"), "dependency_graph")
    chains = cut_lineage(chains)
    lg = convert.to_long(chains, fields=fields).withColumn("depends_on", F.col("depends_on").cast("array<bigint>"))
    nodes = chains.select(F.col("query_id").alias("chain_id"), F.explode("dependency_graph.nodes").alias("node"))
    edges = chains.select(F.col("query_id").alias("chain_id"), F.explode("dependency_graph.edges").alias("edge"))
    msgs = validate.validation_messages(lg.withColumn("step_id", F.col("step_id").cast("long")),
                                        nodes.withColumn("node", F.col("node").cast("long")),
                                        edges.withColumn("edge", F.col("edge").cast("array<bigint>")))
    return chains.select(F.col("query_id").alias("chain_id")), msgs


_DOC_LINES = f"""
    dl as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: {_STRIP}),
                                       lambda s: s <> '' and not starts_with(s, '#')) as l from documents)"""


@register("line_steps", "C2", with_views(f"""
    with {_DOC_LINES}
    select doc_id, unnest(range(len(l))) as idx, unnest(l) as text from dl"""))
def q_line_steps(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(convert.code_lines(F.col("text"))).alias("idx", "text")).select(
        "doc_id", F.col("idx").cast("long").alias("idx"), "text")


@register("error_variants", "C3 C4", with_views(f"""
    with {_DOC_LINES},
    x as (select doc_id, unnest(range(len(l))) as i, unnest(l) as t, len(l) as n from dl)
    select cast(doc_id as varchar) as chain_id, i as idx, t as text, true as is_correct, false as is_origin,
           null::varchar as error_type from x
    union all
    select cast(doc_id as varchar) || '_variant', i, case when i = n // 2 then t || ' [ERROR: Incorrect logic]' else t end,
           i < n // 2, i = n // 2, case when i >= n // 2 then 'logical' end
    from x where n > 2"""))
def q_error_variants(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = d.count()  # C4 needs the problem count for the augmentation factor (one number)
    chains = convert.convert_code(d.withColumn("q", F.lit("")).withColumn("g", F.lit("")), "text", "doc_id", "q", "g",
                                  augment_to=2 * n, n_problems=n)
    lg = convert.to_long(chains)
    return lg.select("chain_id", "idx", "text", "is_correct", "is_origin", "error_type")


@register("nested_roundtrip", "", with_views("""
    select cast(chain_id as varchar) as chain_id, idx, domain, cast(idx as bigint) as step_id, text, is_correct, is_origin, error_type,
           case when idx > 0 then cast(idx - 1 as varchar) else '' end as depends_on from order_steps""", "order_steps"))
def q_nested_roundtrip(spark, sf_dir):
    """The steps nested into one record a chain and unnested again."""
    from tracewise.sources.fixtures import order_steps

    s = order_steps(spark, sf_dir)
    deps = F.when(F.col("idx") > 0, F.array((F.col("idx") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    back = convert.to_long(convert.to_nested(s.withColumn("step_id", F.col("idx").cast("int")).withColumn("depends_on", deps)))
    return back.select("chain_id", "idx", "domain", F.col("step_id").cast("long").alias("step_id"), "text", "is_correct", "is_origin", "error_type",
                       F.array_join("depends_on", ",").alias("depends_on"))


def medical_raw(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("answer"), F.col("role").alias("category"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("truth"))
    return a.join(b, ["conv_id", "turn"]).select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"),
        F.col("conv_id").cast("string").alias("question"), "answer", "truth", "category")


@register("sentence_grounding", "C5 C6", with_views(f"""
    with p as (select a.conv_id || '_' || a.turn as qid, a.text as answer, b.text as truth, a.role as category
               from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1),
    s as (select qid, answer, truth, category,
                 list_filter(list_transform(string_split(answer, '.'), lambda s: {_STRIP}), lambda s: s <> '') as a,
                 list_transform(list_filter(list_transform(string_split(truth, '.'), lambda s: {_STRIP}), lambda s: s <> ''),
                                lambda s: lower(s)) as t
          from p),
    x as (select qid, category, t, unnest(range(len(a))) as i, unnest(a) as sent from s where len(a) > 0),
    y as (select qid, category, i, sent,
                 len(list_filter(t, lambda g: contains(lower(sent), g) or contains(g, lower(sent)))) > 0 as ok from x),
    z as (select *, min(case when not ok then i end) over (partition by qid) as fb from y)
    select qid as chain_id, i as idx, sent as text, ok as is_correct, coalesce(i = fb, false) as is_origin,
           case when not ok then (case when contains(lower(category), 'factual') then 'factual'
                                       when contains(lower(category), 'logical') then 'logical' else 'factual' end) end
               as error_type
    from z
    union all
    select qid, 0, answer, lower(answer) = lower(truth), lower(answer) <> lower(truth),
           case when lower(answer) <> lower(truth) then 'factual' end
    from s where len(a) = 0"""))
def q_sentence_grounding(spark, sf_dir):
    ch = convert.convert_medical(medical_raw(spark, sf_dir), "qid", "question", "answer", "truth", "category")
    return convert.to_long(ch).select("chain_id", "idx", "text", "is_correct", "is_origin", "error_type")


@register("chat_to_chain", "C7", with_views(f"""
    with m as (select conv_id, turn, role, text,
                      last_value(case when role = 'user' then coalesce(text, '') end ignore nulls)
                          over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as lu,
                      count(*) over (partition by conv_id) as nm
               from conversations),
    f as (select conv_id, arg_min(text, turn) as resp, arg_min(lu, turn) as q from m
          where role = 'assistant' and coalesce(lu, '') <> '' and nm >= 2 group by conv_id),
    g as (select conv_id, q, coalesce(resp, '') as resp,
                 list_filter(list_transform(string_split(coalesce(resp, ''), chr(10)), lambda s: {_STRIP}), lambda s: s <> '') as l
          from f where coalesce(resp, '') <> ''),
    h as (select conv_id, q, case when len(l) > 0 then l else [resp] end as l from g)
    select cast(conv_id as varchar) as chain_id, unnest(range(len(l))) as idx, unnest(l) as text, q as query
    from h"""))
def q_chat_to_chain(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    ch = convert.chat_to_chain(c)
    ts = F.transform("reasoning_steps", lambda s, i: F.struct(i.cast("long").alias("idx"), s["text"].alias("text")))
    return ch.select(F.col("query_id").alias("chain_id"), "query", F.inline(ts)).select("chain_id", "idx", "text", "query")


@register("text_to_chain", "C8", with_views(f"""
    with p as (select doc_id, text,
                      list_filter(list_transform(regexp_split_to_array(text, '\\n|\\p{{Nd}}+\\.{PY_WS}'), lambda s: {_STRIP}),
                                  lambda s: s <> '') as l from documents),
    q as (select doc_id, text as query, case when len(l) > 0 then l else [text] end as l from p)
    select cast(doc_id as varchar) as chain_id, unnest(range(len(l))) as idx, unnest(l) as text, query from q"""))
def q_text_to_chain(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ch = convert.text_to_chain(d, "text", "doc_id")
    ts = F.transform("reasoning_steps", lambda s, i: F.struct(i.cast("long").alias("idx"), s["text"].alias("text")))
    return ch.select(F.col("query_id").alias("chain_id"), "query", F.inline(ts)).select("chain_id", "idx", "text", "query")


@register("live_chain", "C9", with_views(f"""
    with t as (select conv_id || '_' || turn as chain_id, role,
                      list_filter(list_transform(string_split(text, chr(10)), lambda s: {_STRIP}), lambda s: s <> '') as l
               from conversations),
    e as (select chain_id, case when len(l) = 1 then [[0, 0]]
                                when len(l) > 1 then list_transform(range(len(l) - 1), lambda i: [i, i + 1])
                                else [] end as edges from t)
    select chain_id, unnest(edges)[1] as src, unnest(edges)[2] as dst from e"""))
def q_live_chain(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    lines = F.filter(F.transform(F.split("text", "\n"), convert.strip_ws), lambda s: s != "")
    src = c.select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("cid"),
                   lines.alias("steps"), F.col("role").alias("dom"))
    ch = convert.steps_to_chain(src, "steps", "cid", "dom")
    return ch.select(F.col("query_id").alias("chain_id"), F.explode("dependency_graph.edges").alias("e")).select(
        "chain_id", F.col("e")[0].cast("long").alias("src"), F.col("e")[1].cast("long").alias("dst"))


@register("turn_chain_edges", "C10", with_views("""
    with s as (select conv_id || '_' || turn as chain_id, step_idx from turn_steps)
    select chain_id, step_idx - 1 as src, step_idx as dst from s where step_idx > 0""", "turn_steps"))
def q_turn_chain_edges(spark, sf_dir):
    from tracewise.sources.fixtures import turn_steps
    t = turn_steps(spark, sf_dir)
    st = t.select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chain_id"),
                  F.col("step_idx").alias("idx"), F.col("step_idx").alias("step_id"),
                  F.lit(None).cast("array<bigint>").alias("depends_on"))
    return convert.turn_edges(st)


@register("response_steps", "P2", with_views(f"""
    with r as (select conv_id, turn, text from conversations where role = 'assistant'),
    l as (select conv_id, turn, text, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as pos
          from r),
    l2 as (select *, regexp_replace(raw, '^{PY_WS}+|{PY_WS}+$', '', 'g') as line from l),
    l3 as (select *, starts_with(line, 'Step ') or starts_with(line, 'Final Answer:') as st from l2),
    l4 as (select *, sum(st::int) over (partition by conv_id, turn order by pos) as grp from l3),
    hd as (select conv_id, turn, grp,
                  case when contains(line, ':') then regexp_replace(substr(line, instr(line, ':') + 1), '^{PY_WS}+|{PY_WS}+$', '', 'g')
                       else line end as head
           from l4 where st),
    body as (select l4.conv_id, l4.turn, l4.grp, string_agg(' ' || l4.line, '' order by l4.pos) as tail
             from l4 where not st and grp > 0 group by 1, 2, 3),
    steps as (select hd.conv_id, hd.turn, hd.grp,
                     regexp_replace(hd.head || coalesce(body.tail, ''), '^{PY_WS}+|{PY_WS}+$', '', 'g') as step
              from hd left join body using (conv_id, turn, grp) where hd.head <> ''),
    ns as (select conv_id, turn, count(*) as n from steps group by 1, 2),
    alt as (select r.conv_id, r.turn, unnest(list_filter(list_transform(string_split(r.text, chr(10) || chr(10)),
                                                                   lambda s: {_STRIP}), lambda s: s <> '' and length(s) > 10)) as step,
                   unnest(range(len(list_filter(list_transform(string_split(r.text, chr(10) || chr(10)), lambda s: {_STRIP}),
                                                lambda s: s <> '' and length(s) > 10)))) as k
            from r where not exists (select 1 from ns where ns.conv_id = r.conv_id and ns.turn = r.turn)),
    na as (select conv_id, turn from alt group by 1, 2)
    select conv_id, turn, row_number() over (partition by conv_id, turn order by grp) - 1 as idx, step as text from steps
    union all select conv_id, turn, k, step from alt
    union all select conv_id, turn, 0, regexp_replace(text, '^{PY_WS}+|{PY_WS}+$', '', 'g') from r
        where not exists (select 1 from ns where ns.conv_id = r.conv_id and ns.turn = r.turn)
          and not exists (select 1 from na where na.conv_id = r.conv_id and na.turn = r.turn)"""))
def q_response_steps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return c.select("conv_id", "turn", F.posexplode(convert.parse_response("text")).alias("idx", "text")).select(
        "conv_id", "turn", F.col("idx").cast("long").alias("idx"), "text")
