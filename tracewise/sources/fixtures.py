"""Long-form step views over the test tables (FIXTURES.md §B).

Each view maps a base table onto the chain/step data model so that every
operator runs on data whose size grows with the scale factor:

* ``order_steps``  – lineitem: chain = order, step = line
* ``order_edges``  – sequential (i, i+1) plus skip edges (i, i+2) for even i
* ``order_votes``  – three rule-based labellers per line (unpivot)
* ``event_steps``  – events: chain = user, ordered by (ts, event_id)
* ``doc_steps``    – documents split into non-blank stripped lines
* ``turn_steps``   – conversation rows split the same way
* ``vec_steps``    – embeddings: 10 consecutive vectors form a chain

``SQL_VIEWS`` holds the same views as DuckDB CTE bodies for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewise.functions.common import PY_WS, strip_ws
from tracewise.sources.tables import table

_ORDER_KEYS = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def order_lines(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """lineitem with a dense per-order position; one shuffle on l_orderkey (into ``partitions``, when given)."""
    li = table(spark, sf_dir, "lineitem")
    if partitions:
        li = li.repartition(partitions, "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER_KEYS)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wrong = F.when(F.col("l_returnflag") != "R", 0).otherwise(1)
    return li.select(
        F.col("l_orderkey").alias("chain_id"),
        (F.row_number().over(w) - 1).cast("long").alias("idx"),
        F.first("l_suppkey").over(run).alias("first_supp"),
        (F.col("l_returnflag") != "R").alias("is_correct"),
        F.sum(wrong).over(run).alias("run_wrong"),
        "l_linestatus", "l_discount", "l_tax", "l_partkey", "l_quantity", "l_returnflag",
    )


def order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = order_lines(spark, sf_dir)
    return x.select(
        "chain_id", "idx", F.col("idx").alias("step_id"),
        F.when(F.col("chain_id") % 3 == 0, "math").when(F.col("chain_id") % 3 == 1, "code")
         .otherwise("medical").alias("domain"),
        F.concat(F.lit("model_"), (F.col("first_supp") % 4).cast("string")).alias("model_type"),
        "is_correct",
        ((~F.col("is_correct")) & (F.col("run_wrong") == 1)).alias("is_origin"),
        F.when(F.col("is_correct"), F.lit(None).cast("string"))
         .when(F.col("l_linestatus") == "O", "factual").otherwise("logical").alias("error_type"),
        F.round(F.abs("l_discount") * 10, 6).alias("risk"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" qty "),
                 F.floor("l_quantity").cast("long").cast("string")).alias("text"),
    )


def order_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a chain, including the orders without lines (empty chains)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("chain_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "math").when(F.col("o_orderkey") % 3 == 1, "code")
         .otherwise("medical").alias("domain"))


def order_edges(steps: DataFrame) -> DataFrame:
    """Sequential edges plus skip edges from even positions (no join needed)."""
    seq = steps.filter(F.col("idx") >= 1).select("chain_id", (F.col("idx") - 1).alias("src"), F.col("idx").alias("dst"))
    skip = (steps.filter((F.col("idx") >= 2) & (F.col("idx") % 2 == 0))
            .select("chain_id", (F.col("idx") - 2).alias("src"), F.col("idx").alias("dst")))
    return seq.unionByName(skip)


def order_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three labellers per step, unpivoted to (chain_id, idx, model_type, pred)."""
    x = order_lines(spark, sf_dir)
    return x.select(
        "chain_id", "idx",
        F.inline(F.array(
            F.struct(F.lit("a").alias("model_type"), F.col("is_correct").alias("pred")),
            F.struct(F.lit("b").alias("model_type"), (F.col("l_discount") < 0.07).alias("pred")),
            F.struct(F.lit("c").alias("model_type"), (F.col("l_tax") < 0.06).alias("pred")),
        )))


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score table (chain_id, idx, node_prob, origin_prob, y, y_origin, domain).

    node_prob = 1 - risk (probability the step is correct); origin_prob = risk.
    """
    return step_scores(order_steps(spark, sf_dir))


def step_scores(s: DataFrame) -> DataFrame:
    """``order_scores`` of the steps at hand."""
    return s.select(
        "chain_id", "idx", "domain", "model_type",
        F.round(1 - F.col("risk"), 6).alias("node_prob"),
        F.col("risk").alias("origin_prob"),
        F.col("is_correct").cast("long").alias("y"),
        F.col("is_origin").cast("long").alias("y_origin"),
    )


def order_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-model score heads (chain_id, idx, model_type, model_order, node_prob, origin_prob)."""
    x = order_lines(spark, sf_dir)
    risk = F.round(F.abs("l_discount") * 10, 6)
    tax = F.round(F.col("l_tax") * 10, 6)
    qty = F.round(F.least(F.col("l_quantity") / 50, F.lit(1.0)), 6)
    return x.select(
        "chain_id", "idx",
        F.inline(F.array(
            F.struct(F.lit("a").alias("model_type"), F.lit(0).alias("model_order"),
                     F.round(1 - risk, 6).alias("node_prob"), risk.alias("origin_prob")),
            F.struct(F.lit("b").alias("model_type"), F.lit(1).alias("model_order"),
                     F.round(1 - tax, 6).alias("node_prob"), tax.alias("origin_prob")),
            F.struct(F.lit("c").alias("model_type"), F.lit(2).alias("model_order"),
                     qty.alias("node_prob"), F.round(1 - qty, 6).alias("origin_prob")),
        )))


def event_steps(spark: SparkSession, sf_dir: str, per_day: bool = False) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    if per_day:
        chain = F.col("user_id") * 100000 + F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    else:
        chain = F.col("user_id")
    ev = ev.withColumn("chain_id", chain.cast("long"))
    w = Window.partitionBy("chain_id").orderBy("ts", "event_id")
    return ev.select(
        "chain_id", (F.row_number().over(w) - 1).cast("long").alias("idx"),
        "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") != "error").alias("is_correct"),
        F.round(F.least(F.col("value") / 100, F.lit(1.0)), 6).alias("risk"),
    )


def _line_split(text_col: str):
    return F.filter(F.transform(F.split(F.col(text_col), "\n"), strip_ws), lambda s: s != "")


def doc_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("chain_id"), F.col("lang").alias("domain"), F.col("source").alias("model_type"),
        F.posexplode(_line_split("text")).alias("idx", "text"),
    ).select("chain_id", F.col("idx").cast("long").alias("idx"), "domain", "model_type", "text")


def turn_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id", "turn", "role", F.posexplode(_line_split("text")).alias("step_idx", "text"),
    ).select("conv_id", "turn", "role", F.col("step_idx").cast("long").alias("step_idx"), "text")


def _planted():
    """A line of mentions that change from turn to turn, by arithmetic on the ids."""
    number = F.pmod(F.col("conv_id") * 7 + F.col("turn") * F.col("turn"), F.lit(5)).cast("string")
    colour = F.element_at(F.array(F.lit("red"), F.lit("blue"), F.lit("green")), (F.pmod(F.col("conv_id") + F.col("turn") * 2, F.lit(3)) + 1).cast("int"))
    return F.concat(F.lit("budget = "), number, F.lit(" and plan is "), colour)


def mention_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``turn_steps`` with one more line a turn, the planted mentions."""
    return mention_lines(table(spark, sf_dir, "conversations"))


def mention_lines(conversations: DataFrame, *more: str) -> DataFrame:
    c = conversations.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), _planted()))
    return c.select("conv_id", "turn", "role", *more, F.posexplode(_line_split("text")).alias("step_idx", "text")).select(
        "conv_id", "turn", "role", *more, F.col("step_idx").cast("long").alias("step_idx"), "text")


def vec_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / 10).cast("long").alias("chain_id"),
        (F.col("vec_id") % 10).cast("long").alias("idx"),
        F.col("embedding").cast("array<double>").alias("embedding"), "label",
    )


# ---------------------------------------------------------------------------
# DuckDB twins of the views (oracle side).  Dependencies listed per view.
# ---------------------------------------------------------------------------

SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "order_base": ((), """
        select l_orderkey as chain_id,
               row_number() over w - 1 as idx,
               first_value(l_suppkey) over w as first_supp,
               l_returnflag <> 'R' as is_correct,
               sum(case when l_returnflag <> 'R' then 0 else 1 end) over (w rows between unbounded preceding and current row) as run_wrong,
               l_linestatus, l_discount, l_tax, l_partkey, l_quantity, l_returnflag
        from lineitem
        window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)"""),
    "order_steps": (("order_base",), """
        select chain_id, idx, idx as step_id,
               case chain_id % 3 when 0 then 'math' when 1 then 'code' else 'medical' end as domain,
               'model_' || cast(first_supp % 4 as varchar) as model_type,
               is_correct,
               (not is_correct) and run_wrong = 1 as is_origin,
               case when is_correct then null when l_linestatus = 'O' then 'factual' else 'logical' end as error_type,
               round(abs(l_discount) * 10, 6) as risk,
               'part ' || cast(l_partkey as varchar) || ' qty ' || cast(cast(floor(l_quantity) as bigint) as varchar) as text
        from order_base"""),
    "order_chains": ((), """
        select o_orderkey as chain_id,
               case o_orderkey % 3 when 0 then 'math' when 1 then 'code' else 'medical' end as domain
        from orders"""),
    "order_edges": (("order_steps",), """
        select chain_id, idx - 1 as src, idx as dst from order_steps where idx >= 1
        union all
        select chain_id, idx - 2 as src, idx as dst from order_steps where idx >= 2 and idx % 2 = 0"""),
    "order_votes": (("order_base",), """
        select chain_id, idx, 'a' as model_type, is_correct as pred from order_base
        union all select chain_id, idx, 'b', l_discount < 0.07 from order_base
        union all select chain_id, idx, 'c', l_tax < 0.06 from order_base"""),
    "order_scores": (("order_steps",), """
        select chain_id, idx, domain, model_type, round(1 - risk, 6) as node_prob, risk as origin_prob,
               cast(is_correct as bigint) as y, cast(is_origin as bigint) as y_origin
        from order_steps"""),
    "order_model_scores": (("order_base",), """
        select chain_id, idx, 'a' as model_type, 0 as model_order, round(1 - round(abs(l_discount) * 10, 6), 6) as node_prob,
               round(abs(l_discount) * 10, 6) as origin_prob from order_base
        union all
        select chain_id, idx, 'b', 1, round(1 - round(l_tax * 10, 6), 6), round(l_tax * 10, 6) from order_base
        union all
        select chain_id, idx, 'c', 2, round(least(l_quantity / 50, 1.0), 6), round(1 - round(least(l_quantity / 50, 1.0), 6), 6)
        from order_base"""),
    "event_steps": ((), """
        select user_id as chain_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx,
               user_id, event_id, ts, event_type <> 'error' as is_correct, round(least(value / 100, 1.0), 6) as risk
        from events"""),
    "event_day_steps": ((), """
        select user_id * 100000 + (cast(ts as date) - date '1970-01-01') as chain_id,
               row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) - 1 as idx,
               user_id, event_id, ts, event_type <> 'error' as is_correct, round(least(value / 100, 1.0), 6) as risk
        from events"""),
    "doc_steps": ((), """
        select chain_id, unnest(l) as text, unnest(range(len(l))) as idx, domain, model_type
        from (select doc_id as chain_id, lang as domain, source as model_type,
                     list_filter(list_transform(string_split(text, chr(10)),
                                 lambda s: regexp_replace(s, '^{PY_WS}+|{PY_WS}+$', '', 'g')), lambda s: s <> '') as l
              from documents)"""),
    "turn_steps": ((), """
        select conv_id, turn, role, unnest(l) as text, unnest(range(len(l))) as step_idx
        from (select conv_id, turn, role,
                     list_filter(list_transform(string_split(text, chr(10)),
                                 lambda s: regexp_replace(s, '^{PY_WS}+|{PY_WS}+$', '', 'g')), lambda s: s <> '') as l
              from conversations)"""),
    "mention_steps": ((), """
        select conv_id, turn, role, unnest(l) as text, unnest(range(len(l))) as step_idx
        from (select conv_id, turn, role,
                     list_filter(list_transform(string_split(coalesce(text, '') || chr(10) || 'budget = '
                                     || cast((conv_id * 7 + turn * turn) % 5 as varchar) || ' and plan is '
                                     || ['red', 'blue', 'green'][((conv_id + turn * 2) % 3) + 1], chr(10)),
                                 lambda s: regexp_replace(s, '^{PY_WS}+|{PY_WS}+$', '', 'g')), lambda s: s <> '') as l
              from conversations)"""),
    "vec_steps": ((), """
        select cast(floor(vec_id / 10) as bigint) as chain_id, vec_id % 10 as idx,
               cast(embedding as double[]) as embedding, label
        from embeddings"""),
}


for _k, (_deps, _sql) in list(SQL_VIEWS.items()):
    SQL_VIEWS[_k] = (_deps, _sql.replace("{PY_WS}", PY_WS))


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it needs (dependencies first)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in SQL_VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in order)
    body = sql.strip()
    low = body.lower()
    if low.startswith("with recursive "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if low.startswith("with "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
