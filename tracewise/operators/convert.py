"""Corpus conversion into the chain data model (C1–C11) and response
parsing (P2, P11–P13).

Every converter is a per-row projection with higher-order array functions
(``transform``, ``filter``, ``aggregate``): a raw record becomes one chain
row without any shuffle.  ``to_long`` explodes chains into the long step
table the other operators use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions.common import PY_WS, strip_ws
from tracewise.schema import STEP_FIELDS

ERROR_SUFFIX = " [ERROR: Incorrect logic]"


def _seq_edges(n) -> F.Column:
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.array(i, i + 1))).otherwise(
        F.array().cast("array<array<int>>"))


def _deps(i) -> F.Column:
    return F.when(i > 0, F.array(i - 1)).otherwise(F.array().cast("array<int>"))


def _step(step_id, text, is_correct, is_origin, error_type, depends_on) -> F.Column:
    return F.struct(step_id.cast("int").alias("step_id"), text.alias("text"), is_correct.alias("is_correct"),
                    is_origin.alias("is_origin"), error_type.cast("string").alias("error_type"),
                    depends_on.cast("array<int>").alias("depends_on"))


def _chain(domain, query_id, query, truth, steps, edges) -> list[F.Column]:
    n = F.size(steps)
    return [domain.alias("domain"), query_id.cast("string").alias("query_id"), query.alias("query"),
            truth.alias("ground_truth"), steps.alias("reasoning_steps"),
            F.struct(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")).alias("nodes"),
                     edges.alias("edges")).alias("dependency_graph")]


def to_long(chains: DataFrame, id_col: str = "query_id", fields: list[str] = STEP_FIELDS) -> DataFrame:
    """Nested chains -> (chain_id, idx, domain, step fields...), all ``fields`` or those asked for.

    ``inline`` over structs that already carry the position: selecting fields
    after ``posexplode`` lets the optimizer push each field extraction into
    the generator input, re-evaluating the step array once per field."""
    withidx = F.transform("reasoning_steps", lambda s, i: F.struct(i.cast("long").alias("idx"),
                                                                  *[s[f].alias(f) for f in fields]))
    return chains.select(F.col(id_col).alias("chain_id"), "domain", F.inline(withidx)).select(
        "chain_id", "idx", "domain", *fields)


def to_nested(steps: DataFrame, id_col: str = "chain_id") -> DataFrame:
    """(chain_id, idx, step fields..., domain) -> one nested chain row per chain,
    the other half of the bridge: steps in ``idx`` order, nodes 0..n-1 and an edge
    from each dependency to its step.  A chain's steps meet in one row, as the
    nested record asks."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", *STEP_FIELDS)))
    g = steps.groupBy(F.col(id_col).cast("string").alias("query_id"), "domain").agg(ordered.alias("_s"))
    rows = F.transform("_s", lambda s: F.struct(*[s[f].alias(f) for f in STEP_FIELDS]))
    edges = F.flatten(F.transform("_s", lambda s: F.transform(s["depends_on"], lambda d: F.array(d, s["step_id"]))))
    return g.select("domain", "query_id", rows.alias("reasoning_steps"),
                    F.struct(F.transform("_s", lambda s, i: i).alias("nodes"), edges.alias("edges")).alias("dependency_graph"))


# ---------------------------------------------------------------------------
# C1 math step ratings
# ---------------------------------------------------------------------------

def convert_math(raw: DataFrame, id_col: str = "query_id", keep=()) -> DataFrame:
    """Zip pre-generated steps with label steps (shorter wins), skip steps
    without completions, rating = completions[0].rating; correct iff 1;
    origin = first -1; every non-correct step (0 included) is 'logical';
    step_id and depends_on keep the original index i (gaps stay, T1);
    nodes 0..kept-1 and sequential edges over kept steps.  Columns named in
    ``keep`` go along."""
    pre = F.col("question.pre_generated_steps")
    lab = F.col("label.steps")
    n = F.least(F.size(pre), F.size(lab))
    z = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1),
                                  lambda i: F.struct(i.alias("i"), F.element_at(pre, i + 1).alias("t"),
                                                     F.element_at(lab, i + 1)["completions"].alias("c")))
               ).otherwise(F.array().cast("array<struct<i:int,t:string,c:array<struct<rating:int>>>>"))
    kept = F.filter(z, lambda s: F.coalesce(F.size(s["c"]), F.lit(0)) > 0)
    rated = F.transform(kept, lambda s: F.struct(s["i"].alias("i"), s["t"].alias("t"),
                                                 F.element_at(s["c"], 1)["rating"].alias("r")))
    # stage the arrays: a lambda must only touch materialised columns, or the
    # whole array expression is re-evaluated for every element
    st = raw.select(F.col(id_col).alias("_id"), F.col("question.problem").alias("_q"),
                    F.col("question.ground_truth_answer").alias("_gt"), rated.alias("_rated"), *keep)
    st = st.withColumn("_origin", F.array_min(F.transform(F.filter("_rated", lambda s: s["r"] == -1), lambda s: s["i"])))
    origin = F.col("_origin")
    steps = F.transform("_rated", lambda s: _step(
        s["i"], s["t"], F.coalesce(s["r"] == 1, F.lit(False)), F.coalesce(s["i"] == origin, F.lit(False)),
        F.when(F.coalesce(s["r"] == 1, F.lit(False)), F.lit(None)).otherwise(F.lit("logical")), _deps(s["i"])))
    return st.select(*_chain(F.lit("math"), F.col("_id"), F.col("_q"), F.col("_gt"), steps, _seq_edges(F.size("_rated"))), *keep)


# ---------------------------------------------------------------------------
# C2–C4 code
# ---------------------------------------------------------------------------

def code_lines(code, step_chars: int | None = None) -> F.Column:
    """Non-blank, non-comment stripped lines; ``step_chars`` cuts each to
    that many characters (the reference shows 100; default whole lines)."""
    lines = F.transform(F.split(code, "\n"), strip_ws)
    keep = F.filter(lines, lambda s: (s != "") & ~s.startswith("#"))
    return keep if step_chars is None else F.transform(keep, lambda s: F.substring(s, 1, step_chars))


def convert_code(raw: DataFrame, code_col: str, id_col: str, query_col: str, truth_col: str,
                 augment_to: int | None = None, n_problems: int | None = None, step_chars: int | None = None) -> DataFrame:
    """C2 + C3 + C4: one correct chain per problem; when augmenting
    (factor = augment_to // n + 1 > 1) an error variant is added for chains
    with more than 2 steps: step n//2 gets the error suffix and becomes the
    logical origin, every later step is wrong (logical, not origin); the
    variant id gets '_variant'.  At most ``factor`` chains per problem."""
    st = raw.select(F.col(id_col).alias("_id"), F.col(query_col).alias("_q"), F.col(truth_col).alias("_gt"),
                    code_lines(F.col(code_col), step_chars).alias("_lines"))
    lines = F.col("_lines")
    steps = F.transform(lines, lambda t, i: _step(i, t, F.lit(True), F.lit(False), F.lit(None), _deps(i)))
    base = st.select(*_chain(F.lit("code"), F.col("_id"), F.col("_q"), F.col("_gt"), steps,
                             _seq_edges(F.size(lines))), F.lit(0).alias("_v"))
    factor = 1
    if augment_to and n_problems is not None and n_problems < augment_to:
        factor = augment_to // n_problems + 1
    if factor <= 1:
        return base.drop("_v")
    stv = st.filter(F.size(lines) > 2).withColumn("_mid", F.floor(F.size(lines) / 2).cast("int"))
    mid = F.col("_mid")
    vsteps = F.transform(lines, lambda t, i: _step(
        i, F.when(i == mid, F.concat(t, F.lit(ERROR_SUFFIX))).otherwise(t),
        i < mid, i == mid, F.when(i >= mid, F.lit("logical")), _deps(i)))
    var = stv.select(*_chain(F.lit("code"), F.concat(F.col("_id").cast("string"), F.lit("_variant")), F.col("_q"),
                             F.col("_gt"), vsteps, _seq_edges(F.size(lines))), F.lit(1).alias("_v"))
    out = base.unionByName(var)
    return out.filter(F.col("_v") < factor).drop("_v")


# ---------------------------------------------------------------------------
# C5 + C6 medical grounding
# ---------------------------------------------------------------------------

def _sentences(x) -> F.Column:
    return F.filter(F.transform(F.split(x, "\\."), strip_ws), lambda s: s != "")


def convert_medical(raw: DataFrame, id_col: str, question: str, answer: str, truth: str, category: str) -> DataFrame:
    """C5 + C6: answer and truth split on '.', stripped, blanks dropped; a
    step is correct when any truth sentence contains it or is contained in
    it (case-insensitive, a theta test inside the row); the first incorrect
    step is the origin; error type from the category ('factual' first, then
    'logical', else factual).  No sentence -> one step, correct iff the
    lower-cased answer equals the truth."""
    st = raw.select(F.col(id_col).alias("_id"), F.col(question).alias("_qq"), F.col(answer).alias("_ans"),
                    F.col(truth).alias("_tr"), F.col(category).alias("_cat"), _sentences(F.col(answer)).alias("_a"),
                    F.transform(_sentences(F.col(truth)), lambda s: F.lower(s)).alias("_t"))
    st = st.withColumn("_ok", F.transform("_a", lambda s: F.exists("_t", lambda g: F.lower(s).contains(g) | g.contains(F.lower(s)))))
    st = st.withColumn("_fb", F.array_position("_ok", F.lit(False)))  # 1-based, 0 if none
    cat = F.lower(F.coalesce(F.col("_cat"), F.lit("")))
    st = st.withColumn("_et", F.when(cat.contains("factual"), "factual").when(cat.contains("logical"), "logical")
                       .otherwise("factual"))
    ok, fb, et = F.col("_ok"), F.col("_fb"), F.col("_et")
    steps = F.transform("_a", lambda s, i: _step(i, s, F.element_at(ok, i + 1), (fb > 0) & (i + 1 == fb),
                                                 F.when(~F.element_at(ok, i + 1), et), _deps(i)))
    single_ok = F.lower(F.col("_ans")) == F.lower(F.col("_tr"))
    single = F.array(_step(F.lit(0), F.col("_ans"), single_ok, ~single_ok, F.when(~single_ok, F.lit("factual")),
                           F.array().cast("array<int>")))
    final = F.when(F.size("_a") > 0, steps).otherwise(single)
    return st.select(*_chain(F.lit("medical"), F.col("_id"), F.col("_qq"), F.col("_tr"), final,
                             _seq_edges(F.when(F.size("_a") > 0, F.size("_a")).otherwise(1))))


# ---------------------------------------------------------------------------
# C7 chat -> chain, C8 free text -> chain, C9/C10 step lists -> chain
# ---------------------------------------------------------------------------

def _head(c, chars: int | None) -> F.Column:
    return c if chars is None else F.substring(c, 1, chars)


def chat_to_chain(messages: DataFrame, conv_col: str = "conv_id", order_col: str = "turn",
                  query_chars: int | None = None) -> DataFrame:
    """C7 on a long message table (conv, order, role, text): the response is
    the first assistant message whose most recent preceding user message is
    non-empty; query = that user message (its first ``query_chars`` characters
    when given, 200 in the reference); steps = non-blank stripped
    response lines, else the whole response; all correct; sequential.
    Conversations with fewer than 2 messages or an empty response are
    dropped.  Running window frames only (no collection per conversation)."""
    w = Window.partitionBy(conv_col).orderBy(order_col)
    m = messages.select(conv_col, order_col, "role", "text",
                        F.last(F.when(F.col("role") == "user", F.coalesce(F.col("text"), F.lit(""))), ignorenulls=True)
                        .over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("last_user"))
    m = m.join(messages.groupBy(conv_col).agg(F.count(F.lit(1)).alias("n_msgs")), conv_col)
    cand = m.filter((F.col("role") == "assistant") & (F.coalesce(F.col("last_user"), F.lit("")) != "") & (F.col("n_msgs") >= 2))
    first = cand.groupBy(conv_col).agg(F.min(F.struct(order_col, "text", "last_user")).alias("r"))
    resp = F.coalesce(F.col("r.text"), F.lit(""))
    lines = F.filter(F.transform(F.split(resp, "\n"), strip_ws), lambda s: s != "")
    texts = F.when(F.size(lines) > 0, lines).otherwise(F.array(resp))
    steps = F.transform(texts, lambda t, i: _step(i, t, F.lit(True), F.lit(False), F.lit(None), _deps(i)))
    return (first.filter(resp != "")
            .select(*_chain(F.lit("math"), F.col(conv_col), _head(F.col("r.last_user"), query_chars), F.lit(""), steps,
                            _seq_edges(F.size(texts)))))


def text_to_chain(df: DataFrame, text_col: str, id_col: str, query_chars: int | None = None) -> DataFrame:
    """Split on newline or 'N. '; stripped, blanks dropped; else the whole
    text; query = the text (its first ``query_chars`` characters when given,
    50 in the reference); empty depends_on; linear edges."""
    parts = F.filter(F.transform(F.split(F.col(text_col), f"\n|\\p{{Nd}}+\\.{PY_WS}"), strip_ws), lambda s: s != "")
    texts = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.col(text_col)))
    steps = F.transform(texts, lambda t, i: _step(i, t, F.lit(True), F.lit(False), F.lit(None), F.array().cast("array<int>")))
    return df.select(*_chain(F.lit("math"), F.col(id_col), _head(F.col(text_col), query_chars), F.lit(""), steps,
                             _seq_edges(F.size(texts))))


def steps_to_chain(df: DataFrame, steps_col: str, id_col: str, domain_col: str | None = None,
                   query_col: str | None = None) -> DataFrame:
    """A live step list -> chain: sequential edges, a single step gets the
    self-loop [0, 0]; 'qa' / unknown domains map to math."""
    texts = F.col(steps_col)
    n = F.size(texts)
    steps = F.transform(texts, lambda t, i: _step(i, t, F.lit(True), F.lit(False), F.lit(None), _deps(i)))
    edges = F.when(n == 1, F.array(F.array(F.lit(0), F.lit(0)))).otherwise(_seq_edges(n))
    dom = F.col(domain_col) if domain_col else F.lit("math")
    dom = F.when(dom.isin("math", "code", "medical"), dom).otherwise(F.lit("math"))
    q = F.col(query_col) if query_col else F.lit("")
    return df.select(*_chain(dom, F.col(id_col), q, F.lit("N/A"), steps, edges))


def turn_edges(steps: DataFrame) -> DataFrame:
    """Edges (dep -> step_id) from each step's depends_on (default
    [i-1]); a turn without any edge and more than one node falls back to
    sequential edges.  steps: (chain_id, idx, step_id, depends_on nullable)."""
    deps = F.coalesce(F.col("depends_on"), F.when(F.col("idx") > 0, F.array(F.col("idx") - 1)).otherwise(F.array()))
    e = steps.select("chain_id", F.explode(deps).alias("src"), F.col("step_id").alias("dst"))
    w = Window.partitionBy("chain_id").orderBy("idx")
    seq = steps.select("chain_id", F.lag("step_id").over(w).alias("src"), F.col("step_id").alias("dst")).filter(
        F.col("src").isNotNull())
    seq = seq.join(e.select("chain_id").distinct(), "chain_id", "left_anti")
    return e.select("chain_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).unionByName(
        seq.select("chain_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))


def conversion_stats(chains: DataFrame, messages: DataFrame, key: list[str] | None = None) -> DataFrame:
    """C11: total, converted (valid ones only: an invalid chain is skipped
    before it counts as converted), valid and invalid chains, and the number of
    error messages; ``messages`` is the V1 output for all chains."""
    key = key or []
    bad = messages.groupBy("chain_id").agg(F.count(F.lit(1)).alias("_bad"))
    j = chains.join(bad, "chain_id", "left")
    valid = F.count(F.when(F.col("_bad").isNull(), 1))
    return j.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), valid.alias("converted"), valid.alias("valid"),
                               F.count(F.when(F.col("_bad").isNotNull(), 1)).alias("invalid"),
                               F.coalesce(F.sum("_bad"), F.lit(0)).cast("long").alias("messages"))


def valid_chains(chains: DataFrame, messages: DataFrame) -> DataFrame:
    """C11 output: the chains without an error message; invalid ones are dropped."""
    return chains.join(messages.select("chain_id").distinct(), "chain_id", "left_anti")


# ---------------------------------------------------------------------------
# P2 response parsing, P13 fenced JSON, P11/P12 inference logs
# ---------------------------------------------------------------------------

def parse_response(resp) -> F.Column:
    """P2 as a per-row fold over the lines: a line starting 'Step ' or
    'Final Answer:' opens a step (text after the first ':' when present,
    else the line); other lines extend an open non-empty step with a space;
    lines before the first step, or after a header with empty text, are
    dropped.  Fallback: blank-line separated paragraphs longer than 10
    characters, else the whole stripped text."""
    r = F.col(resp) if isinstance(resp, str) else resp
    lines = F.transform(F.split(r, "\n"), strip_ws)
    init = F.struct(F.array().cast("array<string>").alias("steps"), F.lit("").alias("cur"))

    def merge(acc, line):
        start = line.startswith("Step ") | line.startswith("Final Answer:")
        flushed = F.when(acc["cur"] != "", F.concat(acc["steps"], F.array(strip_ws(acc["cur"])))).otherwise(acc["steps"])
        head = F.when(F.instr(line, ":") > 0, strip_ws(F.substring(line, F.instr(line, ":") + 1, 1 << 30))).otherwise(line)
        return F.when(start, F.struct(flushed.alias("steps"), head.alias("cur"))).when(
            acc["cur"] != "", F.struct(acc["steps"].alias("steps"), F.concat(acc["cur"], F.lit(" "), line).alias("cur"))
        ).otherwise(acc)

    def finish(acc):
        return F.when(acc["cur"] != "", F.concat(acc["steps"], F.array(strip_ws(acc["cur"])))).otherwise(acc["steps"])

    steps = F.aggregate(lines, init, merge, finish)
    paras = F.filter(F.transform(F.split(r, "\n\n"), strip_ws), lambda p: (p != "") & (F.length(p) > 10))
    alt = F.when(F.size(paras) > 0, paras).otherwise(F.array(strip_ws(r)))
    return F.when(F.size(steps) > 0, steps).otherwise(alt)


def fenced_json_steps(text) -> F.Column:
    """JSON between ```json (or ```) fences parsed as an array of step
    objects; each step's 'text', else 'step'.  Null when absent/invalid."""
    t = F.col(text) if isinstance(text, str) else text
    body = F.coalesce(F.nullif(F.regexp_extract(t, r"```json\s*([\s\S]*?)```", 1), F.lit("")),
                      F.nullif(F.regexp_extract(t, r"```\s*([\s\S]*?)```", 1), F.lit("")), t)
    arr = F.from_json(body, "array<map<string,string>>")
    return F.transform(arr, lambda m: F.coalesce(m["text"], m["step"]))


def inference_log_to_chains(log: DataFrame) -> DataFrame:
    """Successful inference results -> chains (id '{query}_{model}',
    sequential graph, all steps correct)."""
    ok = log.filter(F.col("error").isNull() | (F.col("error") == ""))
    ok = ok.withColumn("_id", F.concat_ws("_", "query", "model_type"))
    return steps_to_chain(ok, "reasoning_steps", "_id", query_col="query")


def inference_log_metrics(log: DataFrame) -> DataFrame:
    """Per model: calls, errors, mean / p50 / p95 latency, mean steps."""
    return log.groupBy("model_type").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count(F.when(F.col("error").isNotNull() & (F.col("error") != ""), 1)).alias("errors"),
        F.round(F.avg("latency"), 6).alias("avg_latency"),
        F.percentile_approx("latency", 0.5).alias("p50_latency"), F.percentile_approx("latency", 0.95).alias("p95_latency"),
        F.round(F.avg(F.size("reasoning_steps")), 6).alias("avg_steps"))

