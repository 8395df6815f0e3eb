"""Shapes of plans and work that keep the cost of a query in step with its input."""

from pyspark.sql import functions as F

from tracewise.functions import common
from tracewise.operators import fingerprint


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fingerprint_reads_a_text_once_and_before_the_shuffle(spark):
    steps = spark.createDataFrame([(1, 0, "A b. Maybe so"), (1, 1, "it is")], "chain_id long, idx long, text string")
    plan = _plan(fingerprint.step_measures(steps))
    assert plan.count("lower(") == 1
    assert "text" not in plan.split("Window")[0]


def test_words_and_strip_know_all_whitespace(spark):
    text = f"{common.WS_LIST}Ab{common.WS_LIST}c{common.WS_LIST}"
    row = spark.createDataFrame([(text,), (common.WS_LIST,), ("",), (None,)], "t string").select(common.words("t"), common.strip_ws("t"), common.substr_count("t", "　")).collect()
    assert [tuple(r) for r in row] == [(["Ab", "c"], text.strip(), 3), ([], "", 1), ([], "", 0), (None, None, None)]


def test_metrics_predict_each_row_once(spark):
    from tracewise.operators import classify

    calls = spark.sparkContext.accumulator(0)

    def guess(x):
        calls.add(1)
        return x

    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "label_name string")
    pred = rows.select("label_name", F.udf(guess, "string")("label_name").alias("predicted"))
    assert classify.multiclass_metrics(pred).filter("cls = 'accuracy'").first().precision == 1.0
    assert calls.value == 3


def test_forest_is_fitted_on_no_more_partitions_than_tasks_run(spark, monkeypatch):
    from tracewise.operators import classify

    class Fit:
        def fit(self, train):
            return train.rdd.getNumPartitions()

    monkeypatch.setattr(classify, "pipeline", lambda **_: Fit())
    assert classify.fit(spark.range(1000).repartition(97)) <= spark.sparkContext.defaultParallelism


def _long_tables(spark):
    steps = spark.createDataFrame([(1, 0, 0, True, False, []), (1, 1, 0, False, True, [0]), (2, 0, 5, True, True, [9]), (2, 1, 3, False, True, [5]),
                                   (3, 0, None, True, False, []), (4, 0, 0, True, False, [None])],
                                  "chain_id long, idx long, step_id long, is_correct boolean, is_origin boolean, depends_on array<long>")
    nodes = spark.createDataFrame([(1, 0), (2, 5), (3, None), (4, 0)], "chain_id long, node long")
    edges = spark.createDataFrame([(1, [0, 0]), (2, [5, 3]), (2, [8, 9]), (3, [None, 0]), (4, [0]), (4, [0, 0])], "chain_id long, edge array<long>")
    return steps, nodes, edges


def test_messages_of_each_rule_with_nulls_and_repeats(spark):
    from tracewise.operators import validate

    messages = validate.validation_messages(*_long_tables(spark))
    got = sorted((r.chain_id, r.rule) for r in messages.collect())
    assert got == sorted([(1, "duplicate_step_ids"), (3, "duplicate_step_ids"), (2, "unsorted_step_ids"), (2, "multiple_origins"), (2, "origin_marked_correct"),
                          (2, "nodes_mismatch"), (3, "nodes_mismatch"), (4, "invalid_edge_format"), (2, "edge_invalid_node"), (2, "edge_invalid_node"),
                          (3, "edge_invalid_node"), (2, "invalid_dependency"), (4, "invalid_dependency")])
    plan = _plan(messages)
    assert "count(distinct" not in plan and "LeftAnti" not in plan


def test_converted_chains_are_kept_without_texts(spark, monkeypatch, tmp_path):
    from tracewise import session
    from tracewise.plans import catalog_convert, catalog_graph, catalog_validate

    kept = []

    def cut(df):
        kept.append(df.schema.simpleString())
        return df

    for m in (session, catalog_graph, catalog_validate):
        monkeypatch.setattr(m, "cut_lineage", cut)
    d = str(tmp_path)
    spark.createDataFrame([(1, 1, 7, 3, 10.0, 100.0, 0.05, 0.01, "R", "O", "2024-01-01")],
                          "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                          "l_returnflag string, l_linestatus string, l_shipdate string").write.parquet(f"{d}/lineitem.parquet")
    catalog_convert._converted(spark, d)
    catalog_validate.validation_input(spark, d)
    monkeypatch.setattr(catalog_graph.E, "propagation_summary", lambda *a: a)
    catalog_graph.q_propagation(spark, d)
    assert len(kept) == 3 and not any("text" in k for k in kept)


def test_mentions_are_matched_once(spark, monkeypatch):
    from tracewise.operators import memory

    steps = spark.createDataFrame([(1, 0, 0, "x = 1 and Ann is here"), (1, 1, 0, "x = 2 and Ann is gone")], "conv_id long, turn long, step_idx long, text string")
    out = memory.memory_features(steps.select("conv_id", "turn"), steps)
    assert "regexp_extract_all" not in _plan(out)
    assert [r.num_contradictions for r in out.orderBy("turn").collect()] == [0, 2]


def test_chain_files_deal_the_lines_out_once(spark, monkeypatch, tmp_path):
    from tracewise.plans import catalog_library

    d, written = str(tmp_path), []
    lines = [(k, n, 7, (k or 0) % 3 + n, 10.0, 100.0, 0.05, 0.01, "R" if n else "A", "O", "2024-01-01") for k in (1, 2, 3, 88, 89, 178, None) for n in (1, 2, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, "
                                 "l_tax double, l_returnflag string, l_linestatus string, l_shipdate string").write.parquet(f"{d}/lineitem.parquet")
    spark.range(300).withColumnRenamed("id", "o_orderkey").write.parquet(f"{d}/orders.parquet")
    write = catalog_library.io.write_chains_jsonl

    def spy(chains, path, **kw):
        written.append((chains._jdf.queryExecution().executedPlan().toString(), path))
        write(chains, path, **kw)

    monkeypatch.setattr(catalog_library.io, "write_chains_jsonl", spy)
    out = {tuple(r) for r in catalog_library.q_chain_files(spark, d).collect()}
    # the model is that of the first line's supplier, k % 3 + 1; the lines of no order are no chain
    assert out == _by_hand(lines)
    plan, path = written[0]
    assert plan.count("Exchange") == 1 and "Join" not in plan
    chains = spark.read.json(f"{path}/*.jsonl.gz")
    assert chains.count() == 6 and {len(r.reasoning_steps) for r in chains.collect()} == {3}


def _by_hand(lines):
    first = {}
    for k, n, _, supp, *_ in lines:
        if k is not None and (k not in first or (n, supp) < first[k]):
            first[k] = (n, supp)
    models = {k: f"model{s % 4}" for k, (_, s) in first.items()}
    return {(m, "math", len(ks), sum(k % 89 != 0 for k in ks), sum(k % 89 == 0 for k in ks)) for m in set(models.values()) for ks in [[k for k in models if models[k] == m]]}
