"""Rich entities, template chains, fault injection, synthetic data, prompts."""

from pyspark.sql import functions as F

from tracewise.operators import memory, prompts, synth


def test_rich_entities(spark):
    df = spark.createDataFrame([(1, "The New York trip with Bob took 12 days in Springville, And 12 more.")],
                               "id long, text string")
    ents = {r.entity: r.value for r in memory.rich_entities(df, ["id"]).collect()}
    # as in the reference pattern, a leading capitalised stop word joins the name
    assert ents["The New York"] == "The New York" and ents["Bob"] == "Bob" and ents["number_12"] == "12"
    assert "Springville" in ents and "The" not in ents and "And" not in ents


def test_template_chain(spark):
    p = spark.createDataFrame([(1, "Who?", "Ann")], "id long, question string, answer string")
    t = memory.template_chain(p, ["id"]).orderBy("step_id").collect()
    assert [r.text for r in t] == ["I need to find the answer to: Who?",
                                   "Looking through the story for relevant details...",
                                   "Based on the information, the answer is: Ann"]
    assert [r.depends_on for r in t] == [[], [0], [0, 1]] and all(r.is_correct for r in t)


def test_fault_injection_rules(spark):
    turns = spark.createDataFrame([(c, t, txt) for c in range(40) for t, txt in
                                   enumerate(["Bob has 7 apples", "Bob is here\nBob has 7 apples now\nit was fine"])],
                                  "conv_id long, turn long, text string")
    steps = turns.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("step_idx", "text"))
    out = memory.fault_injection(turns, steps).collect()
    assert out, "with 40 conversations some second turns must be injected"
    for r in out:
        assert r.turn == 1 and r.step_idx in (1, 2)
        if r.kind == "entity":
            assert r.is_origin and r.error_type == "factual" and not r.is_correct
        elif r.kind == "claim":
            assert r.is_origin == ("was not" in r.new_text or " is not " in r.new_text)
        else:
            assert r.is_correct and "(Note: " in r.new_text and r.changed


def test_synthetic_and_balance(spark):
    s = synth.synthetic_chains(spark, 9)
    b = synth.dataset_balance(s).first()
    assert (b.total_chains, b.total_nodes, b.origin_nodes, b.incorrect_nodes) == (9, 36, 3, 6)


def test_prompts(spark):
    q = spark.createDataFrame([("q1", "Solve: 2x + 5 = 13", "math")], "qid string, query string, domain string")
    t = prompts.template_table(spark)
    o = prompts.render(q, t, "openai").first()
    assert o.user.startswith("Problem: Solve: 2x + 5 = 13\n\n") and o.system.startswith("You are a helpful mathematical")
    g = prompts.render(q, t, "google").first()
    assert g.system == "" and g.user.startswith(o.system + "\n\n")
    i = prompts.render(q, t, "instruct").first()
    assert i.user.startswith("<|system|>\n") and i.user.endswith("<|assistant|>\n")
    ex = spark.createDataFrame([("q1", "x", "math", [("1+1", "2")])],
                               "qid string, query string, domain string, ex array<struct<query:string,solution:string>>")
    f = prompts.render(ex, t, "openai", examples="ex").first()
    assert f.user.startswith("Example 1:\nProblem: 1+1\nSolution:\n2\n\nNow solve this problem:\n\nProblem: x")
