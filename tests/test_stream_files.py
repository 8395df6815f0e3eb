"""Streams over tables that are folders of several files, read one file at a time,
equal the batch result row for row."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from tracewise.operators import memory
from tracewise.plans import QUERIES
from tracewise.sources.fixtures import event_steps, mention_steps
from tracewise.sources.tables import table
from tracewise.streaming import stream as S

N_FILES = 4
DELAY = "1 day"  # the watermark delay; the files are out of order by less


@pytest.fixture(scope="module")
def folder(spark):
    """events cut by time, but rows up to 11 hours off a cut may stand in the neighbour file; conversations cut by hash."""
    d = tempfile.mkdtemp(prefix="tw-files-", dir="/tmp")
    ev = table(spark, SF001, "events")
    sec = F.col("ts").cast("timestamp").cast("double")
    lo, hi = ev.agg(F.min(sec), F.max(sec)).first()
    jitter = (F.pmod(F.xxhash64("event_id"), F.lit(79201)) - 39600).cast("double")
    part = F.least(F.lit(N_FILES - 1), F.greatest(F.lit(0), F.floor((sec + jitter - lo) / (hi - lo) * N_FILES))).cast("int")
    cut = ev.withColumn("_p", part).cache()
    for p in range(N_FILES):  # written in order: a file source reads older files first
        cut.filter(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(f"{d}/events.parquet")
    conv = table(spark, SF001, "conversations").withColumn("_p", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))).cache()
    for p in range(3):
        conv.filter(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(f"{d}/conversations.parquet")
    assert len([f for f in os.listdir(f"{d}/events.parquet") if f.endswith(".parquet")]) == N_FILES
    return d


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def run(spark, folder, operator, name):
    ev = S.events_stream(spark, folder, max_files=1)
    return S.run_to_table(operator(S.step_events(ev.df)), name, flush=ev.flush)


def batch_steps(spark, folder):
    return S.step_events(table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")))


def test_files_cross_days_and_are_out_of_order(spark, folder):
    ev = spark.read.parquet(f"{folder}/events.parquet").groupBy(F.input_file_name().alias("f")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    spans = sorted((r.a, r.b) for r in ev.collect())
    assert any(x[1] > y[0] for x, y in zip(spans, spans[1:]))


def test_windows(spark, folder):
    got = run(spark, folder, lambda s: S.tumbling_metrics(s, delay=DELAY), "t_windows")
    want = batch_steps(spark, folder).groupBy(F.window("ts", "1 day").start.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.max("risk").alias("m"))
    assert rows(got.select("window_start", "n_steps", "max_risk")) == rows(want)
    assert sum(r.n_steps for r in got.collect()) == table(spark, folder, "events").count()


def test_dedup_keeps_every_event_once(spark, folder):
    got = run(spark, folder, lambda s: S.dedup_steps(s, ["user_id", "event_id"], DELAY), "t_dedup").filter("user_id >= 0")
    assert rows(got.select("event_id")) == rows(table(spark, folder, "events").select("event_id"))


def test_chain_state_and_step_status(spark, folder):
    steps = event_steps(spark, folder, per_day=True)
    want = steps.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("is_correct")).cast("long")).alias("w"),
                                         F.coalesce(F.min(F.when(~F.col("is_correct"), F.col("idx"))), F.lit(-1)).alias("e"))
    got = run(spark, folder, lambda s: S.chain_state(s, DELAY), "t_chain").filter("chain_id >= 0")
    assert rows(got.select("chain_id", "num_steps", "num_errors", "first_error_step")) == rows(want)
    status = run(spark, folder, lambda s: S.chain_steps(s, DELAY), "t_status").filter("chain_id >= 0")
    assert rows(status.select("chain_id", "idx", "event_id")) == rows(steps.select("chain_id", "idx", "event_id"))
    assert all((r.parent_idx is None) == (r.idx == 0) for r in status.collect())


@pytest.mark.parametrize("key", ["stream_windows", "stream_sliding", "stream_sessions", "stream_dedup", "stream_chain_state", "stream_memory"])
def test_keys_on_a_folder_equal_the_single_file(spark, folder, key):
    if key == "stream_memory":
        assert rows(QUERIES[key](spark, folder).select("conv_id", "turn", "step_idx", "key")) == rows(QUERIES[key](spark, SF001).select("conv_id", "turn", "step_idx", "key"))
    else:
        assert rows(QUERIES[key](spark, folder)) == rows(QUERIES[key](spark, SF001))


def test_conflicts_never_name_a_later_turn(spark, folder):
    """Turns in different files, the later one first: only earlier turns count as previous."""
    d = tempfile.mkdtemp(prefix="tw-turns-", dir="/tmp") + "/conversations.parquet"
    for turn, text in ((5, "alpha is red"), (2, "alpha is blue"), (7, "alpha is blue")):
        spark.createDataFrame([(1, turn, "user", text)], "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(d)
    conv = S.finite_stream(spark, d, max_files=1).df
    steps = conv.select("conv_id", "turn", F.lit(0).cast("long").alias("step_idx"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), "text")
    got = S.run_to_table(S.memory_conflicts(S.mention_stream(steps)), "t_turns").collect()
    assert got and all(r.previous_turn < r.turn for r in got)
    assert {(r.turn, r.previous_turn) for r in got if r.kind == "claim"} == {(7, 5)}


def test_stream_memory_equals_batch(spark):
    ts = mention_steps(spark, SF001)
    ents, claims = memory.entity_conflicts(memory.extract_entities(ts)), memory.claim_conflicts(memory.extract_claims(ts))
    got = QUERIES["stream_memory"](spark, SF001)
    assert got.count() == ents.count() + claims.count()
