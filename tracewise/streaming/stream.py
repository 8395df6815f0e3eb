"""Structured Streaming forms of the proactive and memory operators
(R7-R9, R18-R22).

The reference simulates streaming with an in-process dict of active chains.
Here the step events are a real stream (``readStream`` over a parquet table,
one file or a folder of them):

* R18 - tumbling / sliding / session windows with a watermark, append mode
* R19 - ``dropDuplicatesWithinWatermark`` on (chain, step) keys
* R7/R8/R9 - per-chain running state with ``transformWithStateInPandas``, keyed by
  user; a chain (user x day) ends when the watermark passes the end of its day
  (the re-aimed replacement of the global cap of 100 streams, which is not
  partitionable).  Steps newer than the watermark wait in state and are folded in
  (ts, event_id) order once no earlier one can come, so steps out of order
  within the delay give the batch result; of folded steps only counters stay.
  Commands (status, list, end, clear) take their place among the steps
* R20 - cross-turn contradiction check keyed by conversation: per name the
  earliest mention and the earliest that differs from it; a conversation's
  state expires when the watermark is ``idle`` past its last turn

State is typed (``MapState``) in a RocksDB store, and a micro-batch reads and
writes only the entries that its rows touch; event-time timers wake a key
(time-to-live needs processing time, which would tie results to the clock)
* R21/R22 - batch forms (stateless aggregate, lag window)

The watermark delay is the only late-data rule: what arrives later than that
is dropped by the engine.  Runs over finite tables use
``trigger(availableNow=True)`` twice on one checkpoint: first over the data, then
over one far-future event that is written after the first run has ended, so
that the watermark passes everything only when all data is in.  Sinks are
parquet tables under the shared checkpoint folder (never the driver's memory).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracewise.operators.memory import extract_claims, extract_entities
from tracewise.operators.risk import LOW_MAX, MEDIUM_MAX
from tracewise.session import checkpoint_dir

SENTINEL_TS = "2100-01-01 00:00:00"
SENTINEL_USER = -1


def _root(spark: SparkSession) -> str:
    return checkpoint_dir(spark).rstrip("/") + "/streams"


@dataclass
class Finite:
    """A finite table as a stream; ``flush`` makes the far-future event arrive."""

    df: DataFrame
    flush: Callable[[], None]


def finite_stream(spark: SparkSession, path: str, max_files: int | None = None,
                  far: Callable[[DataFrame], DataFrame] | None = None) -> Finite:
    """The parquet table at ``path`` (a file or a folder of files) as a stream.

    ``far`` turns a one-row frame into the far-future row of the table's schema;
    the row goes to a second source that is empty until ``flush`` is called.
    ``max_files`` limits the files a micro-batch reads (None: all there are).
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # as a pattern that only this path matches: a stream's plain path must be a folder, a pattern's match may be a file
    s = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    if far is None:
        return Finite(s, lambda: None)
    late = f"{_root(spark)}/late-{uuid.uuid4().hex}"
    row = far(spark.range(1))
    row = row.select(*[(F.col(f.name) if f.name in row.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    row.limit(0).write.parquet(late)

    def flush() -> None:
        row.write.mode("append").parquet(late)

    return Finite(s.unionByName(spark.readStream.schema(schema).parquet(late)), flush)


def events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None, sentinel: bool = True) -> Finite:
    """Events as a stream (ts cast from timestamp_ntz to timestamp)."""
    far = (lambda r: r.select(F.lit(-1).alias("event_id"), F.lit(SENTINEL_USER).alias("user_id"), F.lit("view").alias("event_type"),
                              F.lit(0.0).alias("value"), F.lit(SENTINEL_TS).alias("ts"))) if sentinel else None
    s = finite_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet", max_files, far)
    return Finite(s.df.withColumn("ts", F.col("ts").cast("timestamp")), s.flush)


def step_events(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Stream rows in the step-event shape (chain = user x day), and the columns to ``keep``."""
    chain = F.col("user_id") * 100000 + F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    return events.select(chain.cast("long").alias("chain_id"), "user_id", "event_id", "ts",
                         (F.col("event_type") != "error").alias("is_correct"),
                         F.round(F.least(F.col("value") / 100, F.lit(1.0)), 6).alias("risk"), *keep)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(df: DataFrame, name: str, mode: str = "append", flush: Callable[[], None] | None = None, root: str | None = None) -> DataFrame:
    """Run a streaming query over all that is there (availableNow) into a parquet
    table in the shared checkpoint folder and return it as a batch DataFrame.  With
    ``flush`` the query runs once more, on the same checkpoint, after it was called.
    The state is kept in RocksDB; a query reads that setting when it starts."""
    spark = df.sparkSession
    base = root or f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    before_ = spark.conf.get(STORE)
    for before in (None, flush) if flush else (None,):
        if before:
            before()
        spark.conf.set(STORE, ROCKSDB)
        try:
            q = (df.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out")
                 .option("checkpointLocation", f"{base}/chk").trigger(availableNow=True).start())
        finally:
            spark.conf.set(STORE, before_)
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def live_streams(spark: SparkSession, root: str) -> DataFrame:
    """R7 list: the live chains of a query that ran under ``root`` and their counters, read from its state store."""
    state = spark.read.format("statestore").option("path", f"{root}/chk").option("stateVarName", "chains").load()
    return state.select(F.col("key.user_id").alias("user_id"), F.col("user_map_key.chain_id").alias("chain_id"), F.col("user_map_value.n").alias("num_steps"),
                        F.col("user_map_value.wrong").alias("num_errors"), F.col("user_map_value.max").alias("max_risk"))


# ---------------------------------------------------------------------------
# R18 windows, R19 dedup
# ---------------------------------------------------------------------------

def tumbling_metrics(steps: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Per tumbling event-time window: steps, error rate, max risk."""
    g = (steps.withWatermark("ts", delay).groupBy(F.window("ts", size))
         .agg(F.count(F.lit(1)).alias("n_steps"), F.avg((~F.col("is_correct")).cast("double")).alias("error_rate"),
              F.max("risk").alias("max_risk")))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "n_steps", "error_rate", "max_risk")


def sliding_error_rate(steps: DataFrame, size: str = "1 day", slide: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Rolling error rate over sliding windows."""
    g = (steps.withWatermark("ts", delay).groupBy(F.window("ts", size, slide))
         .agg(F.count(F.lit(1)).alias("n_steps"), F.avg((~F.col("is_correct")).cast("double")).alias("error_rate")))
    return g.select(F.col("window.start").alias("window_start"), "n_steps", "error_rate")


def sessions(steps: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """A session (= one chain of activity) per user, closed after ``gap``."""
    g = (steps.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap))
         .agg(F.count(F.lit(1)).alias("n_steps"), F.max("risk").alias("max_risk"),
              F.sum((~F.col("is_correct")).cast("int")).alias("n_errors")))
    return g.select("user_id", F.col("session_window.start").alias("session_start"),
                    F.col("session_window.end").alias("session_end"), "n_steps", "max_risk", "n_errors")


def dedup_steps(steps: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Drop duplicate (chain, step) events seen within the watermark;
    events behind the watermark are dropped by the engine."""
    return steps.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


# ---------------------------------------------------------------------------
# Per-chain running state
# ---------------------------------------------------------------------------

_DAY_MS = 86_400_000
_CHAIN = "end long, n long, wrong long, max double, err long, flag long, flags long, flag_sum long"
_CHUNK = "ts array<long>, event_id array<long>, chain_id array<long>, ok array<boolean>, risk array<double>, command array<string>, target array<long>"
CHAIN_OUT = T.StructType([
    T.StructField("chain_id", T.LongType()), T.StructField("num_steps", T.LongType()),
    T.StructField("num_errors", T.LongType()), T.StructField("max_risk", T.DoubleType()),
    T.StructField("overall_risk_level", T.StringType()), T.StructField("first_error_step", T.LongType()),
    T.StructField("first_flag_step", T.LongType()), T.StructField("replay_interventions", T.LongType()),
])
STATUS_OUT = T.StructType([
    T.StructField("chain_id", T.LongType()), T.StructField("idx", T.LongType()), T.StructField("event_id", T.LongType()),
    T.StructField("parent_idx", T.LongType()), T.StructField("risk", T.DoubleType()), T.StructField("running_max_risk", T.DoubleType()),
    T.StructField("running_errors", T.LongType()), T.StructField("running_risk_level", T.StringType()),
])
LIFE_OUT = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("command", T.StringType()),
    T.StructField("chain_id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("step_count", T.LongType()),
    T.StructField("num_errors", T.LongType()), T.StructField("max_risk", T.DoubleType()),
])


def _level(x: float | None) -> str:
    x = 0.0 if x is None else x
    return "LOW" if x < LOW_MAX else ("MEDIUM" if x < MEDIUM_MAX else "HIGH")


def _summary(chain_id: int, c: dict) -> tuple:
    return (chain_id, c["n"], c["wrong"], c["max"], _level(c["max"]), -1 if c["err"] is None else c["err"],
            -1 if c["flag"] is None else c["flag"], c["n"] * c["flags"] - c["flag_sum"])


def _fold(c: dict, event_id: int, ok: bool, risk: float | None) -> tuple:
    """Add the next step to a chain's counters; returns its status (idx, event_id, parent_idx, risk, ...)."""
    i = c["n"]
    c["n"] += 1
    if not ok:
        c["wrong"] += 1
        c["err"] = i if c["err"] is None else c["err"]
    if risk is not None:
        c["max"] = risk if c["max"] is None else max(c["max"], risk)
        if risk >= LOW_MAX:
            c["flag"] = i if c["flag"] is None else c["flag"]
            c["flags"] += 1
            c["flag_sum"] += i
    return i, event_id, i - 1 if i else None, risk, c["max"], c["wrong"], _level(c["max"])


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    kinds = {T.LongType: "Int64", T.DoubleType: "float64"}
    return pd.DataFrame({f.name: pd.Series(list(c), dtype=kinds.get(type(f.dataType), object)) for f, c in zip(schema.fields, zip(*rows, strict=True), strict=True)})


class ChainProcessor(StatefulProcessor):
    """The chains of a user.

    State: ``chunks`` - the waiting rows that one micro-batch brought, under their first slot (SLOT_MS of event time); ``mark`` -
    the number of the next micro-batch and the timer that is set; ``chains`` - the counters of the live chains.  A micro-batch
    writes one chunk; when the watermark has passed a slot, its rows are folded in order, and what a chunk holds of later slots
    goes back under the first of them.  ``output``: "chain" (a summary at its end), "step" (a status row a step) or "life" (a row a
    command).
    """

    SLOT_MS = 3_600_000
    FIELDS = {"chain": CHAIN_OUT, "step": STATUS_OUT, "life": LIFE_OUT}

    def __init__(self, output: str):
        self.output = output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "slot long, batch long", _CHUNK)
        self.mark = handle.getValueState("mark", "number long, wake long")
        self.chains = handle.getMapState("chains", "chain_id long", _CHAIN)

    def _slot(self, row: tuple) -> int:
        return row[0] // 1000 // self.SLOT_MS * self.SLOT_MS

    def handleInputRows(self, key, rows, timerValues):
        number, wake = self.mark.get() if self.mark.exists() else (0, None)
        held: list[tuple] = []
        for table in rows:
            us = table["ts"].astype("datetime64[us]").astype("int64").tolist()
            of = lambda c: [None if x is None or x != x else x for x in table[c].tolist()]  # noqa: E731,B023
            whole = lambda c: [None if x is None else int(x) for x in of(c)]  # noqa: E731,B023  a column with nulls comes as floats
            held.extend(zip(us, whole("event_id"), whole("chain_id"), of("is_correct"), of("risk"), of("command"), whole("target"), strict=True))
        first = self._keep(held, number)
        self.mark.update((number + 1, self._sleep(first + self.SLOT_MS, wake)))
        return iter(())

    def _keep(self, rows: list[tuple], number: int) -> int:
        """Writes the rows as one chunk; returns their first slot."""
        first = min(map(self._slot, rows))
        self.chunks.updateValue((first, number), tuple(map(list, zip(*rows, strict=True))))
        return first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        number = self.mark.get()[0]
        self.live = {c: list(v) for (c,), v in self.chains.iterator()}
        before = {c: list(v) for c, v in self.live.items()}
        waiting = [tuple(k) for k in self.chunks.keys()]
        due = [k for k in waiting if k[0] + self.SLOT_MS <= now]
        slots = [k[0] for k in waiting if k[0] + self.SLOT_MS > now]
        if len(due) == len(waiting):
            chunks = [(tuple(k), chunk) for k, chunk in self.chunks.iterator()]
            self.chunks.clear()
        else:
            chunks = [(k, self.chunks.getValue(k)) for k in due]
            for k in due:
                self.chunks.removeKey(k)
        held: list[tuple] = []
        for k, chunk in chunks:
            rows = list(zip(*chunk, strict=True))
            later = [r for r in rows if self._slot(r) + self.SLOT_MS > now]
            held.extend(r for r in rows if self._slot(r) + self.SLOT_MS <= now)
            if later:
                slots.append(self._keep(later, k[1]))
        out: list[tuple] = []
        for row in sorted(held, key=lambda r: (r[0], r[1])):
            self._fold_row(key[0], row, out)
        self._close(now, out)
        for c, v in self.live.items():
            if before.get(c) != v:
                self.chains.updateValue((c,), tuple(v))
        for c in before:
            if c not in self.live:
                self.chains.removeKey((c,))
        ahead = [s + self.SLOT_MS for s in slots] + [v[0] for v in self.live.values()]
        self.mark.update((number, self._sleep(min(ahead), None) if ahead else None))
        return iter([_frame(out, self.FIELDS[self.output])] if out else [])

    def _sleep(self, until: int, wake: int | None) -> int:
        """Sets the timer to ``until`` unless it is set to an earlier time (``wake``); returns when it is set to."""
        if wake is not None:
            if wake <= until:
                return wake
            self.handle.deleteTimer(wake)
        self.handle.registerTimer(until)
        return until

    def _close(self, ms: int, out: list[tuple]) -> None:
        """Chains whose day is over at this time."""
        for c in [c for c, v in self.live.items() if v[0] <= ms]:
            if self.output == "chain":
                out.append(_summary(c, dict(zip(_NAMES, self.live[c], strict=True))))
            del self.live[c]

    def _fold_row(self, user: int, row: tuple, out: list[tuple]) -> None:
        us, event_id, chain_id, ok, risk, command, target = row
        self._close(us // 1000, out)
        if ok is not None:
            c = dict(zip(_NAMES, self.live.get(chain_id, [us // 1000 // _DAY_MS * _DAY_MS + _DAY_MS, 0, 0, None, None, None, 0, 0]), strict=True))
            status = _fold(c, event_id, ok, risk)
            self.live[chain_id] = list(c.values())
            if self.output == "step":
                out.append((chain_id, *status))
        if command is not None:
            answers = self._answer(command, target)
            if self.output == "life":
                out.extend((user, event_id, command, *a) for a in answers)

    def _answer(self, command: str, target: int) -> list[tuple]:
        counts = lambda c: (self.live[c][1], self.live[c][2], self.live[c][3])
        if command == "list":
            return [(c, "active", *counts(c)) for c in sorted(self.live)]
        if command == "clear":
            n = len(self.live)
            self.live.clear()
            return [(None, "cleared", n, None, None)]
        if target not in self.live:
            return [(target, "not_found", None, None, None)]
        answer = (target, "active" if command == "status" else "ended", *counts(target))
        if command == "end":
            del self.live[target]
        return [answer]

    def close(self) -> None:
        pass


_NAMES = [f.split()[0] for f in _CHAIN.split(", ")]


def _chains(steps: DataFrame, output: str, delay: str) -> DataFrame:
    for name, kind in (("command", "string"), ("target", "long")):
        if name not in steps.columns:
            steps = steps.withColumn(name, F.lit(None).cast(kind))
    steps = steps.select("user_id", "ts", "event_id", "chain_id", "is_correct", "risk", "command", "target")
    return (steps.withWatermark("ts", delay).groupBy("user_id")
            .transformWithStateInPandas(ChainProcessor(output), ChainProcessor.FIELDS[output], "append", "eventTime"))


def chain_state(steps: DataFrame, delay: str = "1 hour") -> DataFrame:
    """R7 + R9: one summary per chain (user x day), emitted once when the
    watermark has passed the end of its day.  Steps get ids in (ts, event_id)
    order, matching the batch ``idx``.  Keyed by user, so that one Python call
    serves all of a user's chains in a micro-batch."""
    return _chains(steps, "chain", delay)


def chain_steps(steps: DataFrame, delay: str = "1 hour") -> DataFrame:
    """R7 + R8: one status row per step once the watermark has passed its slot:
    its id, the edge to its parent in the partial graph (``parent_idx``, null for the
    first) and the chain's running risk, errors and level up to it."""
    return _chains(steps, "step", delay)


def chain_commands(steps: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The answers to commands.  A row may hold a step, a ``command``, or both (the command follows the step); commands take their
    place by (ts, event_id).  status: the chain ``target`` is active, or not_found.  end: its final counters, and it is gone.  list: a row
    for each live chain of the user.  clear: all of them go, and how many they were (``step_count``)."""
    return _chains(steps, "life", delay)


# ---------------------------------------------------------------------------
# Streaming contradiction check
# ---------------------------------------------------------------------------

CONFLICT_OUT = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("step_idx", T.LongType()),
    T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("current_value", T.StringType()), T.StructField("previous_value", T.StringType()),
    T.StructField("previous_turn", T.LongType()),
])


def _differs(first: list | None, second: list | None, vkey: str, turn: int) -> list | None:
    """The earliest mention of an earlier turn with another value: the first, or the first that differs from it."""
    if first is not None and first[4] != vkey:
        return first if first[0] < turn else None
    return second if second is not None and second[0] < turn else None


class MemoryProcessor(StatefulProcessor):
    """The names of a conversation: check each mention against earlier turns, then remember it.

    Per (kind, name) the state is the earliest mention and the earliest with another value, by (turn, step, position), whatever
    order they arrive in.  A micro-batch reads and writes the names that it mentions.  A timer ``idle_ms`` behind
    the last turn forgets the conversation.
    """

    MENTION = "turn long, step_idx long, pk long, pm long, vkey string, value string"

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [f"{side}_{f}" for side in ("first", "second") for f in self.MENTION.split(", ")]
        self.names = handle.getMapState("names", "kind string, name string", ", ".join(fields))
        self.last = handle.getValueState("last", "ms long, timer long")

    def handleInputRows(self, key, rows, timerValues):
        table = pd.concat(list(rows), ignore_index=True)
        latest = int(table["ts"].astype("datetime64[us]").astype("int64").max()) // 1000
        seen = self.last.exists()
        if seen:
            before, timer = self.last.get()
            self.handle.deleteTimer(timer)
            latest = max(latest, before)
        rows_ = table[["turn", "step_idx", "pk", "pm", "vkey", "value", "kind", "key"]].values.tolist()
        rows_.sort(key=lambda r: (r[0], r[1], r[2], r[3]))
        # a conversation that is new, or forgotten, has no names to read
        known = {n: self._read(n) if seen else (None, None) for n in {(r[6], r[7]) for r in rows_}}
        held = dict(known)
        out, at = [], 0
        while at < len(rows_):
            turn, end = rows_[at][0], at
            while end < len(rows_) and rows_[end][0] == turn:
                end += 1
            for r in rows_[at:end]:
                prev = _differs(*known[r[6], r[7]], r[4], turn)
                if prev is not None:
                    out.append((key[0], turn, r[1], r[6], r[7], r[5], prev[5], prev[0]))
            for r in rows_[at:end]:
                known[r[6], r[7]] = _remember(*known[r[6], r[7]], list(r[:6]))
            at = end
        for n, (first, second) in known.items():
            if held[n] != (first, second):
                self.names.updateValue(n, (*first, *(second or [None] * 6)))
        timer = max(latest + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(timer)
        self.last.update((latest, timer))
        return iter([pd.DataFrame(out, columns=CONFLICT_OUT.names)] if out else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.names.clear()
        self.last.clear()
        return iter(())

    def _read(self, name: tuple[str, str]) -> tuple[list | None, list | None]:
        if not self.names.containsKey(name):
            return None, None
        held = list(self.names.getValue(name))
        return held[:6], held[6:] if held[6] is not None else None

    def close(self) -> None:
        pass


def _remember(first: list | None, second: list | None, m: list) -> tuple[list, list | None]:
    """The earliest mention and the earliest with another value, with one more mention."""
    if first is None:
        return m, None
    if m[4] != first[4]:
        if m[:4] < first[:4]:  # came late, stands first: the old first may be the earliest that differs
            return m, first
        return first, m if second is None or m[:4] < second[:4] else second
    return (m if m[:4] < first[:4] else first), second


def mention_stream(turn_steps: DataFrame) -> DataFrame:
    """Entity and claim mentions of the steps (conv_id, turn, step_idx, ts, text)."""
    times = turn_steps.select("conv_id", "turn", "step_idx", "ts", F.struct("text", "ts").alias("_row"))
    steps = times.select("conv_id", F.col("turn"), F.struct("step_idx", "ts").alias("step_idx"), F.col("_row.text").alias("text"))
    of = lambda d, kind, key: d.select(
        "conv_id", "turn", F.col("step_idx.step_idx").alias("step_idx"), F.col("step_idx.ts").alias("ts"), F.lit(kind).alias("kind"),
        key.alias("key"), F.col("pos.k").alias("pk"), F.col("pos.m").alias("pm"), "vkey", "value")
    return of(extract_entities(steps), "entity", F.col("name")).unionByName(
        of(extract_claims(steps), "claim", F.concat_ws("|", "subject", "predicate")))


def memory_conflicts(mentions: DataFrame, idle: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Check-then-remember per conversation with a bounded state (two
    mentions a name), dropped when the watermark is ``idle`` past the
    conversation's last turn."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return (mentions.withWatermark("ts", delay).groupBy("conv_id")
            .transformWithStateInPandas(MemoryProcessor(idle_ms), CONFLICT_OUT, "append", "eventTime"))


def conversations_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> Finite:
    """Conversation turns as a stream."""
    return finite_stream(spark, f"{sf_dir.rstrip('/')}/conversations.parquet", max_files)


# ---------------------------------------------------------------------------
# R21 / R22 batch forms
# ---------------------------------------------------------------------------

def session_counters(steps: DataFrame, warn: float = LOW_MAX) -> DataFrame:
    """Queries (steps), interventions (risk >= warn), active sessions
    (distinct users) and uptime in seconds, over the event table."""
    return steps.agg(F.count(F.lit(1)).alias("total_queries"),
                     F.count(F.when(F.col("risk") >= warn, 1)).alias("total_interventions"),
                     F.countDistinct("user_id").alias("active_sessions"),
                     (F.max("ts").cast("long") - F.min("ts").cast("long")).alias("uptime_seconds"))


def prior_turn(turns: DataFrame) -> DataFrame:
    """Per turn, the latest earlier turn of the same session (lag)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", "turn", F.lag("turn").over(w).alias("prior_turn"),
                        F.lag("role").over(w).alias("prior_role"))
