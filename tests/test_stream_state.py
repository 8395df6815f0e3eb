"""R7 stream state: a user's chain (one day) closes when the next day starts
or when the watermark passes the end of its day."""

import tempfile

from pyspark.sql import functions as F

from tracewise.streaming import stream as S


def test_chain_state_closes_days(spark):
    rows = [  # (event_id, ts, user_id, event_type, value)
        (1, "2024-01-01 10:00:00", 7, "view", 10.0),
        (2, "2024-01-01 11:00:00", 7, "error", 50.0),
        (3, "2024-01-01 12:00:00", 7, "view", 20.0),
        (4, "2024-01-02 09:00:00", 7, "click", 80.0),
        (5, "2024-01-01 09:30:00", 8, "error", 5.0),
        (6, "2100-01-01 00:00:00", -1, "view", 0.0),   # sentinel: lets the watermark pass every day
    ]
    d = tempfile.mkdtemp(prefix="tw-stream-", dir="/tmp") + "/events"
    (spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double")
     .withColumn("ts", F.col("ts").cast("timestamp")).withColumn("props", F.lit("")).write.parquet(d))
    schema = spark.read.parquet(d).schema
    ev = spark.readStream.schema(schema).parquet(d)
    out = S.run_to_table(S.chain_state(S.step_events(ev)), "test_chain_state").filter("chain_id >= 0").cache()
    got = {r.chain_id % 100000: r for r in out.collect() if r.chain_id // 100000 == 7}
    day1, day2 = sorted(got)
    a, b = got[day1], got[day2]
    assert (a.num_steps, a.num_errors, a.first_error_step, a.first_flag_step) == (3, 1, 1, 1)
    assert a.max_risk == 0.5 and a.overall_risk_level == "MEDIUM"
    assert a.replay_interventions == 2          # step 1 flagged, seen by prefixes 1 and 2
    assert (b.num_steps, b.num_errors, b.first_flag_step, b.overall_risk_level) == (1, 0, 0, "HIGH")
    other = [r for r in out.collect() if r.chain_id // 100000 == 8]
    assert len(other) == 1 and other[0].num_errors == 1 and other[0].first_error_step == 0


EVENTS = "event_id long, ts timestamp, user_id long, chain_id long, is_correct boolean, risk double, command string, target long"


def _folder(spark, rows, schema):
    d = tempfile.mkdtemp(prefix="tw-stream-", dir="/tmp") + "/rows"
    at = [list(f) for f in rows]
    for f in at:
        f[1] = __import__("datetime").datetime.fromisoformat(f[1])
    df = spark.createDataFrame([tuple(f) for f in at], schema)
    df.coalesce(1).write.parquet(d)
    return spark.readStream.schema(df.schema).parquet(d)


def test_commands_take_their_place_among_the_steps(spark):
    rows = [  # the commands of user 7 on chains 71 and 72; 9 is the far-future event
        (1, "2024-01-01 10:00:00", 7, 71, True, 0.1, "status", 71),
        (2, "2024-01-01 10:05:00", 7, 71, False, 0.8, None, None),
        (4, "2024-01-01 10:20:00", 7, 72, True, None, "list", None),
        (3, "2024-01-01 10:10:00", 7, None, None, None, "status", 99),
        (5, "2024-01-01 10:30:00", 7, None, None, None, "end", 71),
        (6, "2024-01-01 10:40:00", 7, None, None, None, "end", 71),
        (7, "2024-01-01 10:50:00", 7, 71, True, 0.2, "status", 71),
        (8, "2024-01-01 11:00:00", 7, None, None, None, "clear", None),
        (10, "2024-01-01 11:01:00", 7, None, None, None, "list", None),
        (11, "2024-01-01 12:00:00", 7, 73, True, 0.1, None, None),
        (12, "2024-01-02 00:00:01", 7, None, None, None, "status", 73),
        (9, "2100-01-01 00:00:00", -1, -1, True, 0.0, None, None),
    ]
    out = S.run_to_table(S.chain_commands(_folder(spark, rows, EVENTS)), "t_commands")
    got = sorted(tuple(r)[1:] for r in out.collect())
    assert got == sorted([
        (1, "status", 71, "active", 1, 0, 0.1), (3, "status", 99, "not_found", None, None, None),
        (4, "list", 71, "active", 2, 1, 0.8), (4, "list", 72, "active", 1, 0, None),
        (5, "end", 71, "ended", 2, 1, 0.8), (6, "end", 71, "not_found", None, None, None),
        (7, "status", 71, "active", 1, 0, 0.2), (8, "clear", None, "cleared", 2, None, None),
        (12, "status", 73, "not_found", None, None, None),
    ], key=lambda r: (r[0], r[1], r[2] if r[2] is not None else -1))


def test_live_streams_are_listed_from_the_state_store(spark):
    rows = [(1, "2024-01-01 10:00:00", 7, 71, True, 0.1, None, None), (2, "2024-01-01 10:05:00", 7, 71, False, 0.8, None, None),
            (3, "2024-01-01 10:00:00", 8, 81, True, 0.3, None, None), (4, "2023-12-30 10:00:00", 8, 80, True, 0.3, None, None),
            (5, "2024-01-01 18:00:00", 8, 81, True, 0.3, None, None)]
    root = tempfile.mkdtemp(prefix="tw-live-", dir="/tmp")
    S.run_to_table(S.chain_state(_folder(spark, rows, EVENTS)), "t_live", root=root)
    live = {tuple(r) for r in S.live_streams(spark, root).collect()}
    assert live == {(7, 71, 2, 1, 0.8), (8, 81, 1, 0, 0.3)}  # 80 is over; the last step of 81 still waits


class _Map(dict):
    """A MapState in memory that counts what is read and written."""

    touched = 0

    def _count(self, n=1):
        _Map.touched += n

    def updateValue(self, k, v):
        self._count(sum(len(x) if isinstance(x, list) else 1 for x in v))
        self[k] = v

    def getValue(self, k):
        self._count(sum(len(x) if isinstance(x, list) else 1 for x in self[k]))
        return self[k]

    def containsKey(self, k):
        return k in self

    def removeKey(self, k):
        self.pop(k, None)

    def iterator(self):
        for k, v in list(self.items()):
            self._count(sum(len(x) if isinstance(x, list) else 1 for x in v))
            yield k, v


class _Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class _Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):
        return _Map()

    def getValueState(self, *_):
        return _Value()

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class _Times:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_a_micro_batch_costs_its_own_rows(spark):
    """10^5 steps wait; three more are written without touching them, and a slot that is over is folded without the others."""
    import pandas as pd

    handle, p = _Handle(), S.ChainProcessor("step")
    p.init(handle)
    hour = p.SLOT_MS

    def frame(ms):
        return pd.DataFrame({"ts": pd.to_datetime(ms, unit="ms"), "event_id": range(len(ms)), "chain_id": 1, "is_correct": True, "risk": 0.5, "command": None, "target": None})

    list(p.handleInputRows((7,), iter([frame([100 * hour + k * 30 for k in range(100_000)])]), _Times(0)))
    _Map.touched = 0
    list(p.handleInputRows((7,), iter([frame([99 * hour + 1, 99 * hour + 2, 100 * hour + 5])]), _Times(0)))
    assert _Map.touched <= 3 * 7 and handle.timers == {100 * hour}
    _Map.touched = 0
    out = list(p.handleExpiredTimer((7,), _Times(100 * hour), None))
    assert len(out[0]) == 2 and _Map.touched < 60 and min(handle.timers - {100 * hour}) == 101 * hour
    assert len(list(p.handleExpiredTimer((7,), _Times(200 * hour), None))[0]) == 100_001


def test_a_micro_batch_is_one_chunk_however_many_slots_it_has(spark):
    import pandas as pd

    handle, p = _Handle(), S.ChainProcessor("step")
    p.init(handle)
    hour = p.SLOT_MS
    frame = pd.DataFrame({"ts": pd.to_datetime([k * hour + 1 for k in range(70)], unit="ms"), "event_id": range(70), "chain_id": 1, "is_correct": True, "risk": 0.5, "command": None, "target": None})
    list(p.handleInputRows((7,), iter([frame]), _Times(0)))
    assert len(p.chunks) == 1 and handle.timers == {hour}
    # slots that are not over go back, under the first of them
    out = list(p.handleExpiredTimer((7,), _Times(3 * hour), None))
    assert len(out[0]) == 3 and [k[0] for k in p.chunks] == [3 * hour] and 4 * hour in handle.timers
    assert len(list(p.handleExpiredTimer((7,), _Times(99 * hour), None))[0]) == 67 and not p.chunks


def test_a_new_conversation_reads_no_names(spark):
    import pandas as pd

    class _Unread(_Map):
        def containsKey(self, k):
            raise AssertionError("read")

    p = S.MemoryProcessor(1000)
    p.init(_Handle())
    p.names = _Unread()
    frame = pd.DataFrame({"ts": pd.to_datetime([1, 2], unit="ms"), "turn": [0, 1], "step_idx": 0, "pk": 0, "pm": 0, "vkey": ["n:1", "n:2"], "value": ["1", "2"], "kind": "entity", "key": "x"})
    assert len(list(p.handleInputRows((7,), iter([frame]), _Times(0)))[0]) == 1
