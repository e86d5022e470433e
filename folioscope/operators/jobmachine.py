"""The states of jobs: ten of them, leases, and what a log of requests does to each job, in batch and as a stream.

A request that its job's state does not allow changes nothing and says why: ``lease_held`` for a claim of a running job whose lease still runs, ``stale_attempt`` for a close by a worker
that another has replaced, ``missing`` for a job that was never made, else ``invalid_transition``.  A claim of a job whose lease is over runs it again, unless an
earlier attempt left money held: then the outcome is unknown.  A lease that runs out with nothing coming closes its job the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The states, those that are over, and the states that each request may find a job in, with the state that it leaves.
STATES = ["received", "queued", "rejected_budget", "running", "completed", "partial", "failed", "outcome_unknown", "paused_budget", "paused_resume"]
OVER = {"rejected_budget", "completed", "partial", "failed", "outcome_unknown"}
MOVES = {
    "queue": ({"received"}, "queued"), "reject": ({"received"}, "rejected_budget"), "pause": ({"received", "running"}, "paused_budget"), "resume": ({"paused_budget"}, "paused_resume"),
    "complete": ({"running"}, "completed"), "partial": ({"running"}, "partial"), "fail": ({"running"}, "failed"), "unknown": ({"running"}, "outcome_unknown"),
}
CLOSES = {"complete", "partial", "fail", "unknown", "pause"}
ORPHANED, EXPIRED = "orphaned", "lease_expired"
#: A job's state: status, attempt, the end of its lease in milliseconds, and what its attempts hold.
NEW = (None, 0, None, 0)


def moved(state: tuple, op: str, at: int, lease_ms: int, attempt: int | None, held: int) -> tuple[tuple, str | None]:
    """The state after a request at a moment, and the reason if it changes nothing or closes a job for another."""
    status, tries, until, holds = state
    if op == "create":
        return (("received", 0, None, 0), None) if status is None else (state, "invalid_transition")
    if status is None:
        return state, "missing"
    if op == "hold":
        return ((status, tries, until, holds + held), None) if status == "running" else (state, "invalid_transition")
    if op == "claim":
        if status == "running" and until is not None and until > at:
            return state, "lease_held"
        if status == "running" and holds > 0:
            return ("outcome_unknown", tries, None, holds), ORPHANED
        if status in ("running", "queued", "paused_resume"):
            return ("running", tries + 1, at + lease_ms, 0 if status != "running" else holds), None
        return state, "invalid_transition"
    allowed, target = MOVES.get(op, (set(), None))
    if status not in allowed:
        return state, "invalid_transition"
    if op in CLOSES and status == "running" and attempt is not None and attempt != tries:
        return state, "stale_attempt"
    return (target, tries, None, holds), None


def expired(state: tuple, now: int) -> bool:
    """Whether a running job's lease is over; at its very end it is."""
    return state[0] == "running" and state[2] is not None and state[2] <= now


_IN = ["job", "at", "seq", "op", "lease_ms", "attempt", "held"]
_OUT = "status string, tries int, lease_until long, reason string"


def histories(log: DataFrame) -> DataFrame:
    """``log`` (job, at in milliseconds, seq, op, lease_ms, attempt, held) with status, tries, lease_until and reason after each request, in the order of (at, seq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, state = object(), NEW
        for batch in batches:
            out = []
            for key, at, _, op, lease, attempt, held in zip(*[batch.column(c).to_pylist() for c in _IN]):
                if key != job:
                    job, state = key, NEW
                state, reason = moved(state, op, at, lease or 0, attempt, held or 0)
                out.append((*state[:3], reason))
            cols = list(zip(*out)) if out else [()] * 4
            added = [pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "status", "tries", "lease_until", "reason"])

    slim = log.select("job", F.col("at").cast("long").alias("at"), "seq", "op", F.col("lease_ms").cast("long").alias("lease_ms"), F.col("attempt").cast("int").alias("attempt"), F.col("held").cast("long").alias("held"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)
    return slim.repartition("job").sortWithinPartitions("job", "at", "seq").mapInArrow(run, f"{kinds}, {_OUT}")


def swept(states: DataFrame, now: int) -> DataFrame:
    """job, status, tries, reason of the last state of each job of ``histories`` when a sweep has closed the leases that are over by ``now``."""
    last = states.groupBy("job").agg(F.max_by(F.struct("status", "tries", "lease_until"), F.struct("at", "seq")).alias("s")).where("s.status is not null")
    over = (F.col("s.status") == "running") & (F.col("s.lease_until") <= now)
    return last.select("job", F.when(over, "outcome_unknown").otherwise(F.col("s.status")).alias("status"), F.col("s.tries").alias("tries"), F.when(over, EXPIRED).alias("reason"))


class JobProcessor(StatefulProcessor):
    """The machine over a stream: a timer in event time for each lease, requests in the order of their moments, and a time to live, by the same clock, for the state of a job that does not run.

    A request behind the watermark is dropped by the stream before it comes here, so a state is never changed by what should have come before it and is final.
    Those that come earlier than a request already taken, but within the lateness, wait in a list until the watermark has passed their moment.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        field = lambda name, kind: T.StructField(name, kind())
        self.handle = handle
        self.state = handle.getValueState("state", T.StructType([field("status", T.StringType), field("tries", T.IntegerType), field("lease_until", T.LongType), field("holds", T.LongType), field("since", T.LongType)]))
        self.waiting = handle.getListState("waiting", T.StructType([field("at", T.LongType), field("seq", T.LongType), field("op", T.StringType), field("lease_ms", T.LongType), field("attempt", T.IntegerType), field("held", T.LongType)]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Kept until the watermark has passed: requests of other batches may belong between them.
        for r in rows:
            self.waiting.appendValue((r.at, r.seq, r.op, r.lease_ms, r.attempt, r.held))
            self.handle.registerTimer(max(r.at, timerValues.getCurrentWatermarkInMs()) + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        *state, since = tuple(self.state.get()) if self.state.exists() else (*NEW, 0)
        state = tuple(state)
        all_ = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: x[:2])
        ready, later = [x for x in all_ if x[0] < now], [x for x in all_ if x[0] >= now]
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        before, out = state, []
        for at, seq, op, lease, attempt, held in ready:
            state, reason = moved(state, op, at, lease or 0, attempt, held or 0)
            since = at
            out.append(Row(job=key[0], at=at, seq=seq, status=state[0], tries=state[1], reason=reason))
        if expired(state, now) and not any(x[0] <= state[2] for x in later):
            since = state[2]
            state = ("outcome_unknown", state[1], None, state[3])
            out.append(Row(job=key[0], at=since, seq=None, status=state[0], tries=state[1], reason=EXPIRED))
        if state != before or ready:
            self.state.update((*state, since))
            if state[0] == "running" and state[2] is not None:
                self.handle.registerTimer(max(state[2], now) + 1)
            else:
                self.handle.registerTimer(max(since + self.keep_ms, now) + 1)
        elif not later and state[0] != "running" and since + self.keep_ms <= now:
            self.state.clear()
        return iter(out)

    def close(self) -> None:
        pass


def streamed(requests: DataFrame, lateness: str, keep_ms: int) -> DataFrame:
    """job, at, seq, status, tries, reason of each request of a stream (job, moment, seq, op, lease_ms, attempt, held) and of each lease that runs out.

    The session's state store must be the one with column families (``RocksDBStateStoreProvider``).
    """
    slim = requests.withWatermark("moment", lateness).select("job", F.unix_millis(F.col("moment")).alias("at"), "seq", "op", F.col("lease_ms").cast("long").alias("lease_ms"), F.col("attempt").cast("int").alias("attempt"), F.col("held").cast("long").alias("held"), "moment")
    job = requests.schema["job"].dataType.simpleString()
    return slim.groupBy("job").transformWithState(JobProcessor(keep_ms), f"job {job}, at long, seq long, status string, tries int, reason string", "Append", "EventTime")
