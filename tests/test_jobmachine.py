"""Job states by hand, and the stream against the batch."""

import datetime
import random

from folioscope.operators import jobmachine as J

SCHEMA = "job string, at long, seq long, op string, lease_ms long, attempt int, held long"


def after(*requests, state=J.NEW):
    """The last state and the reasons of (op, at, attempt, held) with leases of 960 seconds."""
    reasons = []
    for op, at, attempt, held in requests:
        state, reason = J.moved(state, op, at, 960_000, attempt, held)
        reasons.append(reason)
    return state, reasons


def test_claims_lease_jobs_and_refuse_while_the_lease_is_live():
    state, reasons = after(("create", 0, None, 0), ("claim", 1, None, 0), ("queue", 1, None, 0), ("claim", 2000, None, 0), ("claim", 600_000, None, 0), ("claim", 962_000, None, 0))
    assert reasons == [None, "invalid_transition", None, None, "lease_held", None]
    assert state == ("running", 2, 1_922_000, 0)  # at the very end of a lease another may claim


def test_an_unresolved_attempt_is_not_run_again():
    state, reasons = after(("create", 0, None, 0), ("queue", 0, None, 0), ("claim", 0, None, 0), ("hold", 5, None, 70), ("claim", 960_000, None, 0), ("complete", 960_001, 1, 0))
    assert state[0] == "outcome_unknown" and reasons[-2:] == [J.ORPHANED, "invalid_transition"]


def test_a_close_by_a_replaced_worker_is_refused():
    state, reasons = after(("create", 0, None, 0), ("queue", 0, None, 0), ("claim", 0, None, 0), ("claim", 960_000, None, 0), ("complete", 970_000, 1, 0), ("partial", 970_001, 2, 0))
    assert reasons[-2:] == ["stale_attempt", None] and state[:3] == ("partial", 2, None)


def test_pauses_rejections_and_what_is_over():
    assert after(("create", 0, None, 0), ("pause", 1, None, 0), ("claim", 2, None, 0), ("resume", 3, None, 0), ("claim", 4, None, 0), ("fail", 5, 1, 0))[0][:2] == ("failed", 1)
    for end in J.OVER:
        for op in ["claim", "create", "hold", *J.MOVES]:
            assert J.moved((end, 1, None, 0), op, 9, 1, None, 1) == ((end, 1, None, 0), "invalid_transition")
    assert J.moved(J.NEW, "claim", 0, 1, None, 0) == (J.NEW, "missing")


def requests(seed=3):
    rng, rows, t = random.Random(seed), [], 0
    for seq in range(600):
        t += rng.randint(0, 40_000)
        job = f"j{rng.randint(0, 25)}"
        op = rng.choice(["create", "queue", "queue", "claim", "claim", "claim", "hold", "complete", "partial", "fail", "pause", "resume", "reject", "unknown"])
        rows.append((job, t, seq, op, 200_000, rng.choice([None, 1, 2]), 5))
    return rows


def test_histories_are_folds_and_sweeps_close_leases(spark):
    rows = requests()
    got = {r.seq: (r.status, r.tries, r.reason) for r in J.histories(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    states = {}
    for job, at, seq, op, lease, attempt, held in rows:
        states[job], reason = J.moved(states.get(job, J.NEW), op, at, lease, attempt, held)
        assert got[seq] == (*states[job][:2], reason)
    now = rows[-1][1]
    last = {r.job: (r.status, r.reason) for r in J.swept(J.histories(spark.createDataFrame(rows, SCHEMA)), now).collect()}
    assert last == {j: (("outcome_unknown", J.EXPIRED) if J.expired(s, now) else (s[0], None)) for j, s in states.items() if s[0]}


def test_stream_orders_requests_and_ends_leases(spark, tmp_path):
    """Files in shuffled order within the lateness; the stream gives each request the state that the batch gives it, with expired leases closed between them."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        base = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
        rows = [("a", 0, 1, "create"), ("a", 1, 2, "queue"), ("a", 2, 3, "claim"), ("b", 0, 4, "create"), ("b", 3, 6, "claim"), ("b", 2, 5, "queue"), ("a", 5000, 7, "complete"), ("b", 100, 8, "complete"), ("z", 9000, 9, "create"), ("z", 19_000, 10, "queue"), ("b", 1, 11, "fail")]
        path = str(tmp_path / "in")
        schema = "job string, moment timestamp, seq long, op string, lease_ms long, attempt int, held long"
        for i, part in enumerate((rows[:4], rows[4:6], rows[6:8], rows[8:9], rows[9:10], rows[10:])):
            spark.createDataFrame([(j, base + datetime.timedelta(seconds=s), q, op, 960_000, None, 0) for j, s, q, op in part], schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        q = J.streamed(stream, "10 minutes", 10**9).writeStream.format("memory").queryName("jobstates").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        got = {(r.job, r.seq): (r.status, r.tries, r.reason) for r in spark.table("jobstates").collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert got["a", 3] == ("running", 1, None) and got["a", None] == ("outcome_unknown", 1, J.EXPIRED)  # its completion came after the lease
    assert got["a", 7] == ("outcome_unknown", 1, "invalid_transition")
    assert got["b", 5] == ("queued", 0, None) and got["b", 6] == ("running", 1, None) and got["b", 8] == ("completed", 1, None)
    assert ("b", 11) not in got  # far behind the watermark
