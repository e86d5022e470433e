"""Ledger and job state in batch form: reservations, leases, outbox, offers, verdicts, gaps.

Events are the log: signup opens, view holds, purchase settles, error releases, click asks.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.operators import budget, jobmachine, offers, transitions
from folioscope.plans.registry import query
from folioscope.sources.tables import SQL_JOBS, jobs, load

NOW = "2024-01-25 12:00:00"


@query("j02_idempotent_intake", f"with {SQL_JOBS}, r as (select member_id, tokens as request, kind, job_id, row_number() over (partition by member_id, tokens order by moment, job_id) as nth, min(kind) over (partition by member_id, tokens) <> max(kind) over (partition by member_id, tokens) as conflict from jobs) select member_id, request, job_id, kind, conflict from r where nth = 1")
def j02(spark, sf):
    """The first request of an id makes the job; another payload under the same id is a conflict."""
    g = jobs(spark, sf).groupBy("member_id", F.col("tokens").alias("request")).agg(F.min(F.struct("moment", "job_id", "kind")).alias("first"), (F.min("kind") != F.max("kind")).alias("conflict"))
    return g.select("member_id", "request", "first.job_id", "first.kind", "conflict")


@query("j03_expired_leases", f"with {SQL_JOBS}, l as (select member_id, max(moment) as moment, arg_max(kind, (moment, job_id)) as kind, arg_max(tokens, (moment, job_id)) as tokens from jobs group by 1) select member_id, kind, case when kind = 'purchase' then 'done' when kind = 'error' then 'failed' when moment + to_minutes(coalesce(tokens, 0) * 60) <= timestamp '{NOW}' then 'expired' else 'running' end as status from l")
def j03(spark, sf):
    """The latest event of a job is its state; a lease that has run out by now is expired."""
    l = jobs(spark, sf).groupBy("member_id").agg(F.max_by(F.struct("moment", "kind", "tokens"), F.struct("moment", "job_id")).alias("l")).select("member_id", "l.*")  # noqa: E741
    until = F.expr("moment + make_dt_interval(0, 0, coalesce(tokens, 0) * 60, 0)")
    return l.select("member_id", "kind", F.when(F.col("kind") == "purchase", "done").when(F.col("kind") == "error", "failed").when(until <= F.expr(f"timestamp_ntz '{NOW}'"), "expired").otherwise("running").alias("status"))


#: A member's events as requests to one job: what is made, queued, claimed for ten hours, paid for and closed, often out of turn.
REQUESTS = """select member_id as job, job_id as seq, moment, case kind when 'signup' then 'create' when 'view' then case when tokens % 2 = 0 then 'queue' else 'resume' end when 'click' then case when tokens % 4 > 0 then 'claim' else 'hold' end
 when 'purchase' then case when tokens % 2 = 0 then 'complete' else 'partial' end else case when tokens % 3 = 0 then 'fail' when tokens % 3 = 1 then 'pause' else 'reject' end end as op, 36000000 as lease_ms, case when tokens % 5 = 0 then 1 end as attempt, 5 as held from jobs"""
ALLOWED = " or ".join(f"(op = '{op}' and status in ({', '.join(repr(x) for x in sorted(states))}))" for op, (states, _) in jobmachine.MOVES.items())
TARGETS = " ".join(f"when '{op}' then '{to}'" for op, (_, to) in jobmachine.MOVES.items())


@query("j03_job_states", f"""with recursive {SQL_JOBS}, q as ({REQUESTS}), o as (select *, epoch_ns(moment) // 1000000 as ms, row_number() over (partition by job order by moment, seq) as n from q),
r as (select job, 0::bigint as n, null::bigint as seq, null::varchar as status, 0 as tries, null::bigint as until, 0 as holds, null::varchar as reason from (select distinct job from o)
 union all select job, n, seq, case when reason = 'orphaned' then 'outcome_unknown' when reason is not null then status else case op when 'create' then 'received' when 'hold' then status when 'claim' then 'running' {TARGETS} end end,
  tries + (op = 'claim' and reason is null)::int, case when reason = 'orphaned' then null when reason is not null or op = 'hold' then until when op = 'claim' then ms + lease_ms end,
  case when reason is not null then holds when op = 'hold' then holds + held when op = 'claim' and status <> 'running' then 0 else holds end, reason from (
  select *, case when op = 'create' then case when status is not null then 'invalid_transition' end when status is null then 'missing' when op = 'hold' then case when status <> 'running' then 'invalid_transition' end
    when op = 'claim' then case when status = 'running' and until > ms then 'lease_held' when status = 'running' and holds > 0 then 'orphaned' when status not in ('running', 'queued', 'paused_resume') then 'invalid_transition' end
    when not ({ALLOWED}) then 'invalid_transition' when op in ('complete', 'partial', 'fail', 'unknown', 'pause') and status = 'running' and attempt <> tries then 'stale_attempt' end as reason
   from (select o.*, r.status, r.tries, r.until, r.holds from r join o on o.job = r.job and o.n = r.n + 1)))
select job, seq, status, tries, until as lease_until, reason from r where n > 0""")
def j03_states(spark, sf):
    """The state of every job after each request to it: ten states, leases, attempts and what holds money."""
    jobs(spark, sf).createOrReplaceTempView("jobs")
    log = spark.sql(REQUESTS).withColumn("at", F.unix_millis(F.col("moment").cast("timestamp")))
    return jobmachine.histories(log).select("job", "seq", "status", "tries", "lease_until", "reason")


OUTBOX = {"status": "case when tokens % 3 = 0 then 'pending' else 'sent' end", "attempts": "case when tokens % 3 = 0 then 0 else 1 + tokens % 2 end"}


@query("j04_outbox_pending", f"with {SQL_JOBS}, o as (select job_id as outbox_id, kind, moment as created, {OUTBOX['status']} as status, {OUTBOX['attempts']}::int as attempts, case when tokens % 3 > 0 then moment + interval 1 hour end as sent from jobs), r as (select *, row_number() over (partition by kind order by created, outbox_id) as nth from o where status = 'pending' or sent < timestamp '2024-01-10') select outbox_id, kind, nth, attempts + 1 as attempts, status = 'sent' as again from r where nth <= 100")
def j04(spark, sf):
    """What one pass of the relay sends for each kind, oldest first: pending messages, and those sent so long ago that they are sent again."""
    o = jobs(spark, sf).selectExpr("job_id as outbox_id", "kind", "moment as created", f"{OUTBOX['status']} as status", f"cast({OUTBOX['attempts']} as int) as attempts", "case when tokens % 3 > 0 then moment + interval 1 hour end as sent")
    return transitions.due(o, 100, F.expr("timestamp_ntz '2024-01-10'")).select("outbox_id", "kind", "nth", (F.col("attempts") + 1).alias("attempts"), (F.col("status") == "sent").alias("again"))


@query("j05_reservation_ledger", f"with {SQL_JOBS} select member_id, strftime(moment, '%Y-%m') as period, sum(case when kind = 'view' then tokens else 0 end)::bigint as held, sum(case when kind = 'purchase' then tokens else 0 end)::bigint as settled, sum(case when kind = 'error' then tokens else 0 end)::bigint as released, greatest(0, sum(case kind when 'view' then tokens when 'purchase' then -tokens when 'error' then -tokens else 0 end))::bigint as open from jobs group by all")
def j05(spark, sf):
    """Counters from the log of reservations; never below zero."""
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("tokens")).otherwise(0))
    g = jobs(spark, sf).groupBy("member_id", F.date_format("moment", "yyyy-MM").alias("period")).agg(of("view").alias("held"), of("purchase").alias("settled"), of("error").alias("released"))
    return g.withColumn("open", F.greatest(F.lit(0), F.col("held") - F.col("settled") - F.col("released")))


#: A member's log: views reserve, and what follows settles, releases or marks the last view before it, which may be over or refused by then.
LOG = """select member_id, {0} as period, moment as instant, job_id as seq, case kind when 'view' then 'reserve' when 'purchase' then 'settle' when 'signup' then 'settle' when 'error' then 'release' else 'unknown' end as op,
 {1} as rid, case kind when 'purchase' then {2} else tokens end as micros, case when member_id % 10 > 0 then 150 + member_id % 7 * 20 end as member_cap from jobs"""
LAST_VIEW = "last_value(case when kind = 'view' then job_id end ignore nulls) over (partition by member_id order by moment, job_id rows between unbounded preceding and current row)"


@query("j05_admissions", f"""with recursive {SQL_JOBS}, log as ({LOG.format("strftime(moment, '%Y-%m')", LAST_VIEW, "tokens // 2")}), o as (select *, row_number() over (partition by member_id, period order by instant, seq) as n from log),
r as (select member_id, period, 0::bigint as n, null::bigint as seq, null::varchar as outcome, null::bigint as available, 0::bigint as reserved, 0::bigint as settled, []::struct(rid bigint, micros bigint, state varchar)[] as held from (select distinct member_id, period from o)
 union all select member_id, period, n, seq, outcome, case when outcome = 'refused' then greatest(member_cap - reserved - settled, 0) end, reserved + case outcome when 'held' then micros when 'settled' then -amount when 'released' then -amount else 0 end, settled + case when outcome = 'settled' then micros else 0 end,
  case when outcome = 'held' then list_append(held, {{'rid': rid, 'micros': micros, 'state': 'held'}}) when outcome in ('settled', 'released', 'unknown') then list_transform(held, lambda h: {{'rid': h.rid, 'micros': h.micros, 'state': case when h.rid = rid then outcome else h.state end}}) else held end from (
  select *, case when op = 'reserve' then case when member_cap is not null and reserved + settled + micros > member_cap then 'refused' else 'held' end when state is null then 'missing' when state = target then 'same' when state = 'held' or (state = 'unknown' and target <> 'unknown') then target else 'invalid' end as outcome from (
   select o.*, r.reserved, r.settled, r.held, case op when 'settle' then 'settled' when 'release' then 'released' else 'unknown' end as target, list_filter(r.held, lambda h: h.rid = o.rid)[1].state as state, list_filter(r.held, lambda h: h.rid = o.rid)[1].micros as amount from r join o on o.member_id = r.member_id and o.period = r.period and o.n = r.n + 1)))
select member_id, period, seq, outcome, available, reserved, settled from r where n > 0""")
def j05_admissions(spark, sf):
    """Which reservations a member's cap lets through, and what settling, releasing and unknown bills leave of it, entry by entry."""
    jobs(spark, sf).createOrReplaceTempView("jobs")
    log = spark.sql(LOG.format("date_format(moment, 'yyyy-MM')", LAST_VIEW.replace(" ignore nulls)", ") ignore nulls"), "tokens div 2")).withColumnRenamed("instant", "at").withColumn("lab_cap", F.lit(None).cast("long"))
    return budget.ledger(log).select("member_id", "period", "seq", "outcome", "available", "reserved", "settled")


@query("e24_balances", f"with {SQL_JOBS}, s as (select member_id, sum(case when kind = 'view' then tokens else 0 end) as r, sum(case when kind = 'purchase' then tokens else 0 end) as s from jobs group by 1) select member_id, case when member_id % 10 = 0 then null else 2000 - r - s end::bigint as balance from s")
def e24(spark, sf):
    """A null cap is unlimited, and so is its balance."""
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("tokens")).otherwise(0))
    g = jobs(spark, sf).groupBy("member_id").agg(of("view").alias("r"), of("purchase").alias("s"))
    return g.select("member_id", F.when(F.col("member_id") % 10 != 0, 2000 - F.col("r") - F.col("s")).alias("balance"))


@query("j06_offer_ttl", f"with {SQL_JOBS}, o as (select job_id, member_id, moment, moment + interval 7 day as expires, kind from jobs where kind in ('signup', 'click')) select job_id, case when expires <= timestamp '{NOW}' then 'expired' when lag(moment) over (partition by member_id order by moment, job_id) > moment - interval 1 day then 'suppressed' else 'open' end as state from o")
def j06(spark, sf):
    o = jobs(spark, sf).where("kind in ('signup', 'click')")
    before = F.lag("moment").over(Window.partitionBy("member_id").orderBy("moment", "job_id"))
    o = o.withColumn("before", before)
    return o.select("job_id", F.when(F.expr(f"moment + interval 7 day <= timestamp_ntz '{NOW}'"), "expired").when(F.expr("before > moment - interval 1 day"), "suppressed").otherwise("open").alias("state"))


#: A member's events as a session: views and visits make offers that last two days, and all else answers the last one before it, at times twice, late, or for something else.
OFFERED = """select member_id as session, job_id as seq, moment, case when kind in ('view', 'signup') then 'issue' else 'respond' end as op, member_id % 9 + case when tokens % 19 = 0 then 1 else 0 end as member, case when tokens % 2 = 0 then 'deep' else 'wide' end as kind,
 cast(tokens % 4 as {0}) as targets, case when tokens % 3 = 0 then 'h' || (tokens % 6) end as input_hash, case when tokens % 13 = 0 then 'p2' else 'p1' end as policy, {1} as offer, cast(tokens % 30 as {0}) as request,
 case when kind = 'purchase' then 'accept' else 'decline' end as decision, case when tokens % 11 = 0 then 2 else 1 end as revision, case when tokens % 17 = 0 then 'other' else 'same' end as hash from jobs"""
LAST_OFFER = "last_value(case when kind in ('view', 'signup') then job_id end ignore nulls) over (partition by member_id order by moment, job_id rows between unbounded preceding and current row)"


@query("j06_offer_answers", f"""with recursive {SQL_JOBS}, l as ({OFFERED.format('varchar', LAST_OFFER)}), o as (select *, epoch_ns(moment) // 1000000 as ms, row_number() over (partition by session order by moment, seq) as n from l),
r as (select session, 0::bigint as n, null::bigint as seq, null::varchar as op, null::varchar as outcome, null::bigint as about, []::struct(id bigint, member bigint, kind varchar, targets varchar, input varchar, expires bigint, policy varchar, hash varchar, status varchar)[] as offers, []::struct(request varchar, payload varchar)[] as used from (select distinct session from o)
 union all select session, n, seq, op, outcome, case when outcome in ('offered') then seq when outcome = 'suppressed' then by_id when outcome = 'not_found' then null else offer end,
  case when outcome = 'offered' then list_append(offers, {{'id': seq, 'member': member, 'kind': kind, 'targets': targets, 'input': input_hash, 'expires': ms + 172800000, 'policy': policy, 'hash': hash, 'status': 'offered'}})
   when outcome in ('accepted', 'declined', 'expired', 'stale') then list_transform(offers, lambda x: {{'id': x.id, 'member': x.member, 'kind': x.kind, 'targets': x.targets, 'input': x.input, 'expires': x.expires, 'policy': x.policy, 'hash': x.hash, 'status': case when x.id = offer then outcome else x.status end}}) else offers end,
  case when outcome in ('accepted', 'declined') then list_append(used, {{'request': request, 'payload': payload}}) else used end from (
  select *, case when op = 'issue' then case when by_id is not null then 'suppressed' else 'offered' end when own is null or own.member <> member then 'not_found' when before is not null then case when before = payload then 'replayed' else 'idempotency_conflict' end
    when own.status in ('expired', 'stale') then own.status when own.status in ('accepted', 'declined') then case when own.hash = hash and own.status = case decision when 'accept' then 'accepted' else 'declined' end then 'same' else 'revision_conflict' end
    when own.expires <= ms then 'expired' when revision <> 1 or own.hash <> hash then 'revision_conflict' when own.policy <> policy then 'stale' when decision = 'accept' then 'accepted' else 'declined' end as outcome from (
   select o.*, r.offers, r.used, list_filter(r.offers, lambda x: ((x.kind = o.kind and x.targets = o.targets) or coalesce(x.input = o.input_hash, false)) and (x.status = 'declined' or (x.status = 'offered' and x.expires > o.ms)))[-1].id as by_id,
    list_filter(r.offers, lambda x: x.id = o.offer)[1] as own, list_filter(r.used, lambda x: x.request = o.request)[1].payload as before, concat_ws('/', o.offer, o.decision, o.revision, o.hash) as payload from r join o on o.session = r.session and o.n = r.n + 1)))
select session, seq, op, outcome, about from r where n > 0""")
def j06_answers(spark, sf):
    """Which offers a session gets and which are suppressed, and what each answer does."""
    jobs(spark, sf).createOrReplaceTempView("jobs")
    log = spark.sql(OFFERED.format("string", LAST_OFFER.replace(" ignore nulls)", ") ignore nulls"))).withColumn("at", F.unix_millis(F.col("moment").cast("timestamp")))
    return offers.answered(log.withColumn("expires", F.col("at") + 172_800_000)).select("session", "seq", "op", "outcome", "about")


@query("j07_verdict_reuse", f"with {SQL_JOBS}, v as (select kind, tokens, min(job_id) as origin from jobs group by all) select job_id, case when tokens is null then 'no input' when v.origin = job_id then 'judge' else 'reuse' end as action, origin from jobs join v using (kind, tokens)")
def j07(spark, sf):
    """An input that was judged before takes the verdict of the first time."""
    j = jobs(spark, sf)
    v = j.groupBy("kind", "tokens").agg(F.min("job_id").alias("origin"))
    return j.join(v, ["kind", "tokens"]).select("job_id", F.when(F.col("tokens").isNull(), "no input").when(F.col("origin") == F.col("job_id"), "judge").otherwise("reuse").alias("action"), "origin")


@query("j10_gap_states", f"with {SQL_JOBS}, r as (select member_id, kind, moment, row_number() over (partition by member_id order by moment desc, job_id desc) as nth, count(*) filter (kind = 'click') over (partition by member_id) as asked from jobs where kind <> 'view') select member_id, case kind when 'signup' then 'unrequested' when 'click' then 'requested' when 'purchase' then 'collected' else 'declined' end as state, asked from r where nth = 1")
def j10(spark, sf):
    g = jobs(spark, sf).where("kind <> 'view'").groupBy("member_id").agg(F.max_by("kind", F.struct("moment", "job_id")).alias("kind"), F.count_if(F.col("kind") == "click").alias("asked"))
    k = F.col("kind")
    return g.select("member_id", F.when(k == "signup", "unrequested").when(k == "click", "requested").when(k == "purchase", "collected").otherwise("declined").alias("state"), "asked")


@query("j11_allowed_writes", f"with {SQL_JOBS} select kind, count(*) as writes, count(*) filter (member_id in (select s_suppkey from supplier where s_nationkey < 12)) as allowed from jobs group by kind")
def j11(spark, sf):
    ok = load(spark, sf, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("member_id"), F.lit(1).alias("ok")).distinct()
    return jobs(spark, sf).join(ok, "member_id", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("writes"), F.count("ok").alias("allowed"))


#: Transactions: the lines of an order change the items that their parts are, each in one of four ways.
OPERATION = "case (l_orderkey + l_linenumber) % 9 when 0 then 'create' when 1 then 'check' when 2 then 'delete' else 'update' end"
EXPECTED = "case when (l_orderkey + l_linenumber) % 9 = 0 then null when l_quantity > 49 then 99 else l_partkey * 31 % 7 end"
STORED = "p_size > 2"


@query("j12_revision_conflicts", f"""with items as (select p_partkey as key, (p_partkey * 31 % 7)::bigint as revision from part where {STORED}), ops as (select l_orderkey as txn, l_partkey as key, {OPERATION} as op, ({EXPECTED})::bigint as expected from lineitem),
o as (select txn, key, min(op) as op, min(expected) as expected, count(*) as n from ops group by all), f as (select key, min(txn) as first from o group by 1), e as (select o.*, f.first, i.revision, case when n > 1 then 'repeated key' when o.txn <> f.first then 'in progress' when op = 'create' and i.key is not null then 'exists' when op <> 'create' and i.key is null then 'missing' when op <> 'create' and i.revision is distinct from o.expected then 'revision' end as problem from o join f using (key) left join items i using (key)),
t as (select txn, count(*) as items, min(problem) as problem from e group by 1) select txn, items, case when problem is null then 'committed' when problem = 'in progress' then 'retry' else 'failed' end as outcome, problem from t""")
def j12(spark, sf):
    """All or nothing: a transaction commits only if every item is as it expects and no earlier one of the batch touches any of them."""
    items = load(spark, sf, "part").where(STORED).selectExpr("p_partkey as key", "cast(p_partkey * 31 % 7 as bigint) as revision")
    ops = load(spark, sf, "lineitem").selectExpr("l_orderkey as txn", "l_partkey as key", f"{OPERATION} as op", f"cast({EXPECTED} as bigint) as expected")
    return transitions.decided(items, ops).select("txn", "items", "outcome", "problem")


@query("j12_items_after", f"""with items as (select p_partkey as key, (p_partkey * 31 % 7)::bigint as revision from part where {STORED}), ops as (select l_orderkey as txn, l_partkey as key, {OPERATION} as op, ({EXPECTED})::bigint as expected from lineitem), o as (select txn, key, min(op) as op, min(expected) as expected, count(*) as n from ops group by all), f as (select key, min(txn) as first from o group by 1),
e as (select o.*, n > 1 or o.txn <> first or (op = 'create' and i.key is not null) or (op <> 'create' and (i.key is null or i.revision is distinct from o.expected)) as bad from o join f using (key) left join items i using (key)), t as (select txn from e group by 1 having not bool_or(bad)), c as (select key, op from o join t using (txn) where op <> 'check')
select coalesce(i.key, c.key) as key, case when op = 'update' then revision + 1 when op = 'create' then 1 else revision end as revision from items i full join c on c.key = i.key where op is distinct from 'delete'""")
def j12_items(spark, sf):
    """The items once the transactions that may commit have done so."""
    items = load(spark, sf, "part").where(STORED).selectExpr("p_partkey as key", "cast(p_partkey * 31 % 7 as bigint) as revision")
    ops = load(spark, sf, "lineitem").selectExpr("l_orderkey as txn", "l_partkey as key", f"{OPERATION} as op", f"cast({EXPECTED} as bigint) as expected")
    return transitions.applied(items, ops)


@query("j13_approvals", f"with {SQL_JOBS}, d as (select job_id, member_id, tokens % 4 as rev from jobs where kind = 'purchase'), p as (select member_id, max(tokens % 4) as rev from jobs where kind = 'view' group by 1), x as (select member_id, min(job_id) as run from jobs where kind = 'error' group by 1) select d.job_id, case when p.rev is null then 'unknown' when d.rev <> p.rev then 'stale' when x.run < d.job_id then 'linked' else 'started' end as outcome from d left join p using (member_id) left join x using (member_id)")
def j13(spark, sf):
    j = jobs(spark, sf)
    p = j.where("kind = 'view'").groupBy("member_id").agg(F.max(F.col("tokens") % 4).alias("current"))
    x = j.where("kind = 'error'").groupBy("member_id").agg(F.min("job_id").alias("run"))
    d = j.where("kind = 'purchase'").select("job_id", "member_id", (F.col("tokens") % 4).alias("rev"))
    return d.join(p, "member_id", "left").join(x, "member_id", "left").select("job_id", F.when(F.col("current").isNull(), "unknown").when(F.col("rev") != F.col("current"), "stale").when(F.col("run") < F.col("job_id"), "linked").otherwise("started").alias("outcome"))


@query("j14_skip_done", "select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1)")
def j14(spark, sf):
    done = load(spark, sf, "labels").where("quality = 1").select("doc_id")
    return load(spark, sf, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@query("b14_answer_view", f"with {SQL_JOBS}, a as (select member_id, max(moment) filter (kind = 'purchase') as answered, max(moment) filter (kind = 'click') as offered from jobs group by 1) select member_id, answered is not null as has_answer, case when offered is null then 'none' when offered + interval 7 day <= timestamp '{NOW}' then 'expired' else 'open' end as offer from a")
def b14(spark, sf):
    a = jobs(spark, sf).groupBy("member_id").agg(F.max(F.when(F.col("kind") == "purchase", F.col("moment"))).alias("answered"), F.max(F.when(F.col("kind") == "click", F.col("moment"))).alias("offered"))
    return a.select("member_id", F.col("answered").isNotNull().alias("has_answer"), F.when(F.col("offered").isNull(), "none").when(F.expr(f"offered + interval 7 day <= timestamp_ntz '{NOW}'"), "expired").otherwise("open").alias("offer"))
