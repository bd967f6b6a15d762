"""Queue, limit and liveness queries: events are submissions and security events, users are tenants."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import service as S
from plumbline.operators.board import latest
from plumbline.operators.rules import first_failure
from plumbline.sources import load

NOW = "2024-01-20 12:00:00"


def rate_limit_hour(spark, sf):
    """At most 3 events of a user in an hour, exactly at every event."""
    return S.rolling_limit(load(spark, sf, "events"), "user_id", "ts", "event_id", 3600, 3).select("event_id", "user_id", "n", "limited", F.col("retry_after").cast("long").alias("retry_after"))


RATE = """
with e as (select *, count(*) over w as n, min(ts) over w as oldest from events window w as (partition by user_id order by ts range between interval 1 hour preceding and current row))
select event_id, user_id, n, n >= 3 as limited, case when n >= 3 then greatest(1, ceil((epoch_us(oldest) + 3600000000 - epoch_us(ts)) / 1000000))::bigint end as retry_after from e"""


def month_quota(spark, sf):
    """Users with 60 or more events in a month."""
    q = S.month_quota(load(spark, sf, "events"), "user_id", "ts", 60)
    return q.select("user_id", F.date_format("month", "yyyy-MM").alias("month"), "n", "exhausted", F.date_format("next_month", "yyyy-MM-dd").alias("retry_at"))


MONTH = """
select user_id, strftime(date_trunc('month', ts), '%Y-%m') as month, count(*) as n, count(*) >= 60 as exhausted, strftime(date_trunc('month', ts) + interval 1 month, '%Y-%m-%d') as retry_at from events group by 1, 2, 5"""


def windows_7d(spark, sf):
    """Half-open windows of 7 days from 2024-01-03; events before it are early."""
    anchor = F.unix_micros(F.lit("2024-01-03 00:00:00").cast("timestamp"))
    k = F.floor((F.unix_micros("ts") - anchor) / (7 * 86400 * 1_000_000))
    return load(spark, sf, "events").groupBy(k.cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")).withColumn("early", F.col("k") < 0)


WINDOWS = """
select floor((epoch_us(ts) - epoch_us(timestamp '2024-01-03')) / 604800000000)::bigint as k, count(*) as n, count(distinct user_id) as users, k < 0 as early from events group by 1"""


def job_counts(spark, sf):
    """Jobs by status."""
    return load(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


JOBS = "select event_type, count(*) as n from events group by 1"


def queue_wait(spark, sf):
    """min(timeout, floor(queued / max(1, grading) * 60)) of every user."""
    g = load(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("queued"), F.count_if(F.col("event_type") == "purchase").alias("grading"))
    return g.withColumn("wait", F.least(F.lit(900), F.floor(F.col("queued") / F.greatest(F.lit(1), "grading") * 60)).cast("long"))


WAIT = """
with g as (select user_id, count(*) filter (where event_type = 'view') as queued, count(*) filter (where event_type = 'purchase') as grading from events group by 1)
select *, least(900, floor(queued / greatest(1, grading) * 60))::bigint as wait from g"""


def fair_claim(spark, sf):
    """40 claims: 2 jobs of a user may be active, counting purchases of the day before."""
    e = load(spark, sf, "events")
    active = e.filter("event_type = 'purchase' and ts < '2024-01-02'").groupBy("user_id").agg(F.count(F.lit(1)).alias("running"))
    jobs = e.filter("event_type = 'click' and ts >= '2024-01-02'").select("user_id", "ts", "event_id")
    return S.fair_claim(jobs, "user_id", ["ts", "event_id"], active, 2, 40).select("event_id", "user_id")


CLAIM = """
with a as (select user_id, count(*) as running from events where event_type = 'purchase' and ts < timestamp '2024-01-02' group by 1),
j as (select event_id, user_id, ts, coalesce(running, 0) + row_number() over (partition by user_id order by ts, event_id) as turn from events left join a using (user_id) where event_type = 'click' and ts >= timestamp '2024-01-02')
select event_id, user_id from j where turn <= 2 order by ts, event_id limit 40"""


def stale_recovery(spark, sf):
    """What happens to jobs older than 15 minutes: failed after three attempts, requarantined when
    used, left alone with a live lease, else requeued."""
    e = load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    stale = F.col("ts") < F.lit(NOW).cast("timestamp") - F.expr("interval 900 seconds")
    action = F.when(~stale, "fresh").when(k % 5 >= 3, "failed").when(F.col("event_type") == "purchase", "requarantined").when(F.col("event_type") == "view", "leased").otherwise("requeued")
    return e.select("event_id", action.alias("action"))


STALE = f"""
select event_id, case when ts >= timestamp '{NOW}' - interval 900 second then 'fresh' when (props::json ->> '$.k')::int % 5 >= 3 then 'failed' when event_type = 'purchase' then 'requarantined'
 when event_type = 'view' then 'leased' else 'requeued' end as action from events"""


def slot_gap(spark, sf):
    """Smallest free slot of 1..3 of every customer; an order's slot is its key % 4."""
    o = load(spark, sf, "orders").filter("o_orderstatus <> 'P'").select("o_custkey", (F.col("o_orderkey") % 4).cast("int").alias("slot"))
    return S.first_free(o, "o_custkey", "slot", 3)


SLOT = """
with s as (select o_custkey, list(distinct o_orderkey % 4) as taken from orders where o_orderstatus <> 'P' group by 1)
select o_custkey, case when not list_contains(taken, 1) then 1 when not list_contains(taken, 2) then 2 when not list_contains(taken, 3) then 3 end as free from s"""


def lease_generation(spark, sf):
    """Leases (views) of 10 hours that are used (purchases): generation and state of every user."""
    e = load(spark, sf, "events").filter("event_type in ('view', 'purchase')").withColumn("k", F.when(F.col("event_type") == "view", "lease").otherwise("use"))
    return S.lease_state(e, "user_id", ["ts", "event_id"], "k", "ts", 36_000)


LEASE = """
with recursive e as (select user_id, epoch_us(ts) as t, event_type = 'view' as lease, row_number() over (partition by user_id order by ts, event_id) as r from events where event_type in ('view', 'purchase')),
s(user_id, r, generation, until, used) as (select distinct user_id, 0::bigint, 0, null::bigint, false from e
 union all select e.user_id, e.r, generation + (lease and (until is null or until <= t) and not used)::int,
  case when lease and (until is null or until <= t) and not used then t + 36000000000 else until end, used or (not lease and until is not null and until > t)
 from s join e on e.user_id = s.user_id and e.r = s.r + 1)
select user_id, generation, until is not null as leased, used from s qualify row_number() over (partition by user_id order by r desc) = 1"""


def heartbeat_missing(spark, sf):
    """Users without an event in the hour before now: last seen, and their silence in seconds."""
    now = F.lit(NOW).cast("timestamp")
    g = load(spark, sf, "events").filter(F.col("ts") <= now).groupBy("user_id").agg(F.max("ts").alias("last"))
    return g.filter(F.col("last") < now - F.expr("interval 1 hour")).select("user_id", F.floor((F.unix_micros(now) - F.unix_micros("last")) / 1_000_000).cast("long").alias("silent"))


HEARTBEAT = f"""
with g as (select user_id, max(ts) as last from events where ts <= timestamp '{NOW}' group by 1)
select user_id, floor((epoch_us(timestamp '{NOW}') - epoch_us(last)) / 1000000)::bigint as silent from g where last < timestamp '{NOW}' - interval 1 hour"""


def sessions(spark, sf):
    """Sessions of users with gaps under two hours."""
    return S.sessions(load(spark, sf, "events"), "user_id", "ts", "2 hours").select("user_id", F.unix_micros("start").alias("start_us"), "n")


SESSIONS = """
with a as (select user_id, ts, case when ts - lag(ts) over w < interval 2 hour then 0 else 1 end as first from events window w as (partition by user_id order by ts)),
b as (select *, sum(first) over (partition by user_id order by ts) as s from a)
select user_id, epoch_us(min(ts)) as start_us, count(*) as n from b group by user_id, s"""


def suspension(spark, sf):
    """Users whose errors reach 5, and the event at which they do."""
    r = S.running_count(load(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 5)
    return r.select("user_id", "hits", (F.col("hits") >= 5).alias("suspended"), F.col("first.event_id").alias("at_event"))


SUSPENSION = """
with r as (select *, sum((event_type = 'error')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as n from events)
select user_id, max(n)::bigint as hits, max(n) >= 5 as suspended, arg_min(event_id, (ts, event_id)) filter (where n >= 5) as at_event from r group by 1"""


def canary_gate(spark, sf):
    """State of every user's gate from the latest event: missing, error, drift, stale, ok."""
    e = load(spark, sf, "events").filter(F.col("ts") <= F.lit(NOW).cast("timestamp"))
    users = load(spark, sf, "events").select("user_id").distinct()
    l = latest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")])  # noqa: E741
    j = users.join(l, "user_id", "left")
    ok, state = first_failure((F.col("ts").isNull(), "missing"), (F.col("event_type") == "error", "error"), (F.col("value") > 100, "drift"), (F.col("ts") < F.lit(NOW).cast("timestamp") - F.expr("interval 8 hours"), "stale"))
    return j.select("user_id", state.alias("state"), ok.alias("open"))


CANARY = f"""
with u as (select distinct user_id from events), l as (select * from events where ts <= timestamp '{NOW}' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
select user_id, case when l.ts is null then 'missing' when event_type = 'error' then 'error' when value > 100 then 'drift' when ts < timestamp '{NOW}' - interval 8 hour then 'stale' else 'ok' end as state,
 not coalesce(l.ts is null or event_type = 'error' or value > 100 or ts < timestamp '{NOW}' - interval 8 hour, false) as open from u left join l using (user_id)"""


def key_validity(spark, sf):
    """Purchases against keys: a user's signup gives a key for 3 days, half open."""
    e = load(spark, sf, "events")
    keys = e.filter("event_type = 'signup'").select(F.col("user_id").alias("key_owner"), F.col("ts").alias("not_before"), (F.col("ts") + F.expr("interval 3 days")).alias("not_after"))
    v = S.valid_key(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), keys, "user_id", "ts")
    return v.groupBy("event_id").agg(F.count("not_before").alias("keys"), (F.count("not_before") > 0).alias("valid"))


KEYS = """
with k as (select user_id, ts as a, ts + interval 3 day as b from events where event_type = 'signup')
select event_id, count(a) as keys, count(a) > 0 as valid from events e left join k on k.user_id = e.user_id and e.ts >= a and e.ts < b where event_type = 'purchase' group by 1"""


def retry_outcome(spark, sf):
    """Last of the first four attempts of every user and day: outcome, attempts, delivered."""
    e = load(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    from pyspark.sql import Window

    a = e.withColumn("attempt", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))).filter("attempt <= 4")
    g = a.groupBy("user_id", "day").agg(F.max("attempt").alias("attempts"), F.max_by("event_type", "attempt").alias("outcome"))
    return g.withColumn("delivered", F.col("outcome") != "error")


RETRY = """
with a as (select *, strftime(ts, '%Y-%m-%d') as day, row_number() over (partition by user_id, strftime(ts, '%Y-%m-%d') order by ts, event_id)::int as attempt from events qualify attempt <= 4)
select user_id, day, max(attempt) as attempts, arg_max(event_type, attempt) as outcome, arg_max(event_type, attempt) <> 'error' as delivered from a group by 1, 2"""


def single_use(spark, sf):
    """Events whose authorization (user and k of the properties) was used before."""
    e = load(spark, sf, "events").withColumn("nonce", F.get_json_object("props", "$.k").cast("int"))
    first = e.groupBy("user_id", "nonce").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return e.join(first, ["user_id", "nonce"]).filter(F.col("event_id") != F.col("f.event_id")).select("event_id", F.col("f.event_id").alias("used_by"))


SINGLE = """
with e as (select *, (props::json ->> '$.k')::int as nonce, first_value(event_id) over (partition by user_id, (props::json ->> '$.k')::int order by ts, event_id) as used_by from events)
select event_id, used_by from e where event_id <> used_by"""

def claim_oldest(spark, sf):
    """What 300 claimers take from the queue of views: of the 100 oldest the first whose user has less than 2 purchases and claims."""
    e = load(spark, sf, "events")
    active = e.filter("event_type = 'purchase'").groupBy("user_id").agg((F.count(F.lit(1)) % 3).alias("running"))
    return S.claim_oldest(e.filter("event_type = 'view'"), "user_id", ["ts", "event_id"], active, 2, 300).select("event_id", "user_id")


#: One claim after another: a state of the queue's place, what was passed over and what was taken.
CLAIM_OLDEST = """
with recursive a as (select user_id, count(*) % 3 as running from events where event_type = 'purchase' group by 1),
q as (select row_number() over (order by ts, event_id) as k, event_id, user_id, coalesce(running, 0) as running from events left join a using (user_id) where event_type = 'view'),
s(k, passed, taken, who, fits) as (select 0::bigint, 0::bigint, 0::bigint, []::bigint[], false
  union all select q.k, passed + (not f)::bigint, taken + f::bigint, case when f then list_append(who, q.user_id::bigint) else who end, f
  from (select s.*, q.k as n, q.running + len(list_filter(s.who, lambda x: x = q.user_id)) < 2 as f from s join q on q.k = s.k + 1) s join q on q.k = s.n where passed < 100 and taken < 300)
select event_id, user_id from s join q using (k) where fits and passed < 100"""


QUERIES = {
    "claim_oldest": (claim_oldest, CLAIM_OLDEST),
    "rate_limit_hour": (rate_limit_hour, RATE),
    "month_quota": (month_quota, MONTH),
    "windows_7d": (windows_7d, WINDOWS),
    "job_counts": (job_counts, JOBS),
    "queue_wait": (queue_wait, WAIT),
    "fair_claim": (fair_claim, CLAIM),
    "stale_recovery": (stale_recovery, STALE),
    "slot_gap": (slot_gap, SLOT),
    "lease_generation": (lease_generation, LEASE),
    "heartbeat_missing": (heartbeat_missing, HEARTBEAT),
    "sessions": (sessions, SESSIONS),
    "suspension": (suspension, SUSPENSION),
    "canary_gate": (canary_gate, CANARY),
    "key_validity": (key_validity, KEYS),
    "retry_outcome": (retry_outcome, RETRY),
    "single_use": (single_use, SINGLE),
}
