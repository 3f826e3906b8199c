"""Queries on event streams in their batch form; ``vakya.streaming`` has the streaming form of the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..streaming import correlate as C
from ..streaming import dialogue as D
from ..streaming import machines as M
from ..streaming import operators as O
from .registry import Tables, count_n, query



@query("str_ring_window", """
    select event_id, count(*) over w as n, round(sum(value) over w, 4) as total from events window w as (partition by user_id order by ts range between interval 1 hour preceding and current row)""")
def ring_window(t: Tables) -> DataFrame:
    """What a buffer of the last hour holds at each event."""
    frame = "over (partition by user_id order by ts range between interval 1 hour preceding and current row)"
    return t.events.selectExpr("event_id", f"count(*) {frame} as n", f"round(sum(value) {frame}, 4) as total")


@query("str_period_metrics", """
    select time_bucket(interval 6 hours, ts) as start, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(max(value), 6) as most, arg_max(event_id, row(ts, event_id)) as last from events group by 1""")
def period_metrics(t: Tables) -> DataFrame:
    """Metrics of fixed periods."""
    start = F.window("ts", "6 hours").start
    return t.events.groupBy(start.alias("start")).agg(count_n(), F.round(F.expr("percentile(value, 0.5d)"), 6).alias("p50"), F.round(F.expr("percentile(value, 0.95d)"), 6).alias("p95"), F.round(F.max("value"), 6).alias("most"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last"))


@query("str_sliding_counts", """
    with s as (select event_type, unnest([time_bucket(interval 6 hours, ts), time_bucket(interval 6 hours, ts) - interval 6 hours]) as start from events) select event_type, start, count(*) as n from s group by 1, 2""")
def sliding_counts(t: Tables) -> DataFrame:
    """Windows of twelve hours every six hours."""
    return t.events.groupBy("event_type", F.window("ts", "12 hours", "6 hours").start.alias("start")).agg(count_n())


@query("str_session_windows", """
    with f as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 2 hours then 1 else 0 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from f)
    select user_id, min(ts) as start, max(ts) + interval 2 hours as stop, count(*) as n from s group by user_id, k""")
def session_windows(t: Tables) -> DataFrame:
    w = F.session_window("ts", "2 hours")
    return t.events.groupBy("user_id", w.alias("w")).agg(count_n()).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


@query("str_daily_quota", """
    select user_id, date_trunc('day', ts) as day, count(*) as n, count(*) > 4 as over_quota from events where event_type = 'click' group by 1, 2""")
def daily_quota(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'click'").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(count_n(), (F.count(F.lit(1)) > 4).alias("over_quota"))


@query("str_concurrency", """
    with e as (select event_type as k, epoch_us(ts) as micros, 1 as d from events union all select event_type, epoch_us(ts) + 3600000000, -1 from events), r as (select k, sum(d) over (partition by k order by micros, d rows between unbounded preceding and current row) as n from e) select k, cast(max(n) as bigint) as most from r group by 1""")
def concurrency(t: Tables) -> DataFrame:
    """Most sessions of an hour at once, of each kind: a running sum of starts and ends, within bins of an hour and over the bins."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    moves = t.events.select(F.col("event_type").alias("k"), F.explode(F.array(F.struct(at.alias("at"), F.lit(1).alias("d")), F.struct((at + 3600000000).alias("at"), F.lit(-1).alias("d")))).alias("m"))
    binned = moves.select("k", F.floor(F.col("m.at") / 3600000000).alias("bin"), "m.at", "m.d")
    before = F.coalesce(F.sum("net").over(W.partitionBy("k").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = binned.groupBy("k", "bin").agg(F.sum("d").alias("net")).select("k", "bin", before.alias("open"))
    run = F.sum("d").over(W.partitionBy("k", "bin").orderBy("at", "d").rowsBetween(W.unboundedPreceding, 0))
    within = binned.select("k", "bin", run.alias("n")).groupBy("k", "bin").agg(F.max("n").alias("n"))
    return within.join(bins, ["k", "bin"]).groupBy("k").agg(F.max(F.col("open") + F.col("n")).alias("most"))


@query("str_expiry", """
    select user_id, max(ts) as last_seen, (select max(ts) from events) - max(ts) > interval 6 hours as expired, arg_max(event_type, row(ts, event_id)) as state from events group by 1""")
def expiry(t: Tables) -> DataFrame:
    """Keys that have been silent for six hours at the end."""
    end = t.events.agg(F.max("ts")).scalar()
    seen = t.events.groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return seen.select("user_id", "last_seen", (end - F.col("last_seen") > F.expr("interval 6 hours")).alias("expired"), "state")


@query("str_stage_pivot", """
    with s as (select user_id, event_type, min(ts) as first from events group by 1, 2), p as (select user_id, max(first) filter (where event_type = 'view') as v, max(first) filter (where event_type = 'click') as c, max(first) filter (where event_type = 'purchase') as b from s group by 1)
    select user_id, round((epoch_us(c) - epoch_us(v)) / 1000.0, 3) as view_to_click, round((epoch_us(b) - epoch_us(c)) / 1000.0, 3) as click_to_purchase, b is not null as done from p""")
def stage_pivot(t: Tables) -> DataFrame:
    """First times of the stages of each key, as latencies."""
    first = t.events.groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.min("ts"))
    ms = lambda a, b: F.round((F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / F.lit(1000.0), 3)
    return first.select("user_id", ms("view", "click").alias("view_to_click"), ms("click", "purchase").alias("click_to_purchase"), F.col("purchase").isNotNull().alias("done"))


@query("str_deduplicated", """
    select user_id, event_type, min(event_id) as first_id, count(*) as seen from events group by user_id, event_type, date_trunc('hour', ts)""")
def deduplicated(t: Tables) -> DataFrame:
    """One event of a kind and hour."""
    return t.events.groupBy("user_id", "event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("seen")).drop("h")


@query("str_event_reducer", """
    with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events)
    select user_id, arg_max(value, row(ts, event_id)) filter (where event_type = 'view') as last_view, arg_max(props, row(ts, event_id)) filter (where event_type = 'click') as last_click, count(*) filter (where event_type not in ('view', 'click', 'purchase')) as unknown,
           array_to_string(list(event_id order by ts, event_id) filter (where rn <= 10), ',') as recent from r group by 1""")
def event_reducer(t: Tables) -> DataFrame:
    """The latest of each kind, a bounded list of the last, and a count of unknown kinds."""
    ranked = t.events.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    latest = lambda col, kind: F.max_by(F.when(F.col("event_type") == kind, F.col(col)), F.when(F.col("event_type") == kind, F.struct("ts", "event_id")))
    recent = F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 10, F.struct("ts", "event_id")))), lambda x: x["event_id"])
    return ranked.groupBy("user_id").agg(latest("value", "view").alias("last_view"), latest("props", "click").alias("last_click"), F.count_if(~F.col("event_type").isin("view", "click", "purchase")).alias("unknown"), F.array_join(recent, ",").alias("recent"))


@query("str_ping_pong", """
    with p as (select event_id, user_id, json_extract_string(props, '$.k') as k, ts from events where event_type = 'click'), q as (select user_id, json_extract_string(props, '$.k') as k, ts from events where event_type = 'view')
    select p.event_id, round(min(epoch_us(q.ts) - epoch_us(p.ts)) / 1000000.0, 6) as lag_s from p join q on p.user_id = q.user_id and p.k = q.k and q.ts >= p.ts and q.ts <= p.ts + interval 10 days group by 1""")
def ping_pong(t: Tables) -> DataFrame:
    """The answer to each ping of an id within a bound of time."""
    of = lambda kind, ts: t.events.where(F.col("event_type") == kind).select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"), F.col("ts").alias(ts))
    pairs = of("click", "sent").join(of("view", "back").drop("event_id"), ["user_id", "k"]).where("back >= sent and back <= sent + interval 10 days")
    lag = F.unix_micros(F.col("back").cast("timestamp")) - F.unix_micros(F.col("sent").cast("timestamp"))
    return pairs.groupBy("event_id").agg(F.round(F.min(lag) / F.lit(1000000.0), 6).alias("lag_s"))


@query("str_debounce")
def debounce(t: Tables) -> DataFrame:
    """Events that fire: at least an hour after the last that fired. Recursive, so a fold for each key."""
    return O.debounce_batch(t.events.select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 3600.0)


@query("str_rate_limit")
def rate_limit(t: Tables) -> DataFrame:
    """Admitted requests: at most three admitted ones in any six hours of a key."""
    return O.rate_limit_batch(t.events.select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 3, 6 * 3600.0)


@query("str_adaptive_gate", """
    with f as (select user_id, event_id, ts, value, quantile_cont(value, 0.25) over (partition by user_id order by ts, event_id rows between 20 preceding and 1 preceding) as floor from events), g as (select *, value > coalesce(least(floor + 20, 80), 80) as loud from f)
    select event_id, round(floor, 6) as noise, loud, max(case when loud then 1 else 0 end) over (partition by user_id order by ts, event_id rows between 2 preceding and current row) = 1 as open from g""")
def adaptive_gate(t: Tables) -> DataFrame:
    """A gate that opens above the noise of the last twenty frames and a margin, and stays open for two more."""
    floor = F.expr("percentile(value, 0.25d) over (partition by user_id order by ts, event_id rows between 20 preceding and 1 preceding)")
    f = t.events.select("user_id", "event_id", "ts", "value", floor.alias("noise"))
    g = f.withColumn("loud", F.col("value") > F.coalesce(F.least(F.col("noise") + 20, F.lit(80.0)), F.lit(80.0)))
    hang = F.max(F.when(F.col("loud"), 1).otherwise(0)).over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0))
    return g.select("event_id", F.round("noise", 6).alias("noise"), "loud", (hang == 1).alias("open"))


@query("str_turn_filler", """
    with i as (select *, sum(case when event_type = 'view' then 1 else 0 end) over (partition by user_id order by ts, event_id) as turn from events), q as (select *, sum(case when event_type = 'click' then 1 else 0 end) over w as quiet, sum(case when event_type = 'signup' then 1 else 0 end) over w as checks from i window w as (partition by user_id, turn order by ts, event_id))
    select user_id, count(*) as fillers, min(event_id) as first from q where event_type = 'click' and quiet = 2 and checks = 0 and turn > 0 group by 1""")
def turn_filler(t: Tables) -> DataFrame:
    """A filler at the second quiet frame after a user's turn, once a turn; a check line or the user's next turn cancels it."""
    is_ = lambda kind: F.when(F.col("event_type") == kind, 1).otherwise(0)
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    turns = t.events.withColumn("turn", F.sum(is_("view")).over(order))
    within = W.partitionBy("user_id", "turn").orderBy("ts", "event_id")
    counted = turns.withColumn("quiet", F.sum(is_("click")).over(within)).withColumn("checks", F.sum(is_("signup")).over(within))
    return counted.where("event_type = 'click' and quiet = 2 and checks = 0 and turn > 0").groupBy("user_id").agg(count_n().alias("fillers"), F.min("event_id").alias("first"))


@query("str_turn_release", """
    with n as (select event_id, user_id, event_type, ts, lead(event_type) over w as next, lead(ts) over w as next_ts, lead(event_type, 2) over w as after from events window w as (partition by user_id order by ts, event_id))
    select event_id, case when next_ts is null or next_ts > ts + interval 12 hours then 'timeout_silent' when next = 'view' then 'barge_in' when next = 'purchase' then 'hold' when next = 'click' and after = 'click' then 'b2b' when next = 'click' then 'model_end' else 'tail' end as reason, round(least(coalesce(epoch_us(next_ts) - epoch_us(ts), 43200000000), 43200000000) / 1000000.0, 3) as held_s from n where event_type = 'purchase'""")
def turn_release(t: Tables) -> DataFrame:
    """Why a held turn is released: by what comes next, or after a time without anything."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    n = t.events.select("event_id", "event_type", "ts", F.lead("event_type").over(w).alias("next"), F.lead("ts").over(w).alias("next_ts"), F.lead("event_type", 2).over(w).alias("after")).where("event_type = 'purchase'")
    late = F.col("next_ts").isNull() | (F.col("next_ts") > F.col("ts") + F.expr("interval 12 hours"))
    nxt = F.col("next")
    reason = F.when(late, "timeout_silent").when(nxt == "view", "barge_in").when(nxt == "purchase", "hold").when((nxt == "click") & (F.col("after") == "click"), "b2b").when(nxt == "click", "model_end").otherwise("tail")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    held = F.least(F.coalesce(micros("next_ts") - micros("ts"), F.lit(43200000000)), F.lit(43200000000))
    return n.select("event_id", reason.alias("reason"), F.round(held / F.lit(1000000.0), 3).alias("held_s"))


@query("str_session_states", """
    with s as (select user_id, ts, event_id, case event_type when 'signup' then 'queued' when 'view' then 'ready' when 'click' then 'live' when 'purchase' then 'ended' else 'idle' end as state from events), l as (select *, lag(state) over w as before, lag(ts) over w as since from s window w as (partition by user_id order by ts, event_id))
    select before, state, count(*) as n, round(sum(epoch_us(ts) - epoch_us(since)) / 1000000.0, 3) as seconds, (before = 'queued' and state = 'ready') or (before = 'ready' and state = 'live') or (before = 'live' and state = 'ended') or before = state as allowed from l where before is not null group by 1, 2""")
def session_states(t: Tables) -> DataFrame:
    """Changes of state of sessions with the time before them, and whether they are allowed."""
    kind = F.col("event_type")
    state = F.when(kind == "signup", "queued").when(kind == "view", "ready").when(kind == "click", "live").when(kind == "purchase", "ended").otherwise("idle")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    s = t.events.select("user_id", "ts", "event_id", state.alias("state"))
    pairs = s.select("state", F.lag("state").over(w).alias("before"), (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))).alias("micros")).where("before is not null")
    steps = F.concat_ws(">", "before", "state").isin("queued>ready", "ready>live", "live>ended") | (F.col("before") == F.col("state"))
    return pairs.groupBy("before", "state").agg(count_n(), F.round(F.sum("micros") / F.lit(1000000.0), 3).alias("seconds")).withColumn("allowed", steps)


@query("str_frame_lag", """
    with a as (select user_id, ts, row_number() over (partition by user_id order by ts, event_id) as k from events where event_type = 'view'), b as (select user_id, ts, row_number() over (partition by user_id order by ts, event_id) as k from events where event_type = 'click'), j as (select a.user_id, (epoch_us(b.ts) - epoch_us(a.ts)) / 1000.0 as ms from a join b using (user_id, k))
    select user_id, count(*) as frames, round(quantile_cont(ms, 0.5), 3) as p50, round(quantile_cont(ms, 0.95), 3) as p95, count(*) filter (where ms < 0) as before_sent from j group by 1""")
def frame_lag(t: Tables) -> DataFrame:
    """Times between sending frame k and its arrival, with percentiles."""
    k = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    side = lambda kind, name: t.events.where(F.col("event_type") == kind).select("user_id", k.alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias(name))
    j = side("view", "sent").join(side("click", "came"), ["user_id", "k"]).withColumn("ms", (F.col("came") - F.col("sent")) / F.lit(1000.0))
    p = lambda q: F.round(F.expr(f"percentile(ms, {q}d)"), 3)
    return j.groupBy("user_id").agg(count_n().alias("frames"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.count_if(F.col("ms") < 0).alias("before_sent"))


@query("str_segment_texts", """
    with e as (select *, event_type || case when event_type = 'purchase' then '. ' else ' ' end as piece from events), f as (select *, lag(ts) over w as before, lag(event_type) over w as last from e window w as (partition by user_id order by ts, event_id)), s as (select *, sum(case when before is null or ts - before > interval 12 hours or last = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id) as seg from f)
    select user_id, arg_min(event_id, row(ts, event_id)) as first, min(epoch_us(ts)) as start, max(epoch_us(ts)) as stop, trim(string_agg(piece, '' order by ts, event_id)) as text, cast(count(*) as int) as pieces from s group by user_id, seg""")
def segment_texts(t: Tables) -> DataFrame:
    """Texts of segments, closed by a gap of more than twelve hours or early by a piece that ends a sentence; the machine that also runs on streams."""
    piece = F.concat("event_type", F.when(F.col("event_type") == "purchase", ". ").otherwise(" "))
    return M.fold_batch(t.events.withColumn("piece", piece), "user_id", "ts", "event_id", ["piece", "event_id"], lambda: D.Segments(12 * 3600), D.Segments.FIELDS).drop("closed")


HOUR = 3600.0
PATIENCE = D.Patience(2 * HOUR, 4 * HOUR, HOUR, 6 * HOUR, 10 * HOUR, 20 * HOUR, 15 * HOUR, 3 * HOUR, 30 * HOUR)
LIMITS = D.Limits(12 * HOUR, 12 * HOUR, 24 * HOUR, 6 * HOUR)


def told(t: Tables, **kinds: str) -> DataFrame:
    """Events with the kind that each type stands for."""
    pairs = [x for name, kind in kinds.items() for x in (F.lit(name), F.lit(kind))]
    return t.events.withColumn("kind", F.create_map(*pairs)[F.col("event_type")]).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


@query("str_turn_machine")
def turn_machine(t: Tables) -> DataFrame:
    """All reasons for which a caller's turn is released or held, with timers: purchases are turns, all else is the model's speech."""
    words = F.create_map(*[F.lit(x) for x in ("click", "Yes.", "view", " and", "signup", " hold on")])[F.col("event_type")]
    turn = F.col("kind") == "turn"
    rows = told(t, click="speech", view="speech", signup="speech", error="speech", purchase="turn").select("user_id", "ts", "event_id", "kind", words.alias("piece"), F.when(turn, F.col("value") * 60).alias("seconds"), F.when(turn, F.col("k") < 30).alias("again"))
    return M.fold_batch(rows, "user_id", "ts", "event_id", ["kind", "piece", "seconds", "again"], lambda: D.Release(PATIENCE), D.Release.FIELDS)


@query("str_filler_machine")
def filler_machine(t: Tables) -> DataFrame:
    """Fillers after two quiet hours, but not after a sign-up; a purchase is the user's voice."""
    rows = told(t, click="model", view="model", signup="model", error="model", purchase="user").withColumn("piece", F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")))
    return M.fold_batch(rows, "user_id", "ts", "event_id", ["kind", "piece"], lambda: D.Filler(2 * HOUR, HOUR, "signup"), D.Filler.FIELDS)


@query("str_session_machine")
def session_machine(t: Tables) -> DataFrame:
    """States of sessions with the time in each; what nobody takes, asks for or ends is closed by timers."""
    rows = told(t, signup="waking", error="busy", view="ready", click="in_call", purchase="ended")
    return M.fold_batch(rows, "user_id", "ts", "event_id", ["kind"], lambda: D.Session(LIMITS), D.Session.FIELDS)


@query("str_slot_claims")
def slot_claims(t: Tables) -> DataFrame:
    """Claims of the slot that the props name, by users; an unused claim lapses after six hours."""
    rows = told(t, click="claim", view="claim", signup="start", purchase="release").select("k", "ts", "event_id", "kind", F.col("user_id").cast("string").alias("who"), (F.col("user_id") % 2).cast("string").alias("terms"))
    return M.fold_batch(rows, "k", "ts", "event_id", ["kind", "who", "terms"], lambda: D.Claims(6 * HOUR), D.Claims.FIELDS)


@query("str_gate_frames", """
    with f as (select user_id, event_id, ts, value, count(*) over w as n, quantile_cont(value, 0.25) over w as floor from events window w as (partition by user_id order by ts, event_id rows between 19 preceding and current row)),
    g as (select *, case when n >= 5 then floor end as noise, case when n >= 5 then least(greatest(10.0, floor + 20), 80.0) else 10.0 end as opening from f)
    select event_id, round(noise, 6) as noise, round(opening, 6) as opening, max(case when value > opening then 1 else 0 end) over (partition by user_id order by ts, event_id rows between 2 preceding and current row) = 1 as open from g""")
def gate_frames(t: Tables) -> DataFrame:
    """The gate of each frame, from the order statistic that the machine keeps of the last twenty frames."""
    f = M.fold_batch(t.events, "user_id", "ts", "event_id", ["value", "event_id"], D.Gate, D.Gate.FIELDS, timeless=True)
    # Rounded as numbers, as SQL does: by its written digits, a number just below a half would go up. What has no millionths left stays.
    rounded = lambda c: F.when(F.abs(c) > 1e300, F.col(c)).otherwise(F.round(F.col(c) * 1000000.0) / 1000000.0).alias(c)
    return f.select(F.col("id").alias("event_id"), rounded("noise"), rounded("opening"), "open")


@query("str_gate_gain")
def gate_gain(t: Tables) -> DataFrame:
    """Gate and gain of each frame: the gain follows the level of speech, fast up and slowly down."""
    return M.fold_batch(t.events, "user_id", "ts", "event_id", ["value", "event_id"], D.Gate, D.Gate.FIELDS)


def sides(t: Tables, asks: str, answers: str) -> tuple[DataFrame, DataFrame]:
    of = lambda kind: t.events.where(F.col("event_type") == kind).select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"), "ts")
    return of(asks), of(answers)


@query("str_answers", """
    with e as (select event_id, user_id, json_extract_string(props, '$.k') as k, ts, event_type from events)
    select p.event_id, round((epoch_us(q.ts) - epoch_us(p.ts)) / 1000000.0, 6) as lag_s from e p left join e q on q.event_type = 'view' and p.user_id = q.user_id and p.k = q.k and q.ts >= p.ts and q.ts <= p.ts + interval 3 days where p.event_type = 'click'""")
def answers(t: Tables) -> DataFrame:
    """Every ping with its answers within three days, and the lost ones; the same join runs on two streams."""
    return C.answered(*sides(t, "click", "view"), ["user_id", "k"], "ts", "3 days", "1 hour").select("event_id", "lag_s")


@query("str_answer_report", """
    with e as (select event_id, user_id, json_extract_string(props, '$.k') as k, ts, event_type from events), j as (select p.ts, (epoch_us(q.ts) - epoch_us(p.ts)) / 1000000.0 as lag from e p left join e q on q.event_type = 'view' and p.k = q.k and q.ts >= p.ts and q.ts <= p.ts + interval 6 hours where p.event_type = 'click')
    select date_trunc('day', ts) as start, count(lag) as answered, count(*) filter (where lag is null) as lost, round(quantile_cont(lag, 0.5), 6) as p50, round(quantile_cont(lag, 0.95), 6) as p95 from j group by 1""")
def answer_report(t: Tables) -> DataFrame:
    """Answers by frame number alone within six hours, by day: a hundred ids share all rows, so the bins of time deal them out; rows of the same frame and time are joined once, and no lag is kept."""
    asked, given = (side.groupBy("k", "ts").agg(count_n()) for side in sides(t, "click", "view"))
    pairs = C.answered(asked.withColumnRenamed("n", "asks"), given, ["k"], "ts", "6 hours", "1 hour", carried=("n",))
    weighed = pairs.select(F.col("ts").cast("timestamp").alias("ts"), "lag_s", (F.col("asks") * F.coalesce("n", F.lit(1))).alias("times"))
    return C.lag_report(weighed, "ts", "1 day", "times").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str_frame_delivery", """
    with e as (select user_id, json_extract_string(props, '$.k') as k, ts, event_type from events), j as (select p.user_id, (epoch_us(q.ts) - epoch_us(p.ts)) / 1000.0 as ms from e p left join e q on q.event_type = 'error' and p.user_id = q.user_id and p.k = q.k and q.ts >= p.ts and q.ts <= p.ts + interval 10 days where p.event_type = 'signup')
    select user_id, count(*) as frames, count(*) filter (where ms is null) as lost, round(quantile_cont(ms, 0.5), 3) as p50, round(quantile_cont(ms, 0.95), 3) as p95 from j group by 1""")
def frame_delivery(t: Tables) -> DataFrame:
    """Times from the sending of frame k to its arrival by sender, with lost frames."""
    pairs = C.answered(*sides(t, "signup", "error"), ["user_id", "k"], "ts", "10 days", "1 hour").withColumn("ms", F.col("lag_s") * 1000)
    p = lambda q: F.round(F.expr(f"percentile(ms, {q}d)"), 3)
    return pairs.groupBy("user_id").agg(count_n().alias("frames"), F.count_if(F.col("ms").isNull()).alias("lost"), p(0.5).alias("p50"), p(0.95).alias("p95"))
