"""Machines over batches and streams: equal to each other, and to plain simulations in ticks."""

import random
import re
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vakya.plans import streams as Q
from vakya.plans.registry import QUERIES
from vakya.streaming import correlate as C
from vakya.streaming import dialogue as D
from vakya.streaming import machines as M

START = datetime(2024, 1, 1)
T0 = int((START - datetime(1970, 1, 1)).total_seconds())
CHECK = r"let me check"


def at(second):
    return START + timedelta(seconds=second)


def fold(make, rows):
    """Plain run of one machine over [(second, *values)]."""
    machine, out = make(), []
    for second, *row in rows:
        out += M.woken(machine, M.SECOND * second)
        out += machine.on(M.SECOND * second, tuple(row))
    return [*out, *M.woken(machine, None)]


# ------------------------------------------------------------------ simulations in ticks


def release_by_ticks(rows, p, last):
    """A second a tick, looking at counters as a call does frame by frame."""
    out, queue, k = [], [], 0
    quiet, sentence, utterance, said, stop = 10**6, False, "", "", None
    wait, playing, heard, onset, hold_logged, ended = None, None, False, None, None, False
    need = lambda: p.after_sentence if sentence else p.within_sentence
    speaking = False
    events = {}
    for second, *row in rows:
        events.setdefault(second, []).append(row)

    def look(t):
        nonlocal playing, wait, heard, onset, stop, said, utterance, speaking, k, hold_logged, ended
        if playing is not None and t >= playing:
            wait, playing, stop, said = t, None, None, ""
            heard, onset = speaking, t if speaking else None
            if not speaking:
                utterance = ""
        if wait is None or playing is not None or ended is None:
            return
        waited = t - wait
        if not queue:
            if ended:
                silent = quiet if heard or quiet < 10**5 else 10**6
                if waited >= p.tail:
                    out.append((t, "tail_cap", waited, speaking, -1))
                    ended = None
                elif waited >= p.tail_quiet and silent >= p.tail_quiet:
                    out.append((t, "tail_quiet", waited, speaking, -1))
                    ended = None
            return
        reason = None
        if queue[0][1] and not speaking:
            reason = "b2b" if waited >= p.back_to_back else None
        elif heard and not speaking:
            reason = "model_end"
            if stop is not None and re.search(p.holding, said):
                reason = "hold_timeout" if t - stop >= p.hold else None
                if reason is None and hold_logged != stop:
                    hold_logged = stop
                    out.append((t, "hold", waited, False, k))
        elif not heard and waited >= (p.silence if k else p.opening):
            reason = "timeout_silent"
        elif heard and speaking and t - onset >= p.longest_speech:
            reason = "barge_in"
        if reason:
            out.append((t, reason, waited, speaking, k))
            playing, k = t + queue.pop(0)[0], k + 1
            look(t)

    for t in range(last):
        quiet += 1
        if speaking and quiet >= need():
            speaking, said, utterance, stop = False, utterance, "", t - quiet
        look(t)
        for kind, text, seconds, back_to_back in events.get(t, []):
            if ended is None:
                continue
            wait = t if wait is None else wait
            if kind == "speech":
                if text:
                    sentence, utterance = text.rstrip().endswith((".", "?", "!")), utterance + text
                quiet, speaking = 0, True
                if not heard and playing is None:
                    heard, onset = True, t
            elif kind == "turn":
                queue.append((seconds, back_to_back))
            else:
                ended = True
            look(t)
    return out


PATIENCE = D.Patience(after_sentence=2, within_sentence=4, back_to_back=3, opening=6, silence=9, longest_speech=12, hold=10, tail_quiet=5, tail=20)


def script(rng):
    rows, second = [], 0
    for _ in range(rng.randrange(1, 40)):
        second += rng.choice([0, 1, 1, 2, 3, 5, 8, 14])
        kind = rng.choice(["speech"] * 5 + ["turn"] * 3)
        rows.append((second, kind, rng.choice(["Hello.", " and then", None, " hold on", " One moment!", "?"]), rng.choice([1, 3, 6]), rng.random() < 0.3))
    if rng.random() < 0.7:
        rows.append((second + rng.randrange(0, 30), "end", None, None, None))
    return rows


def in_seconds(out):
    return [(a // M.SECOND, r, w // M.SECOND, s, k) for a, r, w, s, k in out]


def test_release_equals_ticks():
    rng, seen = random.Random(1), set()
    for _ in range(1500):
        rows = script(rng)
        got = in_seconds(fold(lambda: D.Release(PATIENCE), rows))
        assert got == release_by_ticks(rows, PATIENCE, rows[-1][0] + 300), rows
        seen |= {r[1] for r in got}
    assert seen == {"b2b", "model_end", "hold", "hold_timeout", "timeout_silent", "barge_in", "tail_quiet", "tail_cap"}


def filler_by_ticks(rows, quiet, seconds, last):
    out, text, armed, silent, left = [], "", False, 0, 0
    events = {}
    for second, *row in rows:
        events.setdefault(second, []).append(row)
    for t in range(last):
        silent += 1
        left = max(0, left - 1)

        def look():
            nonlocal armed, text, left
            if armed and not left and silent >= quiet:
                skip = re.search(CHECK, text) is not None
                out.append((t, "skip_check" if skip else "fill"))
                armed, text, left = False, "", 0 if skip else seconds

        look()
        for kind, piece in events.get(t, []):
            if kind == "user":
                if left:
                    out.append((t, "cancel"))
                left, armed, text = 0, False, ""
            else:
                silent = 0
                if piece and piece.strip():
                    text, armed = (text + piece)[-160:], True
            look()
    return out


def test_filler_equals_ticks():
    rng, seen = random.Random(2), set()
    for _ in range(800):
        rows, second = [], 0
        for _ in range(rng.randrange(1, 30)):
            second += rng.choice([0, 1, 2, 4, 7, 12])
            rows.append((second, rng.choice(["model", "model", "user"]), rng.choice(["Yes.", " ", None, " let me check", " and"])))
        got = [(a // M.SECOND, k) for a, k in fold(lambda: D.Filler(3, 6, CHECK), rows)]
        assert got == filler_by_ticks(rows, 3, 6, second + 50), rows
        seen |= {k for _, k in got}
    assert seen == {"fill", "skip_check", "cancel"}


def test_sessions_and_claims():
    s = lambda rows: [(b, n, a // M.SECOND, d, ok) for b, n, a, d, ok in fold(D.Session, rows)]
    assert s([(0, "waking"), (30, "poll"), (89, "ready"), (100, "in_call"), (400, "ended"), (401, "waking"), (1001, "waking")]) == [
        (None, "waking", 0, 0.0, True), ("waking", "ready", 89, 59.0 + 30, True), ("ready", "in_call", 100, 11.0, True), ("in_call", "ended", 400, 300.0, True), (None, "waking", 1001, 0.0, True), ("waking", "abandoned", 1061, 60.0, True)]
    assert [r[1] for r in s([(0, "ready"), (91, "in_call")])] == ["ready", "expired"]
    assert [r[1] for r in s([(0, "waking"), (5, "in_call"), (6, "waking")])][:2] == ["waking", "in_call"] and s([(0, "waking"), (5, "in_call")])[1][4] is False
    assert s([(0, "in_call")])[-1][1:4] == ("stuck", 900, 900.0)
    c = lambda rows: [(a // M.SECOND, w, o) for a, w, o in fold(lambda: D.Claims(10), rows)]
    assert c([(0, "claim", "a", "x"), (5, "claim", "a", "x"), (6, "claim", "b", "x"), (7, "claim", "a", "y"), (16, "claim", "b", "x"), (18, "start", "b", None), (60, "claim", "b", "x"), (61, "release", "a", None), (62, "release", "b", None), (63, "claim", "a", "x")]) == [
        (0, "a", "claimed"), (5, "a", "renewed"), (6, "b", "busy"), (7, "a", "mismatch"), (15, "a", "expired"), (16, "b", "claimed"), (18, "b", "started"), (60, "b", "busy"), (62, "b", "released"), (63, "a", "claimed"), (73, "a", "expired")]


def test_gate_and_gain():
    rng, c = random.Random(3), D.Levels()
    values = [rng.choice([rng.gauss(20, 5), rng.gauss(60, 10), 20.0]) for _ in range(400)]
    got = fold(lambda: D.Gate(c), [(i, v, i) for i, v in enumerate(values)])
    opening, level, gain, loud = c.least, None, 0.0, []
    for i, v in enumerate(values):
        window = values[max(0, i - c.window + 1) : i + 1]
        noise = statistics.quantiles(window, n=100, method="inclusive")[24] if len(window) >= c.warm_up else None
        if noise is not None:
            opening = min(max(c.least, noise + c.margin), c.most)
        loud.append(v > opening)
        opened = any(loud[-c.hang - 1 :])
        if opened:
            if v > c.speech:
                level = v if level is None else level + (c.attack if v > level else c.release) * (v - level)
            wanted = 0.0 if level is None else min(max(c.target - level, 0), c.most_gain)
            wanted = wanted if v > c.speech else min(wanted, c.noise_gain)
            gain = max(gain - c.step, min(gain + c.step, wanted))
        assert got[i] == (i, pytest.approx(noise) if noise is not None else None, pytest.approx(opening), opened, pytest.approx(gain))


def test_segments():
    text = [(0, "Hello", 1), (1, " there.", 2), (2, "And", 3), (5, " so", 4), (9, " on", 5), (9, None, 6), (10, "!", 7), (30, "x", 8)]
    assert [(a // M.SECOND, b // M.SECOND, t, n) for _, a, b, t, n, _ in fold(lambda: D.Segments(3), text)] == [(0, 1, "Hello there.", 2), (2, 5, "And so", 2), (9, 10, "on!", 2), (30, 30, "x", 1)]
    assert [r[5] for r in fold(lambda: D.Segments(3, partial=True), text)] == [False, True, False, False, True, False, True, False, True]


# ------------------------------------------------------------------ batches and streams


def files(spark, path, parts, ddl):
    for part in parts:  # one micro-batch each
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], ddl).schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, name, mode="append", checkpoint=None, **trigger):
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(**(trigger or {"availableNow": True}))
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    if not trigger:
        query.awaitTermination(300)
    return query


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


FLUSH = 10_000_000
CASES = {
    "release": ("kind string, piece string, seconds double, again boolean", ["kind", "piece", "seconds", "again"], lambda: D.Release(PATIENCE), D.Release.FIELDS, lambda rng: [(s, k, t, None if n is None else float(n), b) for s, k, t, n, b in script(rng)]),
    "filler": ("kind string, piece string", ["kind", "piece"], lambda: D.Filler(3, 6, CHECK), D.Filler.FIELDS, lambda rng: [(s, "model" if k == "speech" else "user", t) for s, k, t, *_ in script(rng)]),
    "segments": ("piece string", ["piece", "tie"], lambda: D.Segments(3), D.Segments.FIELDS, lambda rng: [(s, t) for s, _, t, *_ in script(rng)]),
    "claims": ("kind string, who string, terms string", ["kind", "who", "terms"], lambda: D.Claims(6), D.Claims.FIELDS, lambda rng: [(s, rng.choice(["claim", "claim", "start", "release"]), rng.choice("ab"), rng.choice("xy")) for s, *_ in script(rng)]),
    "session": ("state string", ["state"], lambda: D.Session(D.Limits(8, 6, 20, 15)), D.Session.FIELDS, lambda rng: [(s, rng.choice(["waking", "poll", "busy", "ready", "in_call", "ended", None])) for s, *_ in script(rng)]),
    "gate": ("level double, id long", ["level", "id"], lambda: D.Gate(D.Levels(window=6)), D.Gate.FIELDS, lambda rng: [(s, rng.choice([20.0, 35.5, 70.0, None]), i) for i, (s, *_) in enumerate(script(rng))]),
}


@pytest.mark.parametrize("name", CASES)
def test_stream_equals_batch(spark, tmp_path, name):
    """Rows come unordered within the watermark; one comes too late; timers fire although no row comes for the key any more; nothing is left of closed keys."""
    ddl, columns, make, fields, made = CASES[name]
    rng = random.Random(name)
    every, tie = [], 0
    for key in range(12):
        for second, *row in made(rng):
            tie += 1
            every.append((key, tie, at(100 + second), *row))
    every.sort(key=lambda r: r[2] + timedelta(seconds=rng.uniform(0, 8)))
    ddl = f"key long, tie long, ts timestamp_ntz, {ddl}"
    late = (3, 10_000, at(0), *every[0][3:])
    flush = [(99, 20_000 + i, at(FLUSH * (i + 1)), *every[0][3:]) for i in range(2)]
    half = len(every) // 2
    parts = [every[:half], every[half:], [late, (99, 19_999, at(5000), *every[0][3:])], flush[:1], flush[1:]]
    stream = M.fold_stream(files(spark, str(tmp_path / "in"), parts, ddl), "key", "ts", "tie", columns, make, fields, "20 seconds")
    query = run(stream, f"machine_{name}", checkpoint=str(tmp_path / "cp"))
    batch = M.fold_batch(spark.createDataFrame(every, ddl), "key", "ts", "tie", columns, make, fields)
    got, want = rows_of(spark.table(f"machine_{name}").where("key < 99")), rows_of(batch)
    assert got == want and len(want) > 20
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 60
    if name not in ("gate", "release"):  # those have no end, or remember that it has come
        assert not [r for r in M.saved_state(spark, str(tmp_path / "cp"), "key").collect() if r.key < 99 and '"until": null' not in r.machine]  # a claim that is in use stays


def test_partial_segments_are_replaced(spark, tmp_path):
    ddl, rng, every = "key long, tie long, ts timestamp_ntz, piece string", random.Random(5), []
    for key in range(6):
        every += [(key, 1000 * key + i, at(s), t) for i, (s, _, t, *_) in enumerate(script(rng))]
    every.sort(key=lambda r: r[2])
    parts = [every[i : i + 20] for i in range(0, len(every), 20)] + [[(99, 0, at(FLUSH), "x")], [(99, 1, at(2 * FLUSH), "x")]]
    stream = M.fold_stream(files(spark, str(tmp_path / "in"), parts, ddl), "key", "ts", "tie", ["piece", "tie"], lambda: D.Segments(3, True), D.Segments.FIELDS, "1 second", mode="update")
    run(stream, "partial", "update")
    shown = {}
    for r in spark.table("partial").where("key < 99").collect():
        assert not (shown.get((r.key, r.first)) and shown[r.key, r.first].closed)
        shown[r.key, r.first] = r
    want = rows_of(M.fold_batch(spark.createDataFrame(every, ddl), "key", "ts", "tie", ["piece", "tie"], lambda: D.Segments(3), D.Segments.FIELDS))
    assert sorted((tuple(r) for r in shown.values()), key=repr) == want
    assert spark.table("partial").where("not closed").count() > 5


def test_restart_from_a_snapshot(spark, tmp_path):
    """A query that is seeded with the state of a stopped one goes on as if it had never stopped."""
    ddl, rng, every = "key long, tie long, ts timestamp_ntz, kind string, who string, terms string", random.Random(6), []
    for key in range(8):
        every += [(key, 1000 * key + i, at(5 * i + rng.randrange(4)), rng.choice(["claim", "claim", "start", "release"]), rng.choice("ab"), rng.choice("xy")) for i in range(30)]
    every.sort(key=lambda r: r[2])
    flush = [[(99, i, at(FLUSH * (i + 1)), "release", "a", "x")] for i in range(2)]
    fold_of = lambda parts, name, snapshot=None: M.fold_stream(files(spark, str(tmp_path / name), parts, ddl), "key", "ts", "tie", ["kind", "who", "terms"], lambda: D.Claims(40), D.Claims.FIELDS, "2 seconds", snapshot=snapshot)
    run(fold_of([every[:120], every[120:], *flush], "whole"), "unbroken")
    run(fold_of([every[:60], every[60:120]], "first"), "before", checkpoint=str(tmp_path / "cp"))
    snapshot = spark.createDataFrame(M.saved_state(spark, str(tmp_path / "cp"), "key").collect(), "key long, machine string, pending string")
    assert 0 < snapshot.count() <= 8
    run(fold_of([every[120:], *flush], "second", snapshot), "after")
    parts = spark.table("before").unionByName(spark.table("after")).where("key < 99")
    assert rows_of(parts) == rows_of(spark.table("unbroken").where("key < 99")) and parts.count() > 60


def test_timers_of_processing_time(spark, tmp_path):
    """With the clock of the machine, a claim lapses although no row ever comes again."""
    ddl = "key long, tie long, ts timestamp_ntz, kind string, who string, terms string"
    source = files(spark, str(tmp_path / "in"), [[(k, k, at(0), "claim", "a", "x") for k in range(3)]], ddl)
    query = run(M.fold_stream_now(source, "key", "ts", "tie", ["kind", "who", "terms"], lambda: D.Claims(2), D.Claims.FIELDS), "lapsed", processingTime="1 second")
    try:
        for _ in range(120):
            query.awaitTermination(1)
            if spark.table("lapsed").where("outcome = 'expired'").count() == 3:
                break
        assert rows_of(spark.table("lapsed").select("key", "outcome")) == sorted(((k, o) for k in range(3) for o in ("claimed", "expired")), key=repr)
    finally:
        query.stop()


def test_odd_rows_in_a_batch(spark):
    ddl = "key long, tie long, ts timestamp_ntz, piece string"
    rows = [(None, 1, at(0), "a"), (None, 2, at(1), "b."), (1, 3, None, "lost"), (1, 4, at(2), None), (2, 5, at(3), "x" * 100_000), (2, 5, at(3), "x" * 100_000)]
    got = M.fold_batch(spark.createDataFrame(rows, ddl), "key", "ts", "tie", ["piece", "tie"], lambda: D.Segments(3), D.Segments.FIELDS)
    assert [(r.key, len(r.text), r.pieces) for r in sorted(got.collect(), key=lambda r: r.pieces * 10 + (r.key or 0))] == [(None, 3, 2), (2, 200_000, 2)]
    assert M.fold_batch(spark.createDataFrame([], ddl), "key", "ts", "tie", ["piece", "tie"], lambda: D.Segments(3), D.Segments.FIELDS).count() == 0


# ------------------------------------------------------------------ joins of streams


def test_answers_in_streams(spark, tmp_path):
    """Late answers and lost questions: the stream gives the rows of the batch, and little is left to wait."""
    rng = random.Random(7)
    asked = [(k, k % 5, at(3 * k + rng.random())) for k in range(200)]
    answers = [(k, k % 5, t + timedelta(seconds=rng.choice([0.2, 1, 29, 30, 31, -1]))) for k, _, t in asked if rng.random() < 0.7]
    answers += rng.sample(answers, 20)
    answers.sort(key=lambda r: r[2])
    ddl = "id long, who long, ts timestamp"
    chunks = lambda rows, late: [rows[i : i + 50] for i in range(0, len(rows), 50)] + [late, [(10**6, 0, at(FLUSH))], [(10**6 + 1, 0, at(2 * FLUSH))]]
    too_late = [(0, 0, asked[0][2] + timedelta(seconds=0.5))] if not any(a[0] == 0 for a in answers) else [(10**7, 0, at(1))]
    a = files(spark, str(tmp_path / "a"), chunks(asked, [(10**6 + 5, 0, at(2000))]), ddl)
    b = files(spark, str(tmp_path / "b"), chunks(answers, too_late), ddl)
    query = run(C.answered(a, b, ["id", "who"], "ts", "30 seconds", "5 seconds"), "answers")
    want = C.answered(spark.createDataFrame(asked, ddl), spark.createDataFrame(answers, ddl), ["id", "who"], "ts", "30 seconds", "5 seconds")
    got = rows_of(spark.table("answers").where("id < 1000000"))
    assert got == rows_of(want) and sum(r[3] is None for r in got) > 40 and sum(r[3] is not None for r in got) > 80
    plain = [(k, w, t, x, round((x - t).total_seconds(), 6)) for k, w, t in asked for j, _, x in answers if j == k and timedelta(0) <= x - t <= timedelta(seconds=30)]
    assert sorted(map(tuple, want.where("back is not null").collect())) == sorted(plain)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 12


def test_lags_by_period(spark):
    pairs = spark.createDataFrame([(1, at(0), 1.0), (2, at(5), 3.0), (3, at(6), None), (4, at(70), None)], "id long, ts timestamp, lag_s double")
    assert rows_of(C.lag_report(pairs, "ts", "1 minute").select(F.col("start").cast("timestamp_ntz"), "answered", "lost", "p50", "p95")) == sorted([(at(0), 2, 1, 2.0, 2.9), (at(60), 0, 1, None, None)], key=repr)


# ------------------------------------------------------------------ the registered queries


@pytest.mark.parametrize(("name", "make", "event"), [
    ("str_turn_machine", lambda: D.Release(Q.PATIENCE), lambda r: {"click": ("speech", "Yes.", None, None), "view": ("speech", " and", None, None), "signup": ("speech", " hold on", None, None), "error": ("speech", None, None, None), "purchase": ("turn", None, r.value * 60, int(r.props[6:-1]) < 30)}[r.event_type]),
    ("str_filler_machine", lambda: D.Filler(7200, 3600, "signup"), lambda r: ("user" if r.event_type == "purchase" else "model", " " if r.event_type == "error" else r.event_type)),
    ("str_session_machine", lambda: D.Session(Q.LIMITS), lambda r: ({"signup": "waking", "error": "busy", "view": "ready", "click": "in_call", "purchase": "ended"}[r.event_type],)),
    ("str_slot_claims", lambda: D.Claims(6 * 3600), lambda r: ({"click": "claim", "view": "claim", "signup": "start", "purchase": "release", "error": None}[r.event_type], str(r.user_id), str(r.user_id % 2))),
    ("str_gate_gain", D.Gate, lambda r: (r.value, r.event_id)),
])
def test_queries_equal_plain_folds(spark, name, make, event):
    """The machines are held against ticks above; here each query is one machine a key over the whole table."""
    key = (lambda r: int(r.props[6:-1])) if name == "str_slot_claims" else (lambda r: r.user_id)
    machines, want = {}, []
    for r in sorted(spark.read.parquet("/root/testdata/sf0.01/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        now, k = round((r.ts - datetime(1970, 1, 1)) / timedelta(microseconds=1)), key(r)
        machine = machines.setdefault(k, make())
        want += [(k, *x) for x in M.woken(machine, now)]
        want += [(k, *x) for x in machine.on(now, event(r))]
    for k, machine in machines.items():
        want += [(k, *x) for x in M.woken(machine, None)]
    rounded = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    got = rounded(QUERIES[name](spark, "/root/testdata/sf0.01").collect())
    assert got == rounded(want) and len(got) > 300
