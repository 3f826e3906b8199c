"""Machines of calls: segments, fillers, release of turns, sessions, claims of a slot, gate and gain."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

from .machines import SECOND, Machine

CLOSING = (".", "?", "!")


def micros(seconds: float) -> int:
    return round(seconds * SECOND)


#: a * b + c, rounded once.
fma = getattr(math, "fma", None) or (lambda a, b, c: float(Fraction(a) * Fraction(b) + Fraction(c)))


class Segments(Machine):
    """Pieces of text become segments, which end after a silence of more than ``gap`` seconds, or early with a piece that closes a sentence.

    Events: (piece, id). Rows: first (the id of the first piece), start, stop, text, pieces, closed. With ``partial`` a
    row comes for each piece, which replaces the one before of the same key and first id; without, only closed segments
    are given out.
    """

    FIELDS = "first long, start long, stop long, text string, pieces int, closed boolean"

    def __init__(self, gap: float, partial: bool = False) -> None:
        super().__init__()
        self.gap, self.partial = micros(gap), partial

    def row(self, closed: bool) -> tuple:
        s = self.s
        found = (s["first"], s["start"], s["stop"], s["text"].strip(), s["pieces"], closed)
        if closed:
            self.s = {}
        return found

    def on(self, at: int, row: tuple) -> Iterable[tuple]:
        piece, event = row
        if piece is None:
            return
        s = self.s or {"first": event, "start": at, "text": "", "pieces": 0}
        self.s = s | {"stop": at, "text": s["text"] + piece, "pieces": s["pieces"] + 1}
        closed = piece.rstrip().endswith(CLOSING)
        if closed or self.partial:
            yield self.row(closed)

    def due(self) -> int | None:
        return self.s["stop"] + self.gap + 1 if self.s else None

    def wake(self, at: int) -> Iterable[tuple]:
        yield self.row(True)

    def idle(self) -> bool:
        return not self.s


class Filler(Machine):
    """Fills the silence after the model's turn: armed by its words, after ``quiet`` seconds without it; not after a line that announces a check; ended by the user's voice.

    Events: (kind, text) with kind ``model`` or ``user``. Rows: at, kind (fill, skip_check, cancel).
    """

    FIELDS = "at long, kind string"
    TAIL = 160

    def __init__(self, quiet: float, seconds: float, check: str) -> None:
        super().__init__()
        self.quiet, self.seconds, self.check = micros(quiet), micros(seconds), check
        self.s = {"last": None, "text": "", "armed": False, "until": None}

    def on(self, at: int, row: tuple) -> Iterable[tuple]:
        s, (kind, text) = self.s, row
        if kind == "model":
            s["last"] = at
            if text and text.strip():
                s["text"], s["armed"] = (s["text"] + text)[-self.TAIL :], True
        elif kind == "user":
            if s["until"] is not None:
                yield at, "cancel"
            s["until"], s["armed"], s["text"] = None, False, ""

    def due(self) -> int | None:
        s = self.s
        if s["until"] is not None:
            return s["until"]
        return s["last"] + self.quiet if s["armed"] else None

    def wake(self, at: int) -> Iterable[tuple]:
        s = self.s
        if s["until"] is not None and s["until"] <= at:
            s["until"] = None
        if s["armed"] and s["until"] is None and s["last"] + self.quiet <= at:
            skip = re.search(self.check, s["text"]) is not None
            s["armed"], s["text"] = False, ""
            s["until"] = None if skip else at + self.seconds
            yield at, "skip_check" if skip else "fill"

    def idle(self) -> bool:
        return self.s["until"] is None and not self.s["armed"]


@dataclass(frozen=True)
class Patience:
    """Seconds of the release of turns: silence after a whole sentence and within one, waits and caps."""

    after_sentence: float = 0.8
    within_sentence: float = 1.6
    back_to_back: float = 0.4
    opening: float = 6.0
    silence: float = 10.0
    longest_speech: float = 20.0
    hold: float = 15.0
    tail_quiet: float = 3.0
    tail: float = 30.0
    holding: str = r"(?i)\b(hold on|one moment|just a second|let me check)\b"


class Release(Machine):
    """Releases the caller's next turn by what the model does.

    Events: (kind, text, seconds, back_to_back) with kind ``speech`` (a piece of the model's words, or none for sound
    alone), ``turn`` (a turn of the caller to be given, its length, and whether it follows another of the caller's) and
    ``end`` (there are no more turns). Rows: at, reason, waited (microseconds), speaking, turn (its number, or -1).

    Reasons: ``b2b`` a short gap after the caller's own turn; ``model_end`` the model has stopped; ``hold`` it has
    stopped on a phrase that asks to wait, the turn stays; ``hold_timeout`` nothing came after that; ``timeout_silent``
    the model has said nothing; ``barge_in`` it doesn't stop; ``tail_quiet`` and ``tail_cap`` end the call.
    """

    FIELDS = "at long, reason string, waited long, speaking boolean, turn int"

    def __init__(self, patience: Patience = Patience()) -> None:
        super().__init__()
        p = self.p = patience
        self.us = {k: micros(getattr(p, k)) for k in ("after_sentence", "within_sentence", "back_to_back", "opening", "silence", "longest_speech", "hold", "tail_quiet", "tail")}
        self.s = {"queue": [], "k": 0, "wait": None, "playing": None, "heard": False, "onset": None, "active": None, "open": False, "begun": 0, "sentence": False, "text": "", "stopped": None, "said": "", "held": False, "ended": None, "over": False}

    def speech_end(self) -> int | None:
        """When the model's speech will have ended, if nothing comes."""
        s = self.s
        return s["active"] + self.us["after_sentence" if s["sentence"] else "within_sentence"] if s["open"] else None

    def on(self, at: int, row: tuple) -> Iterable[tuple]:
        s, (kind, text, seconds, back_to_back) = self.s, row
        if s["over"]:
            return
        if s["wait"] is None:
            s["wait"] = at
        if kind == "speech":
            if text:
                s["sentence"], s["text"] = text.rstrip().endswith(CLOSING), s["text"] + text
            s["begun"] = s["begun"] if s["open"] else at
            s["active"], s["open"] = at, True
            if not s["heard"] and s["playing"] is None:
                s["heard"], s["onset"] = True, at
        elif kind == "turn":
            s["queue"].append([at, micros(seconds or 0), bool(back_to_back)])
        elif kind == "end":
            s["ended"] = at
        yield from self.holding(at)

    def holding(self, at: int) -> Iterator[tuple]:
        """Says once for each stop that the model has asked to wait."""
        s, release = self.s, self.next_release()
        if release and release[1] == "hold_timeout" and release[0] > at and not s["open"] and not s["held"]:
            s["held"] = True
            yield at, "hold", at - s["wait"], False, s["k"]

    def next_release(self) -> tuple[int, str] | None:
        """(time, reason) of what would happen next if no more events came."""
        s, us = self.s, self.us
        if s["playing"] is not None or s["wait"] is None or s["over"]:
            return None
        if not s["queue"]:
            if s["ended"] is None:
                return None
            quiet, cap = max(s["wait"], s["active"] or s["wait"]) + us["tail_quiet"], s["wait"] + us["tail"]
            return max(min(quiet, cap), s["ended"]), "tail_cap" if cap <= max(quiet, s["ended"]) else "tail_quiet"
        came, _, back_to_back = s["queue"][0]
        quiet_from = self.speech_end()
        barge = (max(s["onset"] + us["longest_speech"], s["begun"], came), "barge_in") if s["heard"] and quiet_from is not None else None
        if barge and barge[0] < quiet_from:
            return barge
        free = max(came, s["wait"], quiet_from or 0)
        if back_to_back:
            return max(free, s["wait"] + us["back_to_back"]), "b2b"
        if s["heard"]:
            stopped, said = (s["active"], s["text"]) if s["open"] else (s["stopped"], s["said"])
            if stopped is not None and re.search(self.p.holding, said):
                return max(free, stopped + us["hold"]), "hold_timeout"
            return free, "model_end"
        return max(came, s["wait"] + us["silence" if s["k"] else "opening"]), "timeout_silent"

    def due(self) -> int | None:
        release = self.next_release()
        times = [x for x in (self.speech_end(), self.s["playing"], release and release[0]) if x is not None]
        return min(times) if times and not self.s["over"] else None

    def wake(self, at: int) -> Iterable[tuple]:
        s = self.s
        end = self.speech_end()
        if end is not None and end <= at:
            s["open"], s["stopped"], s["said"], s["text"] = False, s["active"], s["text"], ""
            s["held"] = False
        if s["playing"] is not None and s["playing"] <= at:  # the caller's turn is over, the next wait begins
            s["playing"], s["wait"], s["stopped"], s["said"] = None, s["playing"], None, ""
            s["heard"], s["onset"] = s["open"], s["wait"] if s["open"] else None
            if not s["open"]:
                s["text"] = ""
        release = self.next_release()
        if release is None:
            return
        when, reason = release
        if when <= at:
            yield at, reason, at - s["wait"], s["open"], s["k"] if s["queue"] else -1
            if s["queue"]:
                s["playing"], s["k"] = at + s["queue"].pop(0)[1], s["k"] + 1
            else:
                s["over"] = True
        else:
            yield from self.holding(at)


@dataclass(frozen=True)
class Limits:
    """Seconds after which a session that nobody takes, that nobody asks for, or that never ends is closed, and after which a closed one is forgotten."""

    claim: float = 90.0
    abandon: float = 60.0
    call: float = 900.0
    forget: float = 600.0


class Session(Machine):
    """The states of a session with the time in each.

    Events: (state,), or ``poll``, which says that somebody still waits. Rows: before, state, at, seconds (in the state
    before), allowed. A session that isn't closed in time is closed with the state ``expired``, ``abandoned`` or
    ``stuck``; events after the close count for nothing until the session is forgotten, with its state.
    """

    FIELDS = "before string, state string, at long, seconds double, allowed boolean"
    STEPS = {("waking", "busy"), ("busy", "waking"), ("waking", "ready"), ("busy", "ready"), ("ready", "in_call"), ("in_call", "ended")}
    FINAL = ("ended", "error", "cancelled", "expired", "abandoned", "stuck")

    def __init__(self, limits: Limits = Limits()) -> None:
        super().__init__()
        self.limits = limits

    def moved(self, at: int, state: str) -> tuple:
        before, since = self.s.get("state"), self.s.get("since", at)
        self.s = {"state": state, "since": at, "seen": at}
        allowed = before is None and state == "waking" or (before, state) in self.STEPS or state in self.FINAL
        return before, state, at, (at - since) / SECOND, allowed

    def on(self, at: int, row: tuple) -> Iterable[tuple]:
        state, now = row[0], self.s.get("state")
        if state is None or now in self.FINAL:
            return
        if state != "poll" and state != now:
            yield self.moved(at, state)
        elif self.s:
            self.s["seen"] = at

    def due(self) -> int | None:
        state, limits = self.s.get("state"), self.limits
        if state is None:
            return None
        if state in self.FINAL:
            return self.s["since"] + micros(limits.forget)
        if state in ("waking", "busy"):
            return self.s["seen"] + micros(limits.abandon)
        return self.s["since"] + micros(limits.claim if state == "ready" else limits.call)

    def wake(self, at: int) -> Iterable[tuple]:
        state = self.s["state"]
        if state in self.FINAL:
            self.s = {}
        else:
            yield self.moved(at, "abandoned" if state in ("waking", "busy") else "expired" if state == "ready" else "stuck")

    def idle(self) -> bool:
        return not self.s


class Claims(Machine):
    """One slot that is claimed for a time.

    Events: (kind, who, terms) with kind ``claim``, ``start`` (the claim is used: it doesn't expire any more) and
    ``release``. Rows: at, who, outcome. A second claim by the holder on the same terms renews (``renewed``), on other
    terms it is refused (``mismatch``); others are told ``busy``; an unused claim lapses (``expired``), and the slot is
    free again, with no state left.
    """

    FIELDS = "at long, who string, outcome string"

    def __init__(self, seconds: float) -> None:
        super().__init__()
        self.seconds = micros(seconds)

    def on(self, at: int, row: tuple) -> Iterable[tuple]:
        kind, who, terms = row
        holds = bool(self.s) and self.s["who"] == who
        if kind == "claim":
            if not self.s:
                self.s = {"who": who, "terms": terms, "until": at + self.seconds}
                yield at, who, "claimed"
            elif not holds or self.s["until"] is None:
                yield at, who, "busy"
            elif self.s["terms"] != terms:
                yield at, who, "mismatch"
            else:
                self.s["until"] = at + self.seconds
                yield at, who, "renewed"
        elif kind == "start" and holds and self.s["until"] is not None:
            self.s["until"] = None
            yield at, who, "started"
        elif kind == "release" and holds:
            self.s = {}
            yield at, who, "released"

    def due(self) -> int | None:
        return self.s["until"] if self.s else None

    def wake(self, at: int) -> Iterable[tuple]:
        who = self.s["who"]
        self.s = {}
        yield at, who, "expired"

    def idle(self) -> bool:
        return not self.s


@dataclass(frozen=True)
class Levels:
    """Levels in decibels of the gate and the gain, and frames of the noise window, of its warm-up and of the hang-over."""

    window: int = 20
    warm_up: int = 5
    percent: float = 25.0
    margin: float = 20.0
    least: float = 10.0
    most: float = 80.0
    hang: int = 2
    speech: float = 30.0
    target: float = 60.0
    most_gain: float = 24.0
    noise_gain: float = 6.0
    step: float = 2.0
    attack: float = 0.3
    release: float = 0.05


class Gate(Machine):
    """A gate over the noise of the last frames, and a gain towards a level of speech.

    Events: (level,). Rows: the event's id (given as a second value), noise (a percentile of the window, kept sorted
    beside it, so that a frame costs a search), opening, open, gain. The gain follows a level that rises fast and falls
    slowly, by a bounded step a frame, and only while the gate is open. A frame without a level has its place in the
    window and among the frames after a loud one; NaN is above all levels.
    """

    FIELDS = "id long, noise double, opening double, open boolean, gain double"

    def __init__(self, levels: Levels = Levels()) -> None:
        super().__init__()
        self.levels = levels
        self.s = {"last": [], "sorted": [], "opening": levels.least, "hang": 0, "level": None, "gain": 0.0}

    def percentile(self) -> float | None:
        values, last = self.s["sorted"], self.s["last"]
        n = len(values) if len(values) == len(last) else sum(v is not None for v in last)  # NaN isn't sorted in
        if not n:
            return None
        place = (n - 1) * self.levels.percent / 100
        low = int(place)
        part = place - low
        a, b = (values[i] if i < len(values) else math.nan for i in (low, min(low + 1, n - 1)))
        if not part:
            return a
        try:
            return fma(a, 1 - part, b * part)  # as DuckDB's compiler fuses it
        except (ValueError, OverflowError):
            return a * (1 - part) + b * part

    def on(self, at: int, row: tuple) -> Iterator[tuple]:
        s, c, (db, event) = self.s, self.levels, row
        s["last"].append(db)
        if db is not None and db == db:
            insort(s["sorted"], db)
        if len(s["last"]) > c.window:
            old = s["last"].pop(0)
            if old is not None and old == old:
                s["sorted"].pop(bisect_left(s["sorted"], old))
        noise = None
        if len(s["last"]) >= c.warm_up:
            noise = self.percentile()
            s["opening"] = c.least if noise is None else c.most if noise != noise else min(max(c.least, noise + c.margin), c.most)
        loud = db is not None and (db > s["opening"] or db != db)
        opened = loud or s["hang"] > 0
        s["hang"] = c.hang if loud else max(0, s["hang"] - 1)
        if opened and db is not None:
            self.adjust(db)
        yield event, noise, s["opening"], opened, s["gain"]

    def adjust(self, db: float) -> None:
        s, c = self.s, self.levels
        if db > c.speech:
            level = s["level"]
            s["level"] = db if level is None else level + (c.attack if db > level else c.release) * (db - level)
        wanted = 0.0 if s["level"] is None else min(max(c.target - s["level"], 0.0), c.most_gain)
        if db <= c.speech:
            wanted = min(wanted, c.noise_gain)
        s["gain"] += min(max(wanted - s["gain"], -c.step), c.step)
