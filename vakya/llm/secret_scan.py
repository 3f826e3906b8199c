"""Secrets in texts: rules, and a character network for what the rules don't know.

Three rules (assignments to telling names, access keys, long hexadecimal runs) give the base findings. Candidates are
all runs of eight or more characters of keys that aren't plain words (they hold a digit, a sign or a capital after a
small letter); every candidate that no rule covers is scored by the network with its context.

The network is trained on labelled findings: candidates of a sample of documents, positive where a rule finds them,
besides the same findings with values of other kinds (keys of other alphabets, signed tokens) and with the contexts of
other candidates, and innocent values (names in camel or snake case, dates, paths, versions, numbers). Part of the
findings is held out to calibrate the probabilities and to choose, for each shape of value, the highest threshold that
keeps the wanted recall. The sample is bounded by ``Training``; counts and scans cover all documents.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .secret_net import LEFT, RIGHT, Candidate, Net, calibrate, fit, shape

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are whole: a shorter one fails anyway
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"[A-Za-z0-9+/_=.~-]{8,}")
SIGNAL = re.compile(r"[0-9_=+/~]|[a-z][A-Z]")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the rules' findings, in code points."""
    found: list[Span] = []
    small = text.lower()  # only to see whether a name can occur at all
    if any(name in small for name in NAMES):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def candidate_spans(text: str) -> list[tuple[int, int]]:
    """Runs that could be keys."""
    found = []
    for m in RUN.finditer(text):
        value = m.group().rstrip(".")
        if len(value) >= 8 and SIGNAL.search(value):
            found.append((m.start(), m.start() + len(value)))
    return found


def in_context(text: str, start: int, end: int) -> Candidate:
    return text[max(0, start - LEFT) : start], text[start:end], text[end : end + RIGHT]


def covered_candidates(text: str, base: list[Span]) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether a finding of the rules overlaps) of the candidates; one pass over both lists."""
    rules = sorted((s, e) for _, s, e in base)
    k = reach = 0
    for start, end in candidate_spans(text):
        while k < len(rules) and rules[k][0] < end:
            reach, k = max(reach, rules[k][1]), k + 1
        yield start, end, reach > start


def labelled(text: str) -> list[tuple[Candidate, int]]:
    """Candidates of a text; 1 where a finding of the rules overlaps."""
    return [(in_context(text, s, e), int(covered)) for s, e, covered in covered_candidates(text, base_spans(text))]


@dataclass(frozen=True)
class Training:
    """Bounds of the sample: documents that are looked at, and findings of each label that are used; the share that is held out; and the recall that thresholds keep."""

    documents: int = 20_000
    findings: int = 1_500
    held_out: float = 0.3
    recall: float = 0.98
    seed: int = 7


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def other_secret(rng: random.Random) -> str:
    """A value as keys have it: random over some alphabet, with or without a prefix."""
    draw = lambda alphabet, least, most: "".join(rng.choices(alphabet, k=rng.randint(least, most)))
    every = LOWER + UPPER + DIGITS
    kind = rng.randrange(6)
    if kind == 0:
        return draw(DIGITS + "abcdef", 24, 64) if rng.random() < 0.5 else draw(DIGITS + "ABCDEF", 24, 64)
    if kind == 1:
        return draw(every + "+/", 24, 88) + rng.choice(["", "=", "=="])
    if kind == 2:
        return draw(LOWER, 2, 4) + rng.choice("_-") + draw(LOWER, 3, 5) + rng.choice("_-") + draw(every, 20, 40)
    if kind == 3:
        return ".".join(draw(every + "_-", 20, 50) for _ in range(3))
    if kind == 4:
        return draw(UPPER + DIGITS, 20, 40)
    return draw(every, 20, 48)


def innocent(rng: random.Random) -> str:
    """A value that looks like a candidate and is no secret."""
    word = lambda: "".join(rng.choices("aeiou" + LOWER, k=rng.randint(2, 9)))
    number = lambda n: "".join(rng.choices(DIGITS, k=n))
    kind = rng.randrange(8)
    if kind == 0:
        return word() + "".join(word().capitalize() for _ in range(rng.randint(1, 4)))
    if kind == 1:
        return "_".join(word() for _ in range(rng.randint(2, 5)))
    if kind == 2:
        return "/".join(word() for _ in range(rng.randint(2, 6))) + rng.choice(["", ".txt", ".html", ".py"])
    if kind == 3:
        return f"{number(4)}-{number(2)}-{number(2)}" + rng.choice(["", "T" + number(6)])
    if kind == 4:
        return number(rng.randint(8, 16))
    if kind == 5:
        return word() + number(rng.randint(1, 4)) + "." + word() + rng.choice([".com", ".org", ".net"])
    if kind == 6:
        return f"{word()}-{number(1)}.{number(2)}.{number(1)}"
    return word() + "-" + word() + "-" + number(rng.randint(1, 4)) + rng.choice(["", "=" + word()])


def enriched(findings: list[tuple[Candidate, int]], seed: int) -> list[tuple[Candidate, int]]:
    """The findings, with other values in their contexts and with each other's contexts, so that neither one alphabet nor one name is what counts."""
    rng = random.Random(seed)
    found = list(findings)
    contexts = [(b, a) for (b, _, a), _ in findings] or [(" ", " ")]
    plain = [(b, a) for (b, _, a), y in findings if not y] or [(" ", " ")]
    for (b, v, a), y in findings:
        if y:
            found.append(((b, other_secret(rng), a), 1))
            b, a = rng.choice(plain)
            found.append(((b, v, a), 1))
    for _ in range(max(2000, len(findings) // 2)):
        b, a = rng.choice(contexts)
        found.append(((b, other_secret(rng), a), 1))
        b, a = rng.choice(contexts)
        found.append(((b, innocent(rng), a), 0))
    return found


def priority(col: Column) -> Column:
    return F.xxhash64(col, F.lit(11))


def sample_findings(docs: DataFrame, id_col: str, text_col: str, training: Training) -> list[tuple[Candidate, int]]:
    """At most ``findings`` candidates of each label from about ``documents`` documents, chosen by hash; a bounded list on the driver, as a classifier needs it."""
    small_batches(docs.sparkSession)
    n = docs.count()
    part = docs.where(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    if n > training.documents:
        part = part.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * training.documents / n) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(b, v[:512], a, y) for text in batch.column(0).to_pylist() for (b, v, a), y in labelled(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], ["before", "value", "after", "label"])

    found = part.select("text").mapInArrow(run, "before string, value string, after string, label long").dropDuplicates()
    rows = []
    for label in (0, 1):
        rows += found.where(F.col("label") == label).orderBy(priority(F.concat("before", "value", "after")), "before", "value", "after").limit(training.findings).collect()
    return [((r.before, r.value, r.after), r.label) for r in rows]


def train(findings: list[tuple[Candidate, int]], training: Training = Training()) -> Net:
    """A calibrated network. Findings are held out by a hash of their value, so that no value is on both sides."""
    every = enriched(findings, training.seed)
    held = [xxhash.xxh32_intdigest(v.encode("utf-8", "replace")) % 1000 < 1000 * training.held_out for (_, v, _), _ in every]
    sides = [([c for (c, _), h in zip(every, held, strict=True) if h == side], np.array([y for (_, y), h in zip(every, held, strict=True) if h == side], np.float32)) for side in (False, True)]
    net = Net.new(training.seed)
    fit(net, *sides[0], seed=training.seed)
    calibrate(net, *sides[1], training.recall)
    return net


def scan_texts(texts: list[str], net: Net) -> list[list[tuple[str, int, int, float]]]:
    """(kind, start, end, probability) of each text in order; those of the rules have probability 1."""
    found: list[list] = []
    where, candidates = [], []
    for i, text in enumerate(texts):
        base = base_spans(text)
        found.append([(*s, 1.0) for s in base])
        for start, end, covered in covered_candidates(text, base):
            if not covered:
                where.append((i, start, end))
                candidates.append(in_context(text, start, end))
    for k in range(0, len(candidates), 4096):
        part = candidates[k : k + 4096]
        for (i, s, e), c, p in zip(where[k : k + 4096], part, net.probabilities(part), strict=True):
            if p >= net.thresholds[shape(c[1])]:
                found[i].append(("model", s, e, float(p)))
    return [sorted(x, key=lambda r: (r[1], KINDS.index(r[0]))) for x in found]


SPANS = "array<struct<kind: string, start: bigint, end: bigint, probability: double>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: Training = Training(), net: Net | None = None) -> DataFrame:
    """One row for each input row: the id and ``spans``, in the order of their starts, in code points.

    Null and empty texts have no spans; repeated rows each get a row; texts of any length are read whole; an empty table
    gives an empty result (and a network trained on made-up findings alone). Other columns are ignored. Where no
    network is given, one is trained on a bounded sample of the documents themselves.
    """
    small_batches(docs.sparkSession)
    model = net or train(sample_findings(docs, id_col, text_col, training), training)
    kind = dict(docs.dtypes)[id_col]
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = scan_texts([x or "" for x in batch.column(1).to_pylist()], model)
            rows = pa.array([[{"kind": k, "start": s, "end": e, "probability": p} for k, s, e, p in x] for x in spans], pa.list_(struct))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], [id_col, "spans"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{id_col}` {kind}, spans {SPANS}")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with the spans replaced; what overlaps is replaced once."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def step(state: Column, span: Column) -> Column:
        piece = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(span["start"] - state["at"], F.lit(0)).cast("int"))
        after = F.struct(F.concat(state["done"], piece, F.lit(mark)).alias("done"), span["end"].alias("at"))
        joined = F.struct(state["done"].alias("done"), F.greatest(state["at"], span["end"]).alias("at"))
        return F.when(span["start"] >= state["at"], after).otherwise(joined)

    return F.aggregate(spans, start, step, lambda s: F.concat(s["done"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the rules' findings, the digest of their spans, and all spans as text."""
    base = F.filter("spans", lambda x: x["kind"] != "model")
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, n("assign"), n("access"), n("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), n("model"))
