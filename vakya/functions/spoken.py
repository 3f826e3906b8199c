"""Column expressions between numbers and the words for them: Indian scale, years, digits one by one, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
HINDI = "ek do teen char paanch chhah saat aath nau".split()
DEVANAGARI = "एक दो तीन चार पाँच छह सात आठ नौ".split()
SCALES = {"hundred": 100, "thousand": 1000, "lakh": 100_000, "crore": 10_000_000}
IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
VALUES = {w: i for i, w in enumerate(SMALL)} | {w: 10 * i for i, w in enumerate(TENS, 2)}


def _pick(words: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), i.cast("int") + 1)


def under_hundred(n: Column) -> Column:
    """The words of 0 to 99."""
    tens, ones = F.floor(n / 10), n % 10
    return F.when(n < 20, _pick(SMALL, F.least(n, F.lit(19)))).otherwise(F.concat_ws(" ", _pick(TENS, F.greatest(tens - 2, F.lit(0))), F.when(ones > 0, _pick(SMALL, ones))))


def cardinal(n: Column) -> Column:
    """The words of a whole number from 0 to below a thousand crore, on the Indian scale."""
    part = lambda x, word: F.when(x > 0, F.concat(under_hundred(x), F.lit(f" {word}")))
    crore, lakh, thousand, hundred, rest = F.floor(n / 10_000_000), F.floor(n / 100_000) % 100, F.floor(n / 1000) % 100, F.floor(n / 100) % 10, n % 100
    high = F.when(crore >= 100, F.concat_ws(" ", part(F.floor(crore / 100), "hundred"), F.when(crore % 100 > 0, under_hundred(crore % 100)), F.lit("crore"))).otherwise(part(crore, "crore"))
    return F.when(n == 0, F.lit("zero")).otherwise(F.concat_ws(" ", high, part(lakh, "lakh"), part(thousand, "thousand"), part(hundred, "hundred"), F.when(rest > 0, under_hundred(rest))))


def ordinal(n: Column) -> Column:
    """The words of an ordinal: the last word of the cardinal takes its ordinal form."""
    words = cardinal(n)
    last = F.substring_index(words, " ", -1)
    form = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv]), last), F.when(last.endswith("y"), F.concat(F.regexp_replace(last, "y$", ""), F.lit("ieth"))).otherwise(F.concat(last, F.lit("th"))))
    return F.concat(F.regexp_replace(words, "[a-z]+$", ""), form)


def year(n: Column) -> Column:
    """A year as it is said: nineteen ninety nine, two thousand five, nineteen hundred."""
    century, rest = F.floor(n / 100), n % 100
    return F.when((n >= 2000) & (n < 2010), cardinal(n)).when(rest == 0, F.concat(under_hundred(century), F.lit(" hundred"))).otherwise(F.concat_ws(" ", under_hundred(century), F.when(rest < 10, F.lit("oh")), under_hundred(rest)))


def digit_words(digits: Column) -> Column:
    """Digits one by one."""
    return F.array_join(F.transform(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)), lambda d: _pick(SMALL, d.cast("int"))), " ")


def numbers_to_digits(tokens: Column) -> Column:
    """Tokens with each run of number words as digits: one pass with the sum so far, the part below the next scale, and the output.

    A small number continues one only where it fits below it (twenty, then five); else a new number starts. ``and`` is
    part of a number between two of its words.
    """
    value = lambda w: F.try_element_at(F.create_map(*[F.lit(x) for kv in VALUES.items() for x in kv]), w)
    scale = lambda w: F.try_element_at(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv]), w)
    state = lambda out, total, part, open_, fresh, held: F.struct(out.alias("out"), total.cast("bigint").alias("total"), part.cast("bigint").alias("part"), open_.alias("open"), fresh.alias("fresh"), held.alias("held"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)

    def closed(s: Column) -> Column:
        return F.concat(s["out"], F.when(s["open"], F.array((s["total"] + s["part"]).cast("string"))).otherwise(F.array().cast("array<string>")), F.when(s["held"], F.array(F.lit("and"))).otherwise(F.array().cast("array<string>")))

    def step(s: Column, w: Column) -> Column:
        v, k = value(w), scale(w)
        fits = ~s["fresh"] | ((s["part"] % 100 >= 20) & (s["part"] % 10 == 0) & (v > 0) & (v < 10))
        joined = state(s["out"], s["total"], s["part"] + v, yes, yes, no)
        return (
            F.when(v.isNotNull() & s["open"] & fits, joined)
            .when(v.isNotNull(), state(closed(s), zero, v, yes, yes, no))
            .when(k.isNotNull() & s["open"] & (k == 100), state(s["out"], s["total"], s["part"] * 100, yes, no, no))
            .when(k.isNotNull() & s["open"], state(s["out"], s["total"] + F.greatest(s["part"], F.lit(1)) * k, zero, yes, no, no))
            .when((w == "and") & s["open"] & ~s["held"], state(s["out"], s["total"], s["part"], yes, no, yes))
            .otherwise(state(F.concat(closed(s), F.array(w)), zero, zero, no, no, no))
        )

    start = state(F.array().cast("array<string>"), zero, zero, no, no, no)
    return F.aggregate(tokens, start, step, closed)


def compact_ids(tokens: Column) -> Column:
    """Tokens with each run of two or more single letters and spoken or written digits as one identifier in capitals."""
    mark = lambda w: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, word in enumerate(SMALL[:10]) for x in (word, str(i))]), w), F.when(w.rlike("^[a-z0-9]$"), F.upper(w)))
    state = lambda out, run, first, n: F.struct(out.alias("out"), run.alias("run"), first.alias("first"), n.cast("int").alias("n"))

    def closed(s: Column) -> Column:
        return F.when(s["n"] > 1, F.concat(s["out"], F.array(s["run"]))).when(s["n"] == 1, F.concat(s["out"], F.array(s["first"]))).otherwise(s["out"])

    def step(s: Column, w: Column) -> Column:
        return F.when(mark(w).isNotNull(), state(s["out"], F.concat(s["run"], mark(w)), F.when(s["n"] == 0, w).otherwise(s["first"]), s["n"] + 1)).otherwise(state(F.concat(closed(s), F.array(w)), F.lit(""), F.lit(""), F.lit(0)))

    return F.aggregate(tokens, state(F.array().cast("array<string>"), F.lit(""), F.lit(""), F.lit(0)), step, closed)


def joined_digits(tokens: Column, size: int) -> Column:
    """Tokens with each whole run of digit tokens joined where it makes up exactly ``size`` digits."""
    state = lambda out, run: F.struct(out.alias("out"), run.alias("run"))
    none = F.array().cast("array<string>")
    closed = lambda s: F.concat(s["out"], F.when(F.length(F.array_join(s["run"], "")) == size, F.array(F.array_join(s["run"], ""))).otherwise(s["run"]))
    step = lambda s, w: F.when(w.rlike("^[0-9]+$"), state(s["out"], F.concat(s["run"], F.array(w)))).otherwise(state(F.concat(closed(s), F.array(w)), none))
    return F.aggregate(tokens, state(none, none), step, closed)


def approximate_pairs(text: Column) -> Column:
    """Marks pairs of neighbouring small numbers (two three, ten twelve) as one word, as they name no number."""
    pairs = [(a, b) for a, b in zip(SMALL[1:], SMALL[2:], strict=False)] + [("ten", "twelve"), ("ten", "fifteen")]
    for a, b in pairs:
        text = F.regexp_replace(text, rf"\b(?<!y ){a} {b}\b(?! (?:hundred|thousand|lakh|crore|{'|'.join(SMALL)}))", f"{a}-{b}")
    return text
