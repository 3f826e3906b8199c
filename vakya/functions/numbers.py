"""Spoken numbers in English and romanised Hindi to digits, and numbers out of text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number words.
ONES = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
HINDI = {w: i for i, w in enumerate("shunya ek do teen char paanch chhah saat aath nau das gyarah barah terah chaudah pandrah solah satrah atharah unnis bees".split())} | {"tees": 30, "chalis": 40, "pachas": 50, "saath": 60, "sattar": 70, "assi": 80, "nabbe": 90}
SCALES = {"hundred": 100, "sau": 100, "thousand": 1000, "hazaar": 1000, "lakh": 100_000, "crore": 10_000_000, "million": 1_000_000}
REPEATS = {"double": 2, "triple": 3}
FRACTIONS = {"dedh": 1.5, "dhai": 2.5, "adhai": 2.5}
SMALL = ONES | TENS | HINDI
TOKEN = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)?|[^a-z0-9\s]")


def value_of(words: list[str]) -> float | None:
    """The number that a run of number words names, by scales; null if the words don't make up one number."""
    total, part, seen = 0.0, 0.0, False
    last = None
    for w in words:
        if w == "and":
            continue
        if w in FRACTIONS:
            if seen:
                return None
            part, seen, last = FRACTIONS[w], True, "fraction"
        elif w in SCALES:
            scale = SCALES[w]
            if scale == 100:
                part = (part or 1) * 100
            else:
                total, part = total + (part or 1) * scale, 0.0
            seen, last = True, "scale"
        elif w in SMALL:
            n = SMALL[w]
            if last == "small" and not (part % 100 >= 20 and part % 10 == 0 and 0 < n < 10):
                return None
            part, seen, last = part + n, True, "small"
        else:
            return None
    return total + part if seen else None


def digit_run(words: list[str]) -> str | None:
    """Digits said one by one, with double and triple."""
    out, times = [], 1
    for w in words:
        if w in REPEATS:
            times = REPEATS[w]
        elif w.isdigit() or (w in SMALL and SMALL[w] < 10):
            out.append((w if w.isdigit() else str(SMALL[w])) * times)
            times = 1
        else:
            return None
    return "".join(out) if out and times == 1 else None


def is_number_word(w: str) -> bool:
    return w in SMALL or w in SCALES or w in FRACTIONS or w in REPEATS


def to_digits(text: str) -> str:
    """Text with its spoken numbers as digits; words that don't make up a number stay."""
    tokens = text.split(" ")
    out: list[str] = []
    i = 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and (is_number_word(tokens[j].lower()) or (tokens[j].lower() == "and" and j > i and j + 1 < len(tokens) and is_number_word(tokens[j + 1].lower()))):
            j += 1
        run = [t.lower() for t in tokens[i:j]]
        if not run:
            out.append(tokens[i])
            i += 1
            continue
        found = None
        if len(run) >= 3 or any(w in REPEATS for w in run):
            found = digit_run(run)
        if found is None:
            n = value_of(run)
            found = None if n is None else str(int(n)) if n == int(n) else str(n)
        out += [found] if found is not None else tokens[i:j]
        i = j
    return " ".join(out)


NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,3}(?:,[0-9]{2,3})+(?![0-9])|(?<![0-9A-Za-z])[0-9]+(?: [0-9]+){3,}(?![0-9A-Za-z])|[0-9]+")


def numbers_in(text: str) -> list[str]:
    """Numbers of a text as digits; grouped and spaced ones as one."""
    return [re.sub("[, ]", "", m) for m in NUMBER.findall(text)]


@F.pandas_udf(T.StringType())
def spoken_to_digits(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else to_digits(t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def extract_numbers(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else numbers_in(t))
