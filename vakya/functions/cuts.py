"""Cuts of a text into up to three pieces at its best boundaries, the same cuts in a parallel text, and noise that spares protected words."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ENDS = (",", ".", "!", "?", ";", ":", "।")
AROUND = "".join(ENDS) + "\"'()"


@dataclass(frozen=True)
class Limits:
    """A text goes in one piece up to ``words`` and ``letters``, in two up to twice as much, else in three. A cut costs its penalty: none after a mark, ``conjunction`` before such a word, ``particle`` after such a word; elsewhere none is made, nor between two words with digits."""

    words: int = 18
    letters: int = 110
    conjunction: int = 8
    particle: int = 14
    conjunctions: tuple[str, ...] = ("and", "or", "but", "und", "oder", "et", "ou", "y", "o", "que")
    particles: tuple[str, ...] = ("of", "in", "by", "to", "von", "zu", "de", "du", "del", "par")


def core(word: str) -> str:
    return word.strip(AROUND).lower()


def penalties(words: list[str], limits: Limits) -> dict[int, int]:
    """Place of a cut (before word j) -> its penalty."""
    found = {}
    for j in range(2, len(words) - 1):
        before, after = words[j - 1], words[j]
        if before.endswith(ENDS):
            cost = 0
        elif core(after) in limits.conjunctions:
            cost = limits.conjunction
        elif core(before) in limits.particles:
            cost = limits.particle
        else:
            continue
        if not (any(c.isdigit() for c in before) and any(c.isdigit() for c in after)):
            found[j] = cost
    return found


def best_cuts(words: list[str], limits: Limits) -> tuple[list[int], bool]:
    """(places of the cuts, whether one had to be forced): the longest piece plus the penalties are least; of equal ones the first cuts.

    Three pieces need no search over all pairs: for a second cut and a penalty of the first, the longer of the first two
    pieces is least where the first cut is nearest to their middle, and where the last piece is longest anyway, the
    earliest first cut that keeps it so is as good.
    """
    n = len(words)
    ends = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).astype(np.int64)
    length = lambda a, b: ends[b] - ends[a] - 1
    if n <= limits.words and length(0, n) <= limits.letters:
        return [], False
    pieces = min(2 if n <= 2 * limits.words and length(0, n) <= 2 * limits.letters else 3, max(1, n // 2))
    if pieces < 2:
        return [], False
    cost = penalties(words, limits)
    places = np.array(sorted(cost), np.int64)
    if pieces == 3 and len(places) > 1:
        found = best_pair(places, np.array([cost[j] for j in places.tolist()]), ends, n)
        if found:
            return found, False
    if len(places):
        return [min(((int(max(length(0, j), length(j, n))) + cost[j], j) for j in cost))[1]], False
    safe = [j for j in range(2, n - 1) if not (any(c.isdigit() for c in words[j - 1]) and any(c.isdigit() for c in words[j]))] or [n // 2]
    return [min(safe, key=lambda j: (abs(2 * j - n), j))], True


def best_pair(places: np.ndarray, penalty: np.ndarray, ends: np.ndarray, n: int) -> list[int] | None:
    """The best two cuts at least two words apart, for all second cuts at once."""
    best = None
    total = ends[n]
    for kind in np.unique(penalty):
        first = places[penalty == kind]
        at = ends[first]
        allowed = np.searchsorted(first, places - 2, "right")  # first cuts that leave two words
        middle = np.searchsorted(at, ends[places] / 2)
        as_long = np.searchsorted(at, 2 * ends[places] - total)
        for guess in (middle - 1, middle, as_long, allowed - 1):
            i = np.minimum(guess, allowed - 1)
            ok = np.flatnonzero((i >= 0) & (allowed > 0))
            if not len(ok):
                continue
            a, b = first[i[ok]], places[ok]
            cost = np.maximum(np.maximum(ends[a], ends[b] - ends[a]), total - ends[b]) - 1 + kind + penalty[ok]
            k = np.lexsort((b, a, cost))[0]
            best = min(best or (1 << 60, 0, 0), (int(cost[k]), int(a[k]), int(b[k])))
    return [best[1], best[2]] if best else None


def parallel_cuts(words: list[str], others: list[str], cuts: list[int]) -> tuple[list[int], str]:
    """The cuts in a parallel text, and how they were found: at the same words, at the same marks, or in proportion."""
    if not cuts or len(words) == len(others):
        return cuts, "same"
    marks = lambda x: [j for j in range(1, len(x)) if x[j - 1].endswith(ENDS)]
    ours, theirs = marks(words), marks(others)
    if len(ours) == len(theirs) and set(cuts) <= set(ours):
        return [theirs[ours.index(j)] for j in cuts], "marks"
    return [max(1, min(len(others) - 1, round(j * len(others) / len(words)))) for j in cuts], "share"


def cut_texts(limits: Limits = Limits()):  # noqa: ANN201
    """A vectorised function: text and parallel text -> cuts of both, whether they are forced, how they were mapped. Nulls count as empty."""

    @F.pandas_udf("cuts array<int>, forced boolean, parallel array<int>, way string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(x, y, strict=True):
            words, others = (a or "").split(), (b or "").split()
            cuts, forced = best_cuts(words, limits)
            rows.append((cuts, forced, *parallel_cuts(words, others, cuts)))
        return pd.DataFrame(rows, columns=["cuts", "forced", "parallel", "way"])

    return run


ARTICLES = ("the", "a", "an", "der", "die", "das", "le", "la", "les", "el", "los")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression that uses a value several times, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def noisy(words: Column, protected: Column, seed: Column) -> Column:
    """Words with noise that depends on the seed alone: a third of the articles go, one pair is written as one word, one word has two neighbouring letters changed round.

    ``protected`` marks the words that must stay as they are, one flag a word; none of the three edits touches them. The
    pair and the word are those with the least digest among all that may be taken; the word isn't of the pair.
    """
    at = F.sequence(F.lit(1), F.size(words))
    draw = lambda kind, i: F.md5(F.concat_ws(":", seed, F.lit(kind), i.cast("string")))
    number = lambda digest: F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")
    word, safe = lambda i: F.try_element_at(words, i), lambda i: F.try_element_at(protected, i)
    article = lambda i: F.lower(word(i)).isin(*ARTICLES)

    def least(kind: str, ok: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.array_min(F.transform(F.filter(at, ok), lambda i: F.struct(draw(kind, i).alias("d"), i.alias("i"))))["i"], F.lit(0))

    pair = least("pair", lambda i: (i < F.size(words)) & ~safe(i) & ~safe(i + 1) & ~article(i) & ~article(i + 1) & word(i).rlike("^[A-Za-z]+$"))
    swap = lambda pair: least("swap", lambda i: ~safe(i) & word(i).rlike("^[A-Za-z]{5,}$") & (i != pair) & (i != pair + 1))

    def edited(i: Column, pair: Column, swap: Column, p: Column) -> Column:
        w = word(i)
        dropped = article(i) & ~safe(i) & (number(draw("drop", i)) % 3 == 0)
        merged = pair > 0
        swapped = F.concat(F.substring(w, F.lit(1), p - 1), F.substring(w, p + 1, F.lit(1)), F.substring(w, p, F.lit(1)), F.substring(w, p + 2, F.length(w)))
        return F.when(dropped | merged & (i == pair + 1), F.lit(None)).when(merged & (i == pair), F.concat(w, word(i + 1))).when(i == swap, swapped).otherwise(w)

    def all_edited(pair: Column, swap: Column) -> Column:
        place = number(draw("letter", swap)) % F.greatest(F.length(F.coalesce(word(F.nullif(swap, F.lit(0))), F.lit(""))) - 3, F.lit(1)) + 2
        return once(place, lambda p: F.array_compact(F.transform(at, lambda i: edited(i, pair, swap, p))))

    return F.when(F.size(words) > 0, once(pair, lambda a: once(swap(a), lambda b: all_edited(a, b)))).otherwise(words)
