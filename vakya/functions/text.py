"""Column expressions on text: tokens, normal forms, overlaps, script shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[ \\t\\n\\r]+"
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def words(x: Column) -> Column:
    """Words between white space that have a letter or digit."""
    return F.filter(F.split(F.trim(x), SPACE), lambda w: w.rlike("[0-9A-Za-z_]|[^\\x00-\\x7F]"))


def alnum_tokens(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), "[^a-z0-9@]+"), lambda t: t != "")


def score_words(x: Column) -> Column:
    """Lower-case words with at most one apostrophe part."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+(?:'[a-z]+)?"), F.lit(0))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def spoken_units(tokens: Column) -> Column:
    """Units that it takes to say tokens: 1 for a word, 1 or 2 for short numbers, one for each digit of long ones."""
    n = lambda t: F.length(F.regexp_replace(t, "[^0-9]", ""))
    return F.aggregate(F.transform(tokens, lambda t: F.when(n(t) == 0, 1).when(n(t) <= 2, n(t)).otherwise(n(t)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)


def overlap_share(value: Column, inside: Column, stop: tuple[str, ...] = ("the", "a", "of", "and", "to")) -> Column:
    """Share of the content tokens of ``value`` (repeats count) that ``inside`` has; 1 if there are none."""
    content = F.filter(value, lambda t: (F.length(t) >= 2) & ~t.isin(*stop))
    hits = F.size(F.filter(content, lambda t: F.array_contains(inside, t)))
    return F.when(F.size(content) == 0, F.lit(1.0)).otherwise(F.try_divide(hits, F.size(content)))


def multiset_common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda xs, t: F.size(F.filter(xs, lambda y: y == t))
    return F.aggregate(F.transform(F.array_intersect(a, b), lambda t: F.least(count(a, t), count(b, t))), F.lit(0), lambda s, x: s + x)


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays as multisets; 1 if both are empty."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.try_divide(multiset_common(a, b) * 2.0, n))


def ascii_fold(x: Column) -> Column:
    """Accented letters to plain ones, other non-ASCII characters dropped."""
    return F.regexp_replace(F.translate(x, "áàâäéèêëíïîóöôúüûñçÁÀÂÄÉÈÊËÍÏÎÓÖÔÚÜÛÑÇ", "aaaaeeeeiiiooouuuncAAAAEEEEIIIOOOUUUNC"), "[^\\x00-\\x7F]", "")


def email_normal(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), " at ", "@"), " dot ", "."), " ", "")


def phone_canonical(x: Column) -> Column:
    """Ten digits without country or trunk prefix, else all digits."""
    d = digits(x)
    return F.when((F.length(d) == 12) & d.startswith("91"), F.substring(d, 3, 10)).when((F.length(d) == 11) & d.startswith("0"), F.substring(d, 2, 10)).otherwise(d)


def consonant_skeleton(x: Column) -> Column:
    """Lower-case letters without vowels after the first, repeats as one."""
    low = F.regexp_replace(F.lower(x), "[^a-z]", "")
    return F.regexp_replace(F.concat(F.substring(low, 1, 1), F.regexp_replace(F.regexp_replace(low, "^.", ""), "[aeiouyhw]", "")), "(.)\\1+", "$1")


def sound_fold(x: Column) -> Column:
    """A phonetic key of our own: an h after a consonant goes, like sounds share a letter, vowels go, repeats are one."""
    plain = F.regexp_replace(F.lower(x), "([b-df-gj-np-tv-z])h+", "$1")
    return F.regexp_replace(F.translate(plain, "qzwyaeiou", "kjv"), "(.)\\1+", "$1")


def script_share(x: Column, letters: str = "[ऀ-ॿ]", all_letters: str = "[A-Za-zऀ-ॿÀ-ÿ]") -> Column:
    """Share of the letters that are of one script; 0 without letters."""
    n = F.regexp_count(x, F.lit(all_letters))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(F.regexp_count(x, F.lit(letters)), n))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by spaces."""
    count = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    found = F.slice(tokens, 1, count)
    for k in range(2, n + 1):  # array by array, so that the tokens are not made again for each position
        found = F.zip_with(found, F.slice(tokens, k, count), lambda a, b: F.concat_ws(" ", a, b))
    return found


def spells(tokens: Column, fact: Column) -> Column:
    """Whether contiguous whole tokens make up ``fact`` when joined without spaces.

    One pass: the state is the ends in ``fact`` that runs of tokens up to here have reached; -1 says that one is done.
    """
    n = F.length(fact)
    fits = lambda at, t: F.substring(fact, at + 1, F.length(t)) == t

    def step(ends: Column, t: Column) -> Column:
        longer = F.transform(F.filter(F.concat(ends, F.array(F.lit(0))), lambda e: fits(e, t)), lambda e: e + F.length(t))
        return F.when(F.array_contains(ends, -1) | F.array_contains(longer, n), F.array(F.lit(-1))).otherwise(F.filter(longer, lambda e: e < n))

    return (n > 0) & F.array_contains(F.aggregate(tokens, F.array().cast("array<int>"), step), -1)


def cer(hyp: Column, ref: Column) -> Column:
    """Edit distance over the length of the reference; for an empty one 0 if both are empty, else 1."""
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(F.try_divide(F.levenshtein(hyp, ref), F.length(ref)))


def runs(values: str) -> Column:
    """(most, different) of a sorted array: the length of its longest run of equal values, and the number of runs; 0 if it is empty."""
    places = F.filter(F.transform(F.col(values), lambda x, i: F.when((i == 0) | (x != F.get(F.col(values), i - 1)), i)), lambda i: i.isNotNull())
    step = lambda s, i: F.struct(F.greatest(s["most"], i - s["at"]).alias("most"), i.alias("at"), (s["n"] + 1).alias("n"))
    start = F.struct(F.lit(0).alias("most"), F.lit(0).alias("at"), F.lit(0).alias("n"))
    done = lambda s: F.struct(F.greatest(s["most"], F.size(values) - s["at"]).cast("bigint").alias("most"), s["n"].cast("bigint").alias("different"))
    return F.aggregate(places, start, step, done)


def spelled_joined(x: Column) -> Column:
    """Plain words with runs of single letters or digits as one word: ``e c 0 4 please`` is ``ec04 please``."""
    words = F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    return F.regexp_replace(words, "(?<=(?<![a-z0-9])[a-z0-9]) (?=[a-z0-9](?![a-z0-9]))", "")
