"""Values by their kind, as column expressions: whether a line says one again, whether two are the same, what is missing in one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

#: Share of the words of a free text that a line must have to say it again.
ENOUGH = 0.6
PHONE = r"\+?[0-9]*[ -]*\([0-9]{3}\)[ -]*[0-9]{3}[ -]*[0-9]{4}"
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
ID = r"[0-9]{12,}|[0-9a-f]{24,}"
#: Ways to say that the address on file is meant.
ON_FILE = r"^(the |my )?(registered|same|current|existing|old|usual)( (house|home|place))?( address)?$"


def first(pattern: str, x: Column) -> Column:
    """The first match in a text, null if there is none."""
    return F.nullif(F.regexp_extract(x, pattern, 0), F.lit(""))


def compact(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[ \\t\\n\\r]+", "")


def ten_digits(x: Column) -> Column:
    """The last ten digits of a phone that has a country or trunk prefix, else all its digits."""
    d = X.digits(x)
    return F.when(F.length(d).between(11, 13), F.right(d, F.lit(10))).otherwise(d)


def mail_parts(value: Column) -> Column:
    """What must be said of an address: words of two letters on of its name, and the first word of its domain."""
    name, domain = F.split_part(value, F.lit("@"), F.lit(1)), F.split_part(value, F.lit("@"), F.lit(2))
    return F.concat(F.filter(X.alnum_tokens(name), lambda w: F.length(w) >= 2), F.slice(X.alnum_tokens(domain), 1, 1))


def echoed(kind: Column, value: Column, line: Column) -> Column:
    """Whether a line says a value again; false where either is null.

    Phones by their run of digits, identifiers without spaces and case, mails by the parts of the name and the domain
    (in one word or several), other texts by six tenths of their words and each word with a digit.
    """
    tokens, own = X.alnum_tokens(line), X.alnum_tokens(value)

    def judged(x: Column) -> Column:
        numbered = F.filter(x["own"], lambda w: w.rlike("[0-9]"))
        return (
            F.when(kind == "phone", F.contains(X.digits(line), X.digits(value)))
            .when(kind == "id", F.contains(x["joined"], compact(value)))
            .when(kind == "mail", F.forall(mail_parts(value), lambda w: F.array_contains(x["said"], w) | F.contains(x["joined"], w)))
            .otherwise((F.size(F.array_except(numbered, x["said"])) == 0) & (X.overlap_share(x["own"], x["said"]) >= ENOUGH))
        )

    # An array of one row binds the words, which would else be made again for each word that is looked up.
    bound = F.array(F.struct(tokens.alias("said"), own.alias("own"), compact(line).alias("joined")))
    return F.coalesce(F.get(F.transform(bound, judged), F.lit(0)), F.lit(False))


def alike(gold: Column, said: Column) -> Column:
    """Whether the words of two texts have an F1 of 0.6 as multisets; those whose numbers of words differ too much aren't compared."""
    words = lambda x, name: (F.sort_array(x[name]).alias(name), F.sort_array(x[name], asc=False).alias(f"{name}_back"))
    # A word's times in a sorted array are between its first place from either end.
    times = lambda x, name, w: F.size(x[name]) + 2 - F.array_position(x[name], w) - F.array_position(x[f"{name}_back"], w)

    def judged(x: Column) -> Column:
        a, b = F.size(x["a"]), F.size(x["b"])
        both = F.aggregate(F.array_intersect(x["a"], x["b"]), F.lit(0).cast("long"), lambda n, w: n + F.least(times(x, "a", w), times(x, "b", w)))
        return F.when(a + b == 0, F.lit(True)).when(F.try_divide(F.least(a, b) * 2.0, a + b) < ENOUGH, F.lit(False)).otherwise(F.try_divide(both * 2.0, a + b) >= ENOUGH)

    # An array of one row binds the words, which would else be made again for each word that is counted.
    bound = F.array(F.struct(X.alnum_tokens(gold).alias("a"), X.alnum_tokens(said).alias("b")))
    return F.get(F.transform(F.transform(bound, lambda x: F.struct(*words(x, "a"), *words(x, "b"))), judged), F.lit(0))


def same(kind: Column, gold: Column, said: Column) -> Column:
    """Whether what was said is the gold value: references exactly, phones by ten digits, mails in normal form, texts by
    an F1 of 0.6 of their words, other kinds without case and marks. Nothing said is never the same; nothing is to be said neither."""
    plain = lambda x: F.array_join(X.alnum_tokens(x), " ")
    by_kind = (
        F.when(kind == "reference", gold == said)
        .when(kind == "phone", (ten_digits(gold) == ten_digits(said)) & (F.length(ten_digits(gold)) == 10))
        .when(kind == "mail", X.email_normal(gold) == X.email_normal(said))
        .when(kind.isin("text", "address"), (gold == said) | alike(gold, said))
        .otherwise(plain(gold) == plain(said))
    )
    return F.coalesce(by_kind & (F.trim(said) != ""), F.lit(False))


def canonical(kind: Column, value: Column) -> Column:
    """A value as the server takes it; null where nothing is left of it."""
    v = F.trim(value)
    return F.nullif(F.when(kind == "phone", ten_digits(v)).when(kind == "mail", X.email_normal(v)).otherwise(v), F.lit(""))


def fault(kind: Column, canonic: Column) -> Column:
    """Why a canonical value can't be used: missing, or of the wrong form; null if it can."""
    return (
        F.when(canonic.isNull(), "missing")
        .when((kind == "phone") & (F.length(canonic) != 10), F.concat(F.lit("digits "), F.length(canonic).cast("string")))
        .when((kind == "mail") & ~canonic.rlike("^[a-z0-9._%+-]+@[a-z0-9-]+(\\.[a-z0-9-]+)+$"), "malformed")
    )


def address(said: Column, registered: Column) -> Column:
    """(value, rule): an address that is said as it is, the registered one if none or that one is meant, else ask."""
    v = F.nullif(F.trim(said), F.lit(""))
    new = v.isNotNull() & ~F.lower(v).rlike(ON_FILE)
    known = F.nullif(F.trim(registered), F.lit(""))
    return F.struct(F.when(new, v).otherwise(known).alias("value"), F.when(new, "new").when(known.isNotNull(), "registered").otherwise("ask").alias("rule"))


def mentioned(reference: Column, text: Column) -> Column:
    """Whether a text names a reference: whole, without spaces and case, or by its digits (three on) as a run."""
    d = X.digits(reference)
    runs = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
    return F.coalesce((compact(reference) != "") & (F.contains(compact(text), compact(reference)) | ((F.length(d) >= 3) & F.array_contains(runs, d))), F.lit(False))
