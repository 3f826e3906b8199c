"""Whether the numbers that a speaker says have been given before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

NUMBER = "[0-9]+(?:[ :.,/-][0-9]+)*"
#: Digits inside words count as given too.
MIXED = "[A-Za-z]+[0-9]+[A-Za-z0-9]*|[0-9]+[A-Za-z]+"
#: Numbers that anyone may say.
FREE = ("1", "2")
#: Parts of a given number of this many digits are known.
WITHIN = (4, 24)


def _parts(number: Column) -> Column:
    return F.array_distinct(F.split(number, "[ :.,/-]"))


def _substrings(x: Column) -> Column:
    n = F.length(x)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(x, i, k)))))


def number_sources(lines: DataFrame) -> DataFrame:
    """(doc, line, number, known): every number in the lines that don't give any, once for each time it is said.

    ``lines`` has doc, line (a whole number, records below all lines), gives and text. A number is known if it is 1 or 2;
    if a giving line before has it, or all its parts between spaces and marks; or if it lies within a given number of 4
    to 24 digits (longer ones are known as a whole only, so that what is sent stays in proportion). Null or empty texts
    have no numbers; a null ``gives`` doesn't give. Keys are (doc, number), so a long document is spread over tasks.
    """
    rows = lines.select("doc", "line", F.coalesce("gives", F.lit(False)).alias("gives"), F.coalesce("text", F.lit("")).alias("text"))
    found = F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))
    given = rows.where("gives").select("doc", "line", F.explode(F.array_distinct(F.concat(F.flatten(F.transform(found, lambda m: F.array_append(_parts(m), X.digits(m)))), F.transform(F.regexp_extract_all("text", F.lit(MIXED), F.lit(0)), X.digits)))).alias("key"))
    given = given.groupBy("doc", "key").agg(F.min("line").alias("line"))
    inside = given.where(F.length("key").between(*WITHIN)).select("doc", "line", F.explode(_substrings(F.col("key"))).alias("key"))
    known = given.select("doc", "key", F.col("line").alias("own"), F.col("line").alias("any")).unionByName(inside.select("doc", "key", F.lit(None).cast("int").alias("own"), F.col("line").alias("any")))
    known = known.groupBy("doc", "key").agg(F.min("own").alias("own"), F.min("any").alias("any"))

    said = rows.where("not gives").select("doc", "line", F.posexplode(found).alias("at", "number"))
    asked = F.array_append(F.transform(_parts(F.col("number")), lambda p: F.struct(p.alias("key"), F.lit(False).alias("whole"))), F.struct(X.digits(F.col("number")).alias("key"), F.lit(True).alias("whole")))
    keyed = said.select("doc", "line", "at", "number", F.explode(asked).alias("a")).select("doc", "line", "at", "number", "a.*")
    seen = keyed.join(known, ["doc", "key"], "left")
    earlier = lambda c: F.coalesce(F.col(c) < F.col("line"), F.lit(False))
    whole = F.max(F.col("whole") & (earlier("any") | F.col("key").isin(*FREE)))
    parts = F.min(F.col("whole") | earlier("own"))
    return seen.groupBy("doc", "line", "at").agg(F.min("number").alias("number"), (whole | parts).alias("known")).drop("at")
