"""Calls with what was said for their arguments, resolved against the specification of the tools and the owner's records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.tables import written
from .resolve import resolve


def resolve_calls(calls: DataFrame, spec: list[tuple[str, str, str]], entities: DataFrame, addresses: DataFrame) -> DataFrame:
    """(call, tool, values, rules, reasons, dropped): each call with the values that the server takes.

    ``calls`` has call (unique), owner, tool and args, a map of what was said; ``spec`` is (tool, argument, kind), and is
    a parameter, so it is broadcast; ``entities`` are those of ``operators.resolve``; ``addresses`` has owner and address.
    A ``reference`` is resolved among the owner's entities, even if nothing was said (then only a single entity can be
    meant); an ``address`` may be the registered one; other kinds are made canonical. ``values`` and ``rules`` are maps
    by argument; ``reasons`` (``argument:why``, sorted) says why one must ask, ``dropped`` (sorted) which arguments the
    tool doesn't know. A tool that isn't in the specification, or null, asks with ``unknown tool`` and drops nothing.
    Null args are no arguments; repeated rows of an owner's address count once, the least first.
    """
    spark = calls.sparkSession
    kinds = spark.createDataFrame(spec, "tool string, arg string, kind string")
    listed = kinds.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("arg", "kind"))).alias("spec"))
    wide = calls.select("call", "owner", "tool", F.coalesce("args", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("args")).join(F.broadcast(listed), "tool", "left")
    wide = written(wide)  # what was said is read by each kind, and by each rule for references
    rows = wide.select("call", "owner", F.explode("spec").alias("s"), "args").select("call", "owner", "s.arg", "s.kind", F.try_element_at("args", F.col("s.arg")).alias("said"))

    mentions = rows.where("kind = 'reference'").select(F.struct("call", "arg").alias("mention"), "owner", F.col("said").alias("text"))
    references = resolve(mentions, entities).select("mention.call", "mention.arg", F.col("entity").cast("string").alias("value"), "rule", F.when(F.col("rule") == "ask", "ask").alias("why"))
    registered = addresses.groupBy("owner").agg(F.min("address").alias("address"))
    places = rows.where("kind = 'address'").join(registered, "owner", "left").withColumn("a", V.address(F.col("said"), F.col("address"))).select("call", "arg", "a.value", "a.rule", F.when(F.col("a.rule") == "ask", "ask").alias("why"))
    value = V.canonical(F.col("kind"), F.col("said"))
    plain = rows.where("kind not in ('reference', 'address')").select("call", "arg", value.alias("value"), F.lit("said").alias("rule"), V.fault(F.col("kind"), value).alias("why"))

    every = references.unionByName(places).unionByName(plain)
    entry = F.array_sort(F.collect_list(F.struct("arg", "value", "rule", "why")))
    done = every.groupBy("call").agg(entry.alias("e"))
    why = F.transform(F.filter("e", lambda x: x["why"].isNotNull()), lambda x: F.concat_ws(":", x["arg"], x["why"]))
    as_map = lambda field: F.map_from_arrays(F.transform("e", lambda x: x["arg"]), F.transform("e", lambda x: x[field]))
    unknown = F.array_sort(F.array_except(F.map_keys("args"), F.transform("spec", lambda s: s["arg"])))
    nothing = F.array().cast("array<string>")
    return wide.join(done, "call", "left").select(
        "call", "tool", as_map("value").alias("values"), as_map("rule").alias("rules"),
        F.when(F.col("spec").isNull(), F.array(F.lit("unknown tool"))).otherwise(F.coalesce(why, nothing)).alias("reasons"),
        F.coalesce(unknown, nothing).alias("dropped"),
    )
