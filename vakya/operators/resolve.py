"""Which of its owner's entities a mention means: rules in order of precedence, each a lookup by a key.

No rule pairs a mention with all entities of its owner: names, ids, ends of ids and ids with one digit masked are keys;
words count only where one entity of the owner has them, so a word leads to one entity; roles, places in the order and
single entities are one row an owner. The first rule that names exactly one entity decides; if none does, one must ask.

Both sides are shuffled once by owner, entities first, and the mentions of an owner stream past the keys of its
entities. Owners of more than ``LARGE`` rows are counted first and go by equality joins instead, which deal them out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.tables import written

RULES = ("exact", "id", "block", "misheard", "role", "contains", "words", "ordinal", "only")
ORDINALS = ("second", "third", "fourth", "fifth")
ROLES = {"latest": "desc", "newest": "desc", "oldest": "asc", "earliest": "asc"}
#: Digits of the shortest end of an id that may stand for it.
BLOCK = 3
#: Digits of the longest number that an id can be.
LONGEST = 38
#: Entities or mentions of an owner that one task takes.
LARGE = 20_000


def plain(text: Column) -> Column:
    """Words in small letters, digits that are said one by one as one run."""
    words = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.regexp_replace(words, "(?<=(?<![a-z0-9])[0-9]) (?=[0-9](?![a-z0-9]))", "")


class Owned:
    """The entities of one owner by the keys of the rules; a key has the least and the greatest entity that it may mean."""

    def __init__(self, longest_name: int) -> None:
        self.longest_name = longest_name
        self.rows: list[tuple[int, str | None]] = []
        self.latest = self.at = None
        self.names: dict[str, tuple[int, int]] | None = None
        self.ends: dict[int, dict[str, tuple[int, int]]] = {}

    def add(self, entity: int, name: str | None, at: object) -> None:
        """Takes an entity; they come by time, then number, those without a time last."""
        self.rows.append((entity, name))
        if self.latest is None or (at is not None and at != self.at):
            self.latest, self.at = entity, at

    @staticmethod
    def keyed(pairs: Iterable[tuple[str, int]]) -> dict[str, tuple[int, int]]:
        found: dict[str, tuple[int, int]] = {}
        for key, entity in pairs:
            if (old := found.get(key)) is None:
                found[key] = (entity, entity)
            elif not old[0] <= entity <= old[1]:
                found[key] = (min(old[0], entity), max(old[1], entity))
        return found

    def close(self) -> None:
        """Makes the keys of names, once all entities are there."""
        named = [(name, e) for e, name in self.rows if name is not None]
        self.names = self.keyed(named)
        self.own = {w: lo for w, (lo, hi) in self.keyed((w, e) for name, e in named for w in name.split(" ") if w).items() if lo == hi}
        self.ids = {e for e, _ in self.rows}

    def ended(self, run: str) -> list[tuple[int, int]]:
        """What has an id that ends in a run of digits; the ends of a length are made when one is said."""
        n = len(run)
        if n not in self.ends:
            self.ends[n] = self.keyed((x[-n:], e) for e in self.ids if n < len(x := str(e)) or n == BLOCK == len(x))
        return [self.ends[n][run]] if run in self.ends[n] else []

    def misheard(self, number: str) -> Iterator[int]:
        """Entities whose id is as long and differs in one sign at most."""
        said = int(number)
        for i, x in enumerate(number):
            unit = 10 ** (len(number) - 1 - i)
            least = said - int(x) * unit
            yield from (e for c in range(i == 0, 10) if (e := least + c * unit) in self.ids)
        if number[1] != "0" and -int(number[1:]) in self.ids:
            yield -int(number[1:])

    def named(self, text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """The rules in their order, with what each names."""
        if self.names is None:
            self.close()
        names, w = self.names, text.split(" ")
        words = set(w)
        yield "exact", [names[text]] if text in names else []
        if runs := [x for x in words if x.isdigit()]:
            numbers = {n for x in runs if len(n := x.lstrip("0") or "0") <= LONGEST}
            yield "id", [(e, e) for x in numbers if (e := int(x)) in self.ids]
            yield "block", [span for x in runs if len(x) >= BLOCK for span in self.ended(x)]
            yield "misheard", [(e, e) for x in numbers if len(x) > BLOCK for e in self.misheard(x)]
        yield "role", [(e, e) for r, way in ROLES.items() if r in words for e in (self.latest if way == "desc" else self.rows[0][0],)]
        held = {g for n in range(1, self.longest_name + 1) for i in range(max(len(w) - n + 1, 1)) if (g := " ".join(w[i : i + n])) and g in names}
        longest = max(map(len, held), default=0)
        yield "contains", [names[g] for g in held if len(g) == longest]
        hits: dict[int, int] = {}
        for x in words:
            if (e := self.own.get(x)) is not None:
                hits[e] = hits.get(e, 0) + 1
        most = max(hits.values(), default=0)
        yield "words", [(e, e) for e, n in hits.items() if n == most]
        yield "ordinal", [(self.rows[i][0],) * 2 for i, x in enumerate(ORDINALS, 1) if x in words and i < len(self.rows)]
        yield "only", [(e, e) for e in self.ids] if len(self.ids) == 1 else []

    def resolved(self, text: str) -> tuple[str, int | None]:
        """The first rule that names exactly one entity, and that entity."""
        for rule, spans in self.named(text) if self.rows else ():
            if spans and (entity := min(x for x, _ in spans)) == max(x for _, x in spans):
                return rule, entity
        return "ask", None


def crowded(df: DataFrame) -> list:
    """Owners of more than ``LARGE`` rows. They are counted by hash first, which leaves few to be counted one by one."""
    bucket = F.pmod(F.hash("owner"), F.lit(65536))
    over = lambda x, *key: [r[0] for r in x.groupBy(*key).count().where(F.col("count") > LARGE).collect()]
    full = over(df, bucket.alias("bucket"))
    return over(df.where(bucket.isin(full)), "owner") if full else []


def resolve(mentions: DataFrame, entities: DataFrame, longest_name: int = 4) -> DataFrame:
    """(mention, rule, entity): ``mentions`` has mention, owner, text; ``entities`` has owner, entity (a whole number), name, at.

    A mention that names no single entity has the rule ``ask`` and no entity. Null texts ask; names of more than
    ``longest_name`` words are found whole only where they are all of the text; entities of a null owner are never
    found. Repeated entities count once, those without a time come last. Both sides are stored first, as they are counted.
    """
    m = mentions.select("mention", "owner", plain(F.coalesce("text", F.lit(""))).alias("text"))
    e = entities.select("owner", "entity", plain("name").alias("name"), "at").distinct()
    m, e = written(m), written(e)
    large = {*crowded(m), *crowded(e)}
    if not large:
        return by_owner(m, e, longest_name)
    apart = F.coalesce(F.col("owner").isin([x for x in large if x is not None]), F.lit(None in large))
    return by_owner(m.where(~apart), e.where(~apart), longest_name).unionByName(by_joins(m.where(apart), e.where(apart), longest_name))


def by_owner(m: DataFrame, e: DataFrame, longest_name: int) -> DataFrame:
    """``resolve`` for owners whose entities a task can hold: their mentions stream past them."""
    empty = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    sides = e.where("owner is not null").select("owner", F.lit(False).alias("said"), empty(m, "mention"), "entity", F.col("name").alias("text"), "at").unionByName(m.select("owner", F.lit(True).alias("said"), "mention", empty(e, "entity"), "text", empty(e, "at")))
    ordered = sides.repartition("owner").sortWithinPartitions("owner", "said", F.col("at").asc_nulls_last(), "entity")
    schema = StructType([m.schema["mention"], StructField("rule", StringType()), e.schema["entity"]])
    kind = to_arrow_schema(schema).field("entity").type

    def plainly(column: pa.Array) -> list:
        """Times as their whole numbers, which are only compared."""
        return (column.view(pa.int64()) if pa.types.is_timestamp(column.type) else column).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, owned = None, Owned(longest_name)
        for batch in batches:
            owner, said, mention, *others = batch.columns
            places, rules, found = [], [], []
            for i, (o, is_said, entity, text, at) in enumerate(zip(owner.to_pylist(), said.to_pylist(), *map(plainly, others), strict=True)):
                if o != now:
                    now, owned = o, Owned(longest_name)
                if is_said:
                    rule, entity = owned.resolved(text)
                    places.append(i)
                    rules.append(rule)
                    found.append(entity)
                else:
                    owned.add(entity, text, at)
            if places:
                yield pa.RecordBatch.from_arrays([mention.take(pa.array(places)), pa.array(rules, pa.string()), pa.array(found, kind)], names=schema.names)

    return ordered.mapInArrow(run, schema)


def by_joins(m: DataFrame, e: DataFrame, longest_name: int) -> DataFrame:
    """``resolve`` for any owner, by equality joins. No side is broadcast, whatever its size is taken for: a stored table is small beside the keys that are made of its rows."""
    words = m.select("mention", "owner", F.split("text", " ").alias("w"))
    runs = words.select("mention", "owner", F.explode(F.array_distinct(F.filter("w", lambda x: x.rlike("^[0-9]+$")))).alias("run"))
    ids = e.select("owner", "entity", F.col("entity").cast("string").alias("id"))
    number = F.regexp_replace("run", "^0+(?=[0-9])", "")

    def masked(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.lit("_"), F.substring(x, i + 1, F.length(x))))

    keyed = lambda df, key: df.select("owner", "entity", key.alias("key")).hint("merge")
    long_runs = runs.where(F.length(number) > BLOCK).select("mention", "owner", number.alias("run"))
    found = {
        "exact": m.select("mention", "owner", F.col("text").alias("key")).join(keyed(e, F.col("name")), ["owner", "key"]),
        "id": runs.select("mention", "owner", number.alias("key")).join(keyed(ids, F.col("id")), ["owner", "key"]),
        "block": runs.where(F.length("run") >= BLOCK).select("mention", "owner", F.col("run").alias("key")).join(keyed(ids, F.explode(F.transform(F.sequence(F.lit(BLOCK), F.greatest(F.length("id") - 1, F.lit(BLOCK))), lambda n: F.right("id", n)))).where(F.length("key") >= BLOCK), ["owner", "key"]),
        "misheard": long_runs.select("mention", "owner", F.explode(masked(F.col("run"))).alias("key")).join(keyed(ids.where(F.length("id") > BLOCK), F.explode(masked(F.col("id")))), ["owner", "key"]),
    }
    ends = e.groupBy("owner").agg(F.min(F.struct(F.col("at").isNull().alias("late"), "at", "entity")).alias("asc"), F.max(F.struct("at", (-F.col("entity")).alias("entity"))).alias("desc"), F.count_distinct("entity").alias("n"), F.min("entity").alias("single"))
    sides = words.join(ends.hint("merge"), "owner")
    role = F.array_compact(F.array(*[F.when(F.array_contains("w", r), F.col("asc.entity") if way == "asc" else -F.col("desc.entity")) for r, way in ROLES.items()]))
    found["role"] = sides.select("mention", F.explode(role).alias("entity"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest_name)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))))
    inside = words.select("mention", "owner", F.explode(F.array_distinct(grams)).alias("key")).join(keyed(e.where("name <> ''"), F.col("name")), ["owner", "key"])
    longest = inside.groupBy("mention").agg(F.max(F.length("key")).alias("most"))
    found["contains"] = inside.join(longest.hint("merge"), "mention").where(F.length("key") == F.col("most"))
    tokens = e.select("owner", "entity", F.explode(F.array_distinct(F.split("name", " "))).alias("key")).where("key <> ''")
    own = tokens.groupBy("owner", "key").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("entity")).where("n = 1").drop("n")
    overlap = words.select("mention", "owner", F.explode(F.array_distinct("w")).alias("key")).join(own.hint("merge"), ["owner", "key"]).groupBy("mention", "entity").count()
    best = overlap.groupBy("mention").agg(F.max("count").alias("most"))
    found["words"] = overlap.join(best.hint("merge"), "mention").where(F.col("count") == F.col("most"))
    placed = e.select("owner", "entity", F.row_number().over(W.partitionBy("owner").orderBy(F.col("at").asc_nulls_last(), "entity")).alias("place")).where(F.col("place") <= len(ORDINALS) + 1)
    named = F.array_compact(F.array(*[F.when(F.array_contains("w", x), F.lit(i)) for i, x in enumerate(ORDINALS, 2)]))
    found["ordinal"] = words.select("mention", "owner", F.explode(named).alias("place")).join(placed.hint("merge"), ["owner", "place"])
    found["only"] = sides.where("n = 1").select("mention", F.col("single").alias("entity"))

    every = reduce(DataFrame.unionByName, [df.select("mention", F.lit(i).alias("place"), "entity") for i, df in enumerate(found[r] for r in RULES)])
    single = every.groupBy("mention", "place").agg(F.min("entity").alias("entity"), F.max("entity").alias("other")).where("entity = other")
    first = single.groupBy("mention").agg(F.min(F.struct("place", "entity")).alias("s"))
    rule = F.coalesce(F.get(F.array(*map(F.lit, RULES)), F.col("s.place")), F.lit("ask"))
    return m.select("mention").join(first.hint("merge"), "mention", "left").select("mention", rule.alias("rule"), F.col("s.entity").alias("entity"))
