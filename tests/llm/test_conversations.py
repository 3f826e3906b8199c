"""op11 against a plain Python repair that tries every way, row by row."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vakya.llm import conversation_repair as R
from vakya.llm import queries

DDL = "conv_id long, turn long, role string, text string"


def cheapest(codes):
    """Least (cost, letters) over all edits, by extending every state's best prefix."""
    best = {0: (0, "")}

    def inserted(best):
        for _ in range(4):
            for q, (cost, letters) in list(best.items()):
                for role in "ua":
                    to = R.NEXT.get((q, role))
                    if to is not None:
                        best[to] = min(best.get(to, (1 << 60, "")), (cost + 5, letters + "I"))
        return best

    for i in range(0, len(codes), 2):
        initial, fault, after = codes[i], codes[i + 1], {}
        for q, (cost, letters) in inserted(best).items():
            ways = [(2, "D", q)]
            if fault in "kt":
                extra = 5 if fault == "t" else 0
                ways += [(extra + (role != initial), "K" if role == initial else "R", R.NEXT[q, role]) for role in "sua" if (q, role) in R.NEXT and (role != "s" or initial == "s")]
            for c, x, to in ways:
                after[to] = min(after.get(to, (1 << 60, "")), (cost + c, letters + x))
        best = after
    best = inserted(best)
    return min(best[q] for q in (0, 3) if q in best)


def plain(rows):
    """The whole contract for a table of (conv_id, turn, role, text) with distinct texts of equal turns."""
    ids, kept = {r[0] for r in rows}, {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        elif kind == 4:
            role = "user"
        if kind:
            kept.setdefault(conv, []).extend([(turn, role, text)] * (2 if kind == 3 else 1))
    found = {}
    for conv in ids:
        turns = sorted(kept.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        seen, codes, n = set(), "", {"b": 0, "d": 0, "t": 0, "k": 0}
        for _, role, text in turns:
            ends = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "b" if not ends else "d" if (role, text) in seen else "k" if ends[-1] in ".!?" else "t"
            seen.add((role, text))
            n[fault] += 1
            codes += (role[:1] if role[:1] in ("s", "u", "a") else "o") + fault
        cost, letters = cheapest(codes)
        numbers = [r[0] for r in turns if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[1][:1] for r in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out, state, rest = [], 0, iter(turns)
        for x in letters:
            row = next(rest) if x != "I" else None
            if x == "D":
                continue
            role = row[1] if x == "K" else {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
            out.append(f"{role}:{row[2] if row else ''}")
            state = R.NEXT[state, role[:1]]
        found[conv] = (gaps, n["b"], n["d"], n["t"], illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return found


def by_spark(df):
    return {r.conv_id: tuple(r)[1:] for r in R.repair_digests(df).collect()}


def test_auction_is_exact():
    rng = random.Random(1)
    for k in range(400):
        codes = "".join(rng.choice("ssuuuaaao") + rng.choice("kkkktbd") for _ in range(rng.randrange(0, 40)))
        cost, letters = cheapest(codes)
        got, end = R.traces(codes, R.ENDS)[0]
        assert got + R.TAILS[end] == letters
        assert R.price_of(letters, codes) == cost == R.chained(R.distances(codes), list(R.ENDS))[0]


def test_blocks_are_chained():
    rng = random.Random(2)
    codes = "".join(rng.choice("suuaao") + rng.choice("kkktbd") for _ in range(200))
    parts = [codes[i : i + 26] for i in range(0, 400, 26)]
    back = list(R.back_chain(("x", k, p, R.distances(p)) for k, p in reversed(list(enumerate(parts)))))[::-1]
    traced = [(c, k, p, last, *map(list, zip(*R.traces(p, tuple(exits)), strict=True))) for c, k, p, exits, last in back]
    forth = list(R.forth_chain(iter(traced)))
    assert ("".join(r[2] for r in forth), sum(r[4] for r in forth)) == cheapest(codes)[::-1]


def test_table_equals_plain_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.01").collect()}
    want = plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert got == want and len(got) > 50


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(1, k, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "No", "  ", None, "Why? ", f"line {k}\nnext!"])) for k in range(500)]
    rows += [(None, None, "user", "A."), (None, 3, None, None), (2, None, None, None), (3, 9, "assistant", "x" * 200_000 + "."), (4, 5, "user", "é!\x0b")]
    rows += [(5, t, "user", "Same.") for t in (7, 7, 7, 8)]
    rows += [(c, 0, "user", "Only.") for c in range(100, 140)]  # some lose their only row
    got = by_spark(spark.createDataFrame(rows, DDL).repartition(3).withColumn("digest", F.lit(1)).withColumn("letters", F.lit("K")).withColumn("kind", F.lit(0)))
    assert got == plain(rows)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert empty in got.values()


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    rows = [(1, 1, "user", "Hello.")][:n]
    assert by_spark(spark.createDataFrame(rows, DDL)) == plain(rows)


def test_a_long_conversation_is_solved_in_blocks(spark):
    rows = spark.range(5000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    repairs = R.find_repairs(rows)
    assert repairs.count() >= 5000 / 64 and max(len(r.letters) for r in repairs.select("letters").collect()) <= 2 * 64 + 2
    turns = R.repaired_turns(rows, repairs).collect()
    assert [r.role for r in turns] == ["user", "assistant"] * (len(turns) // 2)
