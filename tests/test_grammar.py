"""The grammar of spoken numbers: hand cases, and every number there and back."""

import random

import pytest
from pyspark.sql import functions as F

from vakya.functions import grammar as G
from vakya.functions import spoken

# Cases whose results are given.
CHANGED = [
    ("mera number nau aath double zero seven three five six two one hai", "mera number 9800735621 hai"),
    ("mera number nine eight seven three zero seven five eight nine three hai", "mera number 9873075893 hai"),
    ("number hai 98730 75893", "number hai 9873075893"),
    ("mera number 9873075893 hai", "mera number 9873075893 hai"),
    ("मेरा number ९८७३० ७५८९३ है", "मेरा number 9873075893 है"),
    ("मेरा नंबर नौ आठ सात तीन शून्य सात पांच आठ नौ तीन है", "मेरा नंबर 9873075893 है"),
    ("नाइन एट सेवन थ्री जीरो सेवन फाइव एट नाइन थ्री", "9873075893"),
    ("triple five two two one one nine eight", "555221198"),
    ("double nine eight seven six five four three two", "998765432"),
    ("ek do teen chaar paanch chhe saat aath nau das", "12345678910"),
    ("shunya ek do teen", "0123"),
    ("FD four one two four", "FD4124"),
    ("order FD four one two four hai", "order FD4124 hai"),
    ("PNR FV seven six nine five", "PNR FV7695"),
    ("transaction ID TX six one eight zero", "transaction ID TX6180"),
    ("AC8 nine eight zero", "AC8980"),
    ("gate D four", "gate D4"),
    ("Rs paanch sau tees", "Rs 530"),
    ("paanch sau tees rupaye", "530 rupaye"),
    ("saat sau rupaye", "700 rupaye"),
    ("सात सौ रुपये", "700 रुपये"),
    ("seven hundred ninety seven rupees", "797 rupees"),
    ("ek lakh bees hazaar", "120000"),
    ("teen lakh", "300000"),
    ("gyarah hazaar paanch sau", "11500"),
    ("dedh sau rupaye", "150 rupaye"),
    ("ninyanve rupaye", "99 rupaye"),
    ("das rupaye", "10 rupaye"),
    ("do rupaye", "2 rupaye"),
    ("two point five GB", "2.5 GB"),
    ("twenty five minutes", "25 minutes"),
    ("pachchis minute lagenge", "25 minute lagenge"),
    ("teen baje aana", "3 baje aana"),
    ("nau baje tak", "9 baje tak"),
    ("nau baj gaye abhi tak nahi aaya", "9 baj gaye abhi tak nahi aaya"),
    ("eight thirty pm", "8:30 pm"),
    ("sector baais", "sector 22"),
    ("sector das", "sector 10"),
    ("flat number teen sau chaar", "flat number 304"),
    ("terminal two", "terminal 2"),
    ("twelve", "12"),
    ("desk dot pandey three at hotmail dot com", "desk dot pandey 3 at hotmail dot com"),
    ("sharma eighty three eight zohomail dot in", "sharma 83 at zohomail dot in"),
    ("naya number nine at seven three zero seven five eight nine three hai", "naya number 9873075893 hai"),
    ("woh hai at zero seven six zero nine zero seven nine four", "woh hai 8076090794"),
    ("mera number hai at at two six zero three two four two one", "mera number hai 8826032421"),
    ("mera number eight at two six zero three two four two one hai", "mera number 8826032421 hai"),
    ("order ID EC at five zero five hai", "order ID EC8505 hai"),
    ("ride RD at zero zero five cancel", "ride RD8005 cancel"),
    ("card seven at four five", "card 7845"),
    ("last four digits nine at zero one", "last four digits 9801"),
    ("main at seven baje aaunga", "main at 7 baje aaunga"),
    ("at five thirty pm", "at 5:30 pm"),
    ("ek hazaar do sau", "1200"),
    ("Rs ek hazaar do sau", "Rs 1200"),
    ("teen hazaar do sau rupaye", "3200 rupaye"),
    ("mujhe do sau rupaye wapas chahiye", "mujhe 200 rupaye wapas chahiye"),
]
UNCHANGED = [
    "ek minute, main check karti hoon", "ek second please", "let me check, one minute", "एक मिनट मैं check करती हूँ", "mujhe paisa wapas do", "ek minute do",
    "do teen din mein ho jayega", "mere saath aisa kyun hua", "ek saath dono order", "char log hain", "one of my orders", "I want to cancel this one", "aath din ho gaye",
    "haan ji do minute dijiye", "मुझे पैसे वापस दो", "आप मेरे साथ ऐसा मत कीजिए", "", "at eight", "at least two days", "sharma 83 at gmail dot com", "updated to at 26032421",
    "sau baar bola", "aath das din ho gaye", "आठ दस दिन", "paanch das minute", "two three days", "five ten minutes", "two three din lagenge", "teen chaar din", "do din mein aa jayega", "saat mein ho jayega",
]
NUMBERS = [("9 8 7 3 0 8 4 7 6 9", ["9873084769"]), ("98730 75893", ["9873075893"]), ("Rs 1,85,000 aur FD4124", ["185000", "4124"])]


@pytest.mark.parametrize(("said", "digits"), CHANGED)
def test_changed(said, digits):
    assert G.convert(said) == digits
    assert G.convert(digits) == digits


@pytest.mark.parametrize("said", UNCHANGED)
def test_unchanged(said):
    assert G.convert(said) == said


@pytest.mark.parametrize(("text", "found"), NUMBERS)
def test_numbers(text, found):
    assert G.numbers_in(text) == found


@pytest.mark.parametrize(("said", "digits"), [
    ("seat fourteen B please", "seat 14B please"), ("saadhe teen hazaar rupaye", "3500 rupaye"), ("sawa lakh", "125000"), ("dhai hazaar", "2500"), ("five hundred thousand", "500000"), ("one hundred and five", "105"), ("twenty-five rupees", "25 rupees"),
    ("(nine eight seven)", "(987)"), ("F D four one", "FD41"), ("nine oh four five", "9045"), ("5 lakh rupaye", "500000 rupaye"), ("two crore three lakh four thousand five", "20304005"), ("double", "double"), ("and two point", "and two point"), ("बीस बीस", "2020"), ("six seven. eight nine", "67. 89"), ("  two  hundred", "  two  hundred"),
])
def test_more(said, digits):
    assert G.convert(said) == digits


def test_every_number_there_and_back(spark):
    """Cardinals on the Indian scale, digit by digit, and Hindi numbers in both scripts."""
    numbers = [*range(1, 3000), *(random.Random(1).randrange(10**9) for _ in range(3000))]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    said = df.select("n", G.spoken_to_written(F.concat(F.lit("Rs "), spoken.cardinal(F.col("n")), F.lit(" rupees"))).alias("amount"), G.spoken_to_written(F.concat(F.lit("id "), spoken.digit_words(F.concat(F.lit("70"), F.col("n").cast("string"))))).alias("digits"))
    assert [(r.n, r.amount, r.digits) for r in said.collect()] == [(n, f"Rs {n} rupees", f"id 70{n}") for n in numbers]
    assert [G.convert(f"{a} rupaye") for a in G.HINDI] == [G.convert(f"{a} रुपये").replace("रुपये", "rupaye") for a in G.DEVANAGARI]
    assert [G.convert(f"{a} sau {b} rupaye") for a in G.HINDI[1:10] for b in G.HINDI[10:20]] == [f"{100 * a + b} rupaye" for a in range(1, 10) for b in range(10, 20)]
    assert len(set(map(G.sound, G.HINDI))) >= 97  # 39, 47 and 48 sound alike in this spelling


def test_odd_texts(spark):
    rows = [(None,), ("",), ("nine " * 20_000,), ("a\nb\tc",), ("at " * 5000,)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").select(G.spoken_to_written("t").alias("x")).collect()]
    assert got[0] is None and got[1] == "" and got[2].strip() == "9" * 20_000 and got[3] == "a\nb\tc" and got[4] == "at " * 5000


def test_query_on_whole_texts(spark):
    from vakya.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {f"d{r.doc_id}": r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()} | {f"c:{r.conv_id}:{r.turn}": r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    rows = QUERIES["num_grammar_texts"](spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.numbers for r in rows) > 50
    assert all(r.numbers == len(G.numbers_in(G.convert(texts[r.id]))) and r.changed == (G.convert(texts[r.id]) != texts[r.id]) for r in rows)


def test_only_words_around_numbers_become_tokens(monkeypatch):
    """A long text with few numbers makes few tokens, and gives what all its tokens give."""
    words, rng = [f"{a}{b}ord" for a in "xyzw" for b in "aeiou"], random.Random(2)
    said = ["twenty five minutes", "order EC at at five zero five", "seat fourteen B", "eight zohomail", "At", "A B", "ek do", "nine oh four five point", "do teen din"]
    texts = [" ".join(rng.choice(said) if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    want = [" ".join(G.converted([G.Token(x) for x in t.split(" ")])) for t in texts]
    made = []
    first = G.Token.__init__
    monkeypatch.setattr(G.Token, "__init__", lambda self, raw: (made.append(raw), first(self, raw))[1])
    assert [G.convert(t) for t in texts] == want
    made.clear()
    assert G.convert(" ".join(words * 1000) + " for twenty five minutes " + " ".join(words)).count("for 25 minutes") == 1
    assert len(made) < 20
