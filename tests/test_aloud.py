"""Written tokens as they are said: hand cases of each kind, marks and neighbours."""

from pyspark.sql import functions as F

from vakya.functions import aloud as A

CASES = [
    ("Rs 540 do", [("Rs 540", "faiv handred forti rupaye")]),
    ("Rs. 1,250.50 hai", [("Rs 1,250.50", "van thauzend tu handred fifti rupaye fifti paise")]),
    ("₹99 rupees", [("₹99", "nainti nain")]),
    ("20.5 rupaye", [("20.5", "twenti rupaye fifti paise")]),
    ("rs20.5", [("rs20.5", "twenti rupaye fifti paise")]),
    ("at 6:40 pm, 7 p.m. now", [("6:40", "siks forti"), ("pm", "pi em"), ("7", "seven"), ("p.m", "pi em")]),
    ("6:05, 6:00am", [("6:05", "siks o faiv"), ("6:00am", "siks e em")]),
    ("18/10/2026 ya 5-13-99", [("18/10/2026", "etin october twenti twenti siks"), ("5-13-99", "faiv van thri nain nain")]),
    ("bhatia.home57@gmail.com", [("bhatia.home57@gmail.com", "bhatia dot home fifti seven aet gmail dot com")]),
    ("(4th) 21st 12th", [("4th", "forth"), ("21st", "twenti farst"), ("12th", "twelfth")]),
    ("45% 3.5% 10-12", [("45%", "forti faiv parsent"), ("3.5%", "thri point faiv parsent"), ("10-12", "ten tu twelv")]),
    ("+9198 x2 1234", [("+9198", "plas nain van nain et"), ("x2", "tu"), ("1234", "van tu thri for")]),
    ("EC-0412 DL4C", [("EC-0412", "i si zero for van tu"), ("DL4C", "di el for si")]),
    ("UPI, OK ok Upi", [("UPI", "yu pi aai")]),
    ("May 1999, sept 2005 in 1999", [("May", "may"), ("1999", "naintin nainti nain"), ("sept", "september"), ("2005", "tu thauzend faiv"), ("1999", "van nain nain nain")]),
    ("3.14 12,345 007 512", [("3.14", "thri point van for"), ("12,345", "twelv thauzend thri handred forti faiv"), ("007", "zero zero seven"), ("512", "faiv handred twelv")]),
    ("५०० रुपये", [("500", "faiv handred")]),
    ("1,23,45,67,89,012 " + "9" * 25, [("1,23,45,67,89,012", "van tu thri for faiv siks seven et nain zero van tu"), ("9" * 25, " ".join(["nain"] * 25))]),
    ("-- () Rs. am", []),
    ("", []),
    (None, []),
]


def test_hand_cases(spark):
    df = spark.createDataFrame([(i, x, "clash") for i, (x, _) in enumerate(CASES)], "k int, t string, latin string")
    got = {}
    for r in A.groups(df, "k", "t").orderBy("k", "place").collect():
        got.setdefault(r.k, []).append((r.written, r.latin))
    assert {i: want for i, (_, want) in enumerate(CASES) if want} == got
    assert A.groups(df.limit(0), "k", "t").count() == 0


def test_devanagari_and_whole_lines(spark):
    df = spark.createDataFrame([(1, "«एच-12» call (UPI) ५, don't!")], "k int, t string")
    rows = A.groups(df, "k", "t", everything=True).orderBy("place").collect()
    assert [r.latin for r in rows if r.written != "«एच-12»"] == ["call", "yu pi aai", "faiv", "don't"]
    assert [(r.lead, r.trail) for r in rows][2:] == [("(", ")"), ("", ","), ("", "!")]
    assert " ".join(r.devanagari for r in rows[2:4]) == "यू पी आई फ़ाइव"


def test_every_word_has_both_forms(spark):
    """All numbers that are said as one, all ordinals and years use words of the table only."""
    from vakya.functions import spoken as N

    n = spark.range(100)
    for made, df in ((N.under_hundred(F.col("id")), n), (N.ordinal(F.col("id")), n), (N.year(F.col("id") + 1950), n), (N.cardinal(F.col("id") * 98765431), n)):
        words = {w for r in df.select(made.alias("w")).collect() for w in r.w.split(" ")}
        assert words <= A.SAID.keys()


def test_a_notice_is_one_row(spark):
    """The groups of a notice are joined within its row: nothing is shuffled. Letters without a form are left out."""
    from vakya.plans.registry import QUERIES

    df = QUERIES["num_said_orders"](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([(1, "UPI\u0085 5. ")], "k int, t string")
    assert [(r.written, r.latin) for r in A.groups(odd, "k", "t").orderBy("place").collect()] == [("UPI\u0085", "yu pi aai"), ("5 ", "faiv")]
