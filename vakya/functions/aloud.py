"""Written tokens as they are said, in Latin letters and in Devanagari: amounts, times, dates, ordinals, shares, ranges,
numbers, phones, plates and identifiers, mail addresses, spelled capitals and months."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spoken as N

# How a word is written for a voice, in Devanagari and in Latin letters.
SAID = {
    "zero": ("ज़ीरो", "zero"), "one": ("वन", "van"), "two": ("टू", "tu"), "three": ("थ्री", "thri"), "four": ("फ़ोर", "for"), "five": ("फ़ाइव", "faiv"), "six": ("सिक्स", "siks"), "seven": ("सेवन", "seven"), "eight": ("एट", "et"), "nine": ("नाइन", "nain"),
    "ten": ("टेन", "ten"), "eleven": ("इलेवन", "ilevan"), "twelve": ("ट्वेल्व", "twelv"), "thirteen": ("थर्टीन", "thartin"), "fourteen": ("फ़ोर्टीन", "fortin"), "fifteen": ("फ़िफ़्टीन", "fiftin"), "sixteen": ("सिक्सटीन", "sikstin"), "seventeen": ("सेवनटीन", "seventin"), "eighteen": ("एटीन", "etin"), "nineteen": ("नाइनटीन", "naintin"),
    "twenty": ("ट्वेंटी", "twenti"), "thirty": ("थर्टी", "tharti"), "forty": ("फ़ोर्टी", "forti"), "fifty": ("फ़िफ़्टी", "fifti"), "sixty": ("सिक्सटी", "siksti"), "seventy": ("सेवनटी", "seventi"), "eighty": ("एटी", "eti"), "ninety": ("नाइनटी", "nainti"),
    "hundred": ("हंड्रेड", "handred"), "thousand": ("थाउज़ेंड", "thauzend"), "lakh": ("लाख", "laakh"), "crore": ("करोड़", "karod"), "point": ("पॉइंट", "point"), "percent": ("परसेंट", "parsent"), "rupaye": ("रुपये", "rupaye"), "paise": ("पैसे", "paise"), "oh": ("ओ", "o"), "to": ("टू", "tu"), "plus": ("प्लस", "plas"), "at": ("ऐट", "aet"), "dot": ("डॉट", "dot"),
    "zeroth": ("ज़ीरोथ", "zeroth"), "first": ("फ़र्स्ट", "farst"), "second": ("सेकंड", "sekand"), "third": ("थर्ड", "thard"), "fourth": ("फ़ोर्थ", "forth"), "fifth": ("फ़िफ़्थ", "fifth"), "sixth": ("सिक्स्थ", "siksth"), "seventh": ("सेवंथ", "seventh"), "eighth": ("एट्थ", "eith"), "ninth": ("नाइंथ", "nainth"), "tenth": ("टेंथ", "tenth"), "eleventh": ("इलेवंथ", "ilevanth"), "twelfth": ("ट्वेल्फ़्थ", "twelfth"),
    "thirteenth": ("थर्टींथ", "thartinth"), "fourteenth": ("फ़ोर्टींथ", "fortinth"), "fifteenth": ("फ़िफ़्टींथ", "fiftinth"), "sixteenth": ("सिक्सटींथ", "sikstinth"), "seventeenth": ("सेवनटींथ", "seventinth"), "eighteenth": ("एटींथ", "etinth"), "nineteenth": ("नाइनटींथ", "naintinth"),
    "twentieth": ("ट्वेंटिएथ", "twentieth"), "thirtieth": ("थर्टिएथ", "thartieth"), "fortieth": ("फ़ोर्टिएथ", "fortieth"), "fiftieth": ("फ़िफ़्टिएथ", "fiftieth"), "sixtieth": ("सिक्सटिएथ", "sikstieth"), "seventieth": ("सेवनटिएथ", "seventieth"), "eightieth": ("एटिएथ", "etieth"), "ninetieth": ("नाइनटिएथ", "naintieth"),
    "A": ("ए", "e"), "B": ("बी", "bi"), "C": ("सी", "si"), "D": ("डी", "di"), "E": ("ई", "i"), "F": ("एफ़", "ef"), "G": ("जी", "ji"), "H": ("एच", "ech"), "I": ("आई", "aai"), "J": ("जे", "je"), "K": ("के", "ke"), "L": ("एल", "el"), "M": ("एम", "em"),
    "N": ("एन", "en"), "O": ("ओ", "o"), "P": ("पी", "pi"), "Q": ("क्यू", "kyu"), "R": ("आर", "aar"), "S": ("एस", "es"), "T": ("टी", "ti"), "U": ("यू", "yu"), "V": ("वी", "vi"), "W": ("डब्ल्यू", "dablyu"), "X": ("एक्स", "eks"), "Y": ("वाई", "vaai"), "Z": ("ज़ेड", "zed"),
    "january": ("जनवरी", "january"), "february": ("फ़रवरी", "february"), "march": ("मार्च", "march"), "april": ("अप्रैल", "april"), "may": ("मई", "may"), "june": ("जून", "june"), "july": ("जुलाई", "july"), "august": ("अगस्त", "august"), "september": ("सितंबर", "september"), "october": ("अक्टूबर", "october"), "november": ("नवंबर", "november"), "december": ("दिसंबर", "december"),
}
MONTHS = list(SAID)[-12:]
CURRENCY = "(?i)₹|rs|inr|रु|रू"
RUPEES = "(?i)रुपये|रुपए|रुपया|रुपयों|रुपिये|रूपये|रूपए|रुपय|रूपया|rupaye|rupees|rupee|rupay|rupaiye|rupye|rupiya"
MARKS = r",.?!।॥;:\"'()\[\]{}…—–\-‘’“”/"
#: Capitals that are said as a word.
WHOLE = ("OK",)

#: The longest number that is said as one; longer ones are said digit by digit.
LONGEST = 10
#: Marks a word that is said as it is written.
RAW = "="
NUMBER = "[0-9][0-9,]*([.][0-9]+)?"


def _is(x: Column, pattern: str) -> Column:
    """Whether a pattern matches the whole text."""
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    return F.coalesce(x, F.lit("")).rlike(f"{flag}^(?:{pattern.removeprefix('(?i)')})$")


def _item(kind: str, x: Column) -> Column:
    """A part of what is said: ``n`` a number, ``d`` digits, ``o`` an ordinal, ``y`` a year, ``w`` a word, ``l`` letters, ``=`` as written."""
    return F.concat(F.lit(kind), x)


def _number(core: Column) -> Column:
    """Up to three digits and grouped ones as one number; others, and those with a zero in front, digit by digit."""
    plain = F.replace(core, F.lit(","), F.lit(""))
    spelled = (F.length(plain) >= 4) | ((F.length(plain) > 1) & plain.startswith("0"))
    return F.when(F.contains(core, F.lit(",")) | ~spelled, _item("n", plain)).otherwise(_item("d", plain))


def _amount(core: Column, bare: Column) -> Column:
    """Rupees and paise; the word for rupees is left out if ``bare`` and there are no paise."""
    plain = F.replace(core, F.lit(","), F.lit(""))
    rupees, rest = F.split_part(plain, F.lit("."), F.lit(1)), F.split_part(plain, F.lit("."), F.lit(2))
    paise = F.array(F.lit("wrupaye"), _item("n", F.rpad(F.left(rest, F.lit(2)), 2, "0")), F.lit("wpaise"))
    return F.concat(F.array(_item("n", rupees)), F.when(rest.rlike("[1-9]"), paise).when(bare, F.array().cast("array<string>")).otherwise(F.array(F.lit("wrupaye"))))


def _month_of(x: Column) -> Column:
    """The month that a word or its short form (sept too) names, else null."""
    table = F.create_map(*[F.lit(y) for m in MONTHS for k in dict.fromkeys((m, m[:3])) for y in (k, m)], F.lit("sept"), F.lit("september"))
    return F.try_element_at(table, F.regexp_replace(F.lower(x), "[.]$", ""))


def spoken_items(before: Column, core: Column, after: Column) -> Column:
    """What is said for a token, as an array of items, given its neighbours; null if it is said as it is written."""
    part = lambda pattern, i: F.regexp_extract(core, pattern, i)
    runs = lambda pattern: F.regexp_extract_all(core, F.lit(pattern), F.lit(0))
    word = lambda w: F.lit("w" + w)
    in_rupees, is_number = _is(after, RUPEES), _is(core, NUMBER)
    clock, date, ordinal, share, span = "([0-9]{1,2}):([0-9]{2})((?i:am|pm)?)", "([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})", "([0-9]{1,2})(?i:st|nd|rd|th|थ|स्ट|न्ड|र्ड)", "([0-9]+)(?:[.]([0-9]+))?%", "([0-9]{1,3})-([0-9]{1,3})"
    attached = f"(?i)(?:₹|rs[.]?|inr|रु[.]?|रू[.]?)({NUMBER})"
    minutes = part(clock, 2)
    month_at = part(date, 2).try_cast("int")
    month = F.get(F.array(*map(word, MONTHS)), month_at - 1)
    year = F.when(F.length(part(date, 3)) == 2, F.concat(F.lit("20"), part(date, 3))).otherwise(part(date, 3))
    whole, fraction = F.split_part(F.replace(core, F.lit(","), F.lit("")), F.lit("."), F.lit(1)), F.split_part(core, F.lit("."), F.lit(2))
    id_run = lambda r: F.when(r.rlike("^([0-9]|[1-9][0-9])$"), _item("n", r)).when(r.rlike("^[0-9]"), _item("d", r)).when(r.rlike("^[A-Za-z]"), _item("l", F.upper(r))).otherwise(_item(RAW, r))
    mail_run = lambda r: F.when(r == "@", "wat").when(r == ".", "wdot").when(r.rlike("^[0-9]"), _number(r)).otherwise(_item(RAW, r))
    mail = F.contains(core, F.lit("@")) & _is(core, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+")
    mixed = lambda said: (
        said.when(_is(core, "[A-Za-z0-9-]+") & core.rlike("[0-9]") & core.rlike("[A-Za-z]"), F.transform(runs("[A-Za-z]+|[0-9]+"), id_run))
        .when(core.rlike("[0-9]") & core.rlike("[ऀ-ॿ]"), F.transform(runs("[0-9]+|[^0-9-]+"), lambda r: F.when(r.rlike("^[0-9]"), id_run(r)).otherwise(_item(RAW, r))))
    )
    number = (
        F.when(_is(before, CURRENCY), _amount(core, F.lit(False)))
        .when(in_rupees, _amount(core, ~F.contains(core, F.lit("."))))
        .when(F.contains(core, F.lit(".")), F.array(_item("n", whole), word("point"), _item("d", fraction)))
        .when(_is(core, "(?:19|20)[0-9]{2}") & _month_of(before).isNotNull(), F.array(_item("y", core)))
        .otherwise(F.array(_number(core)))
    )
    digit_first = mixed(
        F.when(is_number, number)
        .when(_is(core, clock), F.array_compact(F.array(_item("n", part(clock, 1)), F.when(minutes.rlike("^0[1-9]"), word("oh")), F.when(minutes != "00", _item("n", minutes)), F.when(part(clock, 3) != "", _item("l", F.upper(part(clock, 3)))))))
        .when(_is(core, date), F.when(month_at.between(1, 12), F.array(_item("n", part(date, 1)), month, _item("y", year))).otherwise(F.array(_item("d", core))))
        .when(_is(core, ordinal), F.array(_item("o", part(ordinal, 1))))
        .when(_is(core, share), F.array_compact(F.array(_item("n", part(share, 1)), F.when(part(share, 2) != "", word("point")), F.when(part(share, 2) != "", _item("d", part(share, 2))), word("percent"))))
        .when(_is(core, span), F.array(_item("n", part(span, 1)), word("to"), _item("n", part(span, 2))))
    )
    other = mixed(
        F.when(_is(core, attached), _amount(part(f"^{attached}$", 1), in_rupees))
        .when(_is(core, CURRENCY) & _is(after, NUMBER), F.array().cast("array<string>"))
        .when(_is(core, "(?i)am|pm|a[.]m|p[.]m") & (_is(before, NUMBER) | _is(before, "[0-9]{1,2}:[0-9]{2}")), F.array(_item("l", F.upper(F.replace(core, F.lit("."), F.lit(""))))))
        .when(_is(core, "[+][0-9]+"), F.array(word("plus"), _item("d", core)))
        .when(_is(core, "[xX][0-9]{1,2}"), F.array(_item("n", F.substring(core, 2, 9))))
    ).when(_is(core, "[A-Z]{2,4}") & ~core.isin(*WHOLE), F.array(_item("l", core))).when(_is(core, "[A-Za-z]{3,9}") & _month_of(core).isNotNull(), F.array(_item("w", _month_of(core))))
    # What begins with a digit is tried apart, so that a token meets few patterns.
    return F.when(mail, F.transform(runs("[A-Za-z]+|[0-9]+|[@.]"), mail_run)).when(F.ascii(core).between(ord("0"), ord("9")), digit_first).otherwise(other)


def _under_hundred(n: int) -> list[str]:
    return [N.SMALL[n]] if n < 20 else [N.TENS[n // 10 - 2], *([N.SMALL[n % 10]] if n % 10 else [])]


def _cardinal(n: int) -> list[str]:
    """The words of a whole number below a thousand crore, on the Indian scale."""
    if n < 100:
        return _under_hundred(n)
    if n >= 10**9:
        return [*_under_hundred(n // 10**9), "hundred", *(_cardinal(n % 10**9) if n % 10**9 >= 10**7 else ["crore", *(_cardinal(n % 10**7) if n % 10**7 else [])])]
    value, scale = next((v, w) for w, v in reversed(N.SCALES.items()) if n >= v)
    return [*_under_hundred(n // value), scale, *(_cardinal(n % value) if n % value else [])]


def _year(n: int) -> list[str]:
    if 2000 <= n < 2010:
        return _cardinal(n)
    return [*_under_hundred(n // 100), *(["hundred"] if n % 100 == 0 else ["oh"] if n % 100 < 10 else []), *(_under_hundred(n % 100) if n % 100 else [])]


def canonical(item: str) -> list[str]:
    """The words of an item; numbers of more than ten digits are said digit by digit, and so are years of other than two or four digits."""
    kind, text = item[0], item[1:]
    n = int(text) if kind in "noy" and text.isascii() and text.isdigit() and len(text) <= LONGEST else None
    if kind == "w":
        return [text]
    if kind == "l":
        return list(text)
    if kind == "n" and n is not None:
        return _cardinal(n)
    if kind == "o" and n is not None:
        *first, last = _cardinal(n)
        return [*first, N.IRREGULAR.get(last) or (f"{last[:-1]}ieth" if last.endswith("y") else f"{last}th")]
    if kind == "y" and n is not None and len(text) == 4:
        return _year(n)
    return [N.SMALL[int(d)] for d in re.findall("[0-9]", text)]


@lru_cache(1 << 16)
def rendered(item: str) -> tuple[str, str]:
    """An item for a voice, in Latin letters and in Devanagari; what is said as it is written loses other letters in the first."""
    if item[0] == RAW:
        return re.sub("[^a-z']", "", item[1:].lower()), item[1:]
    forms = [SAID[w] for w in canonical(item) if w in SAID]
    return " ".join(x for _, x in forms), " ".join(x for x, _ in forms)


@F.pandas_udf(T.StructType([T.StructField(x, T.StringType()) for x in ("latin", "devanagari")]))
def voiced(items: pd.Series) -> pd.DataFrame:
    """Items between blanks -> what is said in both scripts. Tokens have no blanks, so items have none."""
    forms = [[rendered(item) for item in x.split(" ") if item] for x in items]
    return pd.DataFrame({"latin": [" ".join(x for x, _ in row if x) for row in forms], "devanagari": [" ".join(x for _, x in row if x) for row in forms]})


def _core(token: Column) -> Column:
    """A token without the marks around it; a line separator at its end, which a pattern's end steps over, needs the pattern."""
    odd = token.endswith("\u0085") | token.endswith("\u2028") | token.endswith("\u2029")
    return F.when(odd, F.regexp_replace(token, f"^[{MARKS}]+|[{MARKS}]+$", "")).otherwise(F.btrim(token, F.lit(MARKS.replace("\\", ""))))


def found(words: Column, everything: bool = False) -> Column:
    """The tokens of a text that are said otherwise than they are written, as an array of (place, token, before, core, items) in their order; with ``everything``, all tokens. ``words`` is a column of ``tokens``."""
    pattern = f"(?i)[0-9]|^[{MARKS}]*[ap][.]?m[{MARKS}]*$|^[{MARKS}]*(sept|{'|'.join(f'{m[:3]}({m[3:]})?' for m in MONTHS)})[{MARKS}]*$|(?-i:[A-Z]{{2}})"
    likely = lambda w: F.lit(True) if everything else w.rlike(pattern)
    beside = lambda i: _core(F.coalesce(F.get(words, i), F.lit("")))
    # Each step binds what the next one uses more than once.
    picked = F.array_compact(F.transform(words, lambda w, i: F.when(likely(w), F.struct(i.alias("place"), w.alias("token"), beside(i - 1).alias("before"), _core(w).alias("core"), beside(i + 1).alias("after")))))

    def made(x: Column) -> Column:
        items = spoken_items(x["before"], x["core"], x["after"])
        if everything:
            items = F.coalesce(items, F.when(x["core"] != "", F.array(_item(RAW, x["core"]))).otherwise(F.array().cast("array<string>")))
        return F.struct(x["place"].alias("place"), x["token"].alias("token"), x["before"].alias("before"), x["core"].alias("core"), F.array_join(items, " ").alias("items"))

    # What is said as written has no items.
    return F.filter(F.transform(picked, made), lambda x: F.lit(everything) | (x["items"] != ""))


def tokens(text: Column) -> Column:
    """The words of a text; digits may be Devanagari. Null and empty texts have none."""
    plain = F.translate(F.coalesce(text, F.lit("")), "०१२३४५६७८९", "0123456789")
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def groups(texts: DataFrame, key: str, text: str, everything: bool = False) -> DataFrame:
    """(key, place, lead, written, trail, latin, devanagari): the tokens of a text that are said otherwise than they are
    written, each with the marks around it; with ``everything``, all tokens.

    A currency and the number after it are one group, at the number's place. Digits may be Devanagari. Null and empty texts
    have no rows. A text is one row until its tokens are found, so nothing is shuffled.
    """
    rows = texts.select(key, tokens(F.col(text)).alias("_w")).select(key, F.explode(found(F.col("_w"), everything)).alias("_x"))
    token, before, core = F.col("_x.token"), F.col("_x.before"), F.col("_x.core")
    lead, trail = F.regexp_extract(token, f"^[{MARKS}]*", 0), F.regexp_extract(token, f"[{MARKS}]*$", 0)
    whole = F.when(_is(before, CURRENCY) & _is(core, NUMBER), F.concat_ws(" ", before, core)).otherwise(core)
    bare = core == ""
    said = rows.select(key, F.col("_x.place").alias("place"), F.when(bare, token).otherwise(lead).alias("lead"), whole.alias("written"), F.when(bare, "").otherwise(trail).alias("trail"), voiced("_x.items").alias("_s"))
    return said.select(key, "place", "lead", "written", "trail", F.col("_s.latin").alias("latin"), F.col("_s.devanagari").alias("devanagari"))
