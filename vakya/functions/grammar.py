"""Spoken numbers in running text: English and Hindi, in Latin and Devanagari letters, to digits.

A token is a number word, a multiplier, a fraction before one, a repeat (double), digits, or a link (and, point); what
it is comes from one table. Runs of such tokens are read by one parser: a small number (tens and ones), times a hundred,
times greater multipliers in falling order; what doesn't continue a number begins the next, and numbers that follow each
other are written together, as digits of phones and identifiers are. What stands around a run decides the rest: capitals
before it are its prefix, a unit or a place word makes a single Hindi word a number, neighbours in front of days or
people are an estimate and stay words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number words in their order, and words around numbers.
ENGLISH = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
ENGLISH_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
HINDI = """shunya ek do teen char paanch chhah saat aath nau das gyarah barah terah chaudah pandrah solah satrah atharah unnis
bees ikkis baais teis chaubis pachchis chhabbis sattais atthais untees tees ikattis battis taintis chautis paintis chhattis saintis adtis untalis
chalis iktalis bayalis tentalis chavalis paintalis chhiyalis saintalis adtalis unchas pachas ikyavan bavan tirpan chauvan pachpan chhappan sattavan atthavan unsath
saath iksath basath tirsath chausath painsath chhiyasath sadsath adsath unhattar sattar ikhattar bahattar tihattar chauhattar pachhattar chhihattar sathattar athhattar unasi
assi ikyasi bayasi tirasi chaurasi pachasi chhiyasi sattasi athasi navasi nabbe ikyanve banve tiranve chauranve pachanve chhiyanve sattanve atthanve ninyanve""".split()
DEVANAGARI = """शून्य एक दो तीन चार पांच छह सात आठ नौ दस ग्यारह बारह तेरह चौदह पंद्रह सोलह सत्रह अठारह उन्नीस
बीस इक्कीस बाईस तेईस चौबीस पच्चीस छब्बीस सत्ताईस अट्ठाईस उनतीस तीस इकतीस बत्तीस तैंतीस चौंतीस पैंतीस छत्तीस सैंतीस अड़तीस उनतालीस
चालीस इकतालीस बयालीस तैंतालीस चवालीस पैंतालीस छियालीस सैंतालीस अड़तालीस उनचास पचास इक्यावन बावन तिरपन चौवन पचपन छप्पन सत्तावन अट्ठावन उनसठ
साठ इकसठ बासठ तिरसठ चौंसठ पैंसठ छियासठ सड़सठ अड़सठ उनहत्तर सत्तर इकहत्तर बहत्तर तिहत्तर चौहत्तर पचहत्तर छिहत्तर सतहत्तर अठहत्तर उन्यासी
अस्सी इक्यासी बयासी तिरासी चौरासी पचासी छियासी सत्तासी अट्ठासी नवासी नब्बे इक्यानवे बानवे तिरानवे चौरानवे पचानवे छियानवे सत्तानवे अट्ठानवे निन्यानवे""".split()
#: English words as heard in Devanagari.
HEARD = {"जीरो": 0, "वन": 1, "टू": 2, "थ्री": 3, "त्री": 3, "फोर": 4, "फाइव": 5, "सिक्स": 6, "सेवन": 7, "एट": 8, "नाइन": 9, "टेन": 10, "इलेवन": 11, "ट्वेल्व": 12, "थर्टीन": 13, "फोर्टीन": 14, "फिफ्टीन": 15, "सिक्सटीन": 16, "सेवनटीन": 17, "एटीन": 18, "नाइनटीन": 19, "ट्वेंटी": 20, "थर्टी": 30, "फोर्टी": 40, "फिफ्टी": 50, "सिक्सटी": 60, "सेवेंटी": 70, "एटी": 80, "नाइंटी": 90}
VARIANTS = {"chhe": 6, "chhey": 6, "panj": 5, "dus": 10, "shoonya": 0, "igyarah": 11, "tintis": 33, "chontis": 34, "pentis": 35, "fourty": 40}
MULTIPLIERS = {"hundred": 100, "thousand": 1000, "lakh": 10**5, "lakhs": 10**5, "lac": 10**5, "lacs": 10**5, "crore": 10**7, "crores": 10**7, "million": 10**6, "हंड्रेड": 100, "थाउजेंड": 1000}
HINDI_MULTIPLIERS = {"sau": 100, "hazaar": 1000, "hajaar": 1000, "karod": 10**7, "सौ": 100, "हजार": 1000, "लाख": 10**5, "करोड": 10**7}
FRACTIONS = {"dedh": 1.5, "derh": 1.5, "dhai": 2.5, "डेढ": 1.5, "ढाई": 2.5}
ADDED = {"saadhe": 0.5, "sawa": 0.25, "साढे": 0.5, "सवा": 0.25}
REPEATS = {"double": 2, "triple": 3, "डबल": 2, "ट्रिपल": 3}
UNITS = "rs rupees rupee rupaye rupay rupaiya rupiya inr ₹ रुपये रुपए रुपया रूपये minute minutes min mins मिनट second seconds sec secs सेकंड hour hours hr hrs gb mb kb जीबी एमबी % percent परसेंट प्रतिशत pm am p.m a.m बजे baje baj km kms kilometer किलोमीटर kg kgs किलो kilo paise paisa पैसे points".split()
PLACES = "rs ₹ inr flat sector gate terminal seat row platform floor block tower plot house room coach berth ending pin pincode otp extension ext version no flight cvv phase part stage level wing".split()
SEATS = "seat flat gate terminal row block tower platform berth coach house plot".split()
COUNTED = "din dino days day minute minutes mins ghante ghanta hours hour hafte weeks week mahine months month saal years baar times log people दिन दिनों मिनट घंटे हफ्ते महीने साल बार लोग".split()
CLOCK = "am pm a.m p.m aim बजे baje एएम पीएम".split()
MOMENTS = "minute min second sec मिनट सेकंड".split()
#: Number words that are more often something else.
EVERYDAY = "ek do teen tin char chaar saat nau das एक दो तीन चार सात नौ दस".split()
SOUND_ALIKE = ("one", "two", "four", "eight")
NO_PREFIX = "I ID PNR OTP GB MB KB AM PM OK CVV PIN UPI SIM ETA EMI ATM KYC IFSC NEFT INR RS SMS TV".split()
MARKS = ".,!?;:\"'()[]{}|।…“”‘’"
NATIVE_DIGITS = {0x0966 + i: str(i) for i in range(10)}
MAIL = re.compile(r"(mail|mel|mil)$|^(yahoo|outlook|icloud|rediff|proton|live|zoho|aol|msn|jio)|मेल|याहू")


def fold(word: str) -> str:
    """A key for spellings: small letters, no dots below, one sign for nasals."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", word.lower()).replace("़", "").replace("ँ", "ं"))


def sound(word: str) -> str:
    """A key for Latin spellings of Hindi: long vowels and doubled letters once, no silent end."""
    for a, b in (("aa", "a"), ("ee", "i"), ("oo", "u"), ("ou", "au"), ("w", "v"), ("z", "j")):
        word = word.replace(a, b)
    word = re.sub(r"(.)\1", r"\1", word.replace("chh", "ch"))
    return re.sub(r"(?<=a)h$", "", word)


#: word -> (kind, value, language); kinds: n (a number below 100), m, f, a, r. Hindi in Latin letters is found by sound.
TABLE: dict[str, tuple[str, float, str]] = {w: ("n", i, "en") for i, w in enumerate(ENGLISH)} | {w: ("n", 10 * i, "en") for i, w in enumerate(ENGLISH_TENS, 2)} | {fold(w): ("n", i, "de") for w, i in HEARD.items()} | {fold(w): ("n", i, "hi") for i, w in enumerate(DEVANAGARI)}
for _kind, _words in (("m", MULTIPLIERS), ("f", FRACTIONS), ("a", ADDED), ("r", REPEATS)):
    TABLE |= {fold(w): (_kind, v, "en" if _kind == "m" else "hi") for w, v in _words.items()}
TABLE |= {fold(w): ("m", v, "hi") for w, v in HINDI_MULTIPLIERS.items()}
BY_SOUND = {sound(w): ("n", i, "hi") for i, w in enumerate(HINDI)} | {sound(w): ("n", i, "hi") for w, i in VARIANTS.items()} | {sound(w): ("m", v, "hi") for w, v in HINDI_MULTIPLIERS.items() if w.isascii()}


def _may_sound(keys: Iterable[str]) -> frozenset[str]:
    """First and last letters of all words that may sound like the keys."""
    first, last = {"v": "vw", "j": "jz", "i": "ie", "u": "uo", "a": "ao"}, {"v": "vw", "j": "jz", "i": "ie", "u": "uo", "a": "ah"}
    return frozenset(a + b for k in keys for a in first.get(k[0], k[0]) for b in last.get(k[-1], k[-1]))


ENDS = _may_sound(BY_SOUND)
#: Words found to have no number, at most ``MOST`` of at most ``LONG`` letters; a task's texts share most of their words.
PLAIN: set[str] = set()
MOST, LONG = 1 << 18, 48


@lru_cache(1 << 16)
def classed(raw: str) -> tuple:
    """(marks before, word, marks after, key, prefix, kind, value, language) of a word; words repeat, so most are looked up."""
    core = raw.strip(MARKS)
    at = raw.find(core) if core else len(raw)
    key, prefix = fold(core), ""
    kind, value, lang = TABLE.get(key) or (BY_SOUND.get(sound(key), ("", 0, "")) if core.isascii() and key[:1] + key[-1:] in ENDS else ("", 0, ""))
    digits = core.translate(NATIVE_DIGITS)
    if re.fullmatch(r"[0-9]{1,3}(,[0-9]{2,3})+|[0-9]+", digits):
        kind, value = "d", digits.replace(",", "")
    elif glued := re.fullmatch(r"([A-Z]{1,4})-?([0-9]+)", digits):
        kind, prefix, value = "d", glued[1], glued[2]
    return raw[:at], core, raw[at + len(core) :], key, prefix, kind, value, lang


class Token:
    """A word with its marks; kind is that of TABLE, d (digits), or empty."""

    __slots__ = ("lead", "core", "trail", "key", "prefix", "kind", "value", "lang")

    def __init__(self, raw: str) -> None:
        self.lead, self.core, self.trail, self.key, self.prefix, self.kind, self.value, self.lang = classed(raw)

    @property
    def digit(self) -> bool:
        """Said as one digit."""
        return self.kind == "n" and self.value < 10 and self.lang != "hi" or self.kind == "d" and len(self.value) == 1 and not self.prefix

    def become(self, core: str, kind: str = "", value: float = 0, lang: str = "en") -> None:
        self.core, self.key, self.kind, self.value, self.lang = core, core, kind, value, lang


def hear_eights(tokens: list[Token]) -> None:
    """``at`` among digits is a misheard eight; ``eight`` before the name of a mail service is a misheard at."""
    for t, after in zip(tokens, tokens[1:], strict=False):
        if t.key in ("eight", "एट") and not t.trail and MAIL.search(after.key):
            t.become("at")
    i = 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and tokens[j].key == "at" and not tokens[j].lead:
            j += 1
            if tokens[j - 1].trail:
                break
        if j == i:
            i += 1
            continue
        before = after = 0
        k = i - 1
        while k >= 0 and tokens[k].digit and not tokens[k].trail:
            before, k = before + 1, k - 1
        k = j
        while k < len(tokens) and (tokens[k].digit or tokens[k].kind == "r" and k + 1 < len(tokens) and tokens[k + 1].digit) and not tokens[k - 1].trail:
            after, k = after + (int(tokens[k].value) - 1 if tokens[k].kind == "r" else 1), k + 1
        follows = tokens[k] if k < len(tokens) else None
        clock = follows is not None and (follows.key in CLOCK or follows.key in ("o'clock", "clock") or follows.kind == "m" or follows.kind == "n" and follows.value >= 10)
        total = before + (j - i) + after
        if after and not clock and (total >= 4 if before or prefix_before(tokens, i) < i else total == 10):
            for t in tokens[i:j]:
                t.become("eight", "n", 8)
        i = j


def prefix_before(tokens: list[Token], i: int) -> int:
    """Where the capitals begin that belong to the number at i; i if there are none."""
    k = i - 1
    if k < 0 or tokens[k].trail or not re.fullmatch("[A-Z]{1,4}", tokens[k].core) or tokens[k].core in NO_PREFIX:
        return i
    while len(tokens[k].core) == 1 and k > 0 and re.fullmatch("[A-Z]", tokens[k - 1].core) and not tokens[k - 1].trail and tokens[k - 1].core != "I":
        k -= 1
    return k


def run_at(tokens: list[Token], i: int) -> int:
    """The end of the run of number tokens that begins at i; i if none does."""
    j = i
    while j < len(tokens):
        t, inner = tokens[j], j > i
        if inner and (tokens[j - 1].trail or t.lead or t.prefix):
            break
        more = tokens[j + 1] if j + 1 < len(tokens) else None
        linked = inner and more is not None and more.kind in ("n", "d") and not t.trail
        if t.kind and not (t.key == "saath" and inner and tokens[j - 1].key == "ek"):
            j += 1
        elif linked and (t.key == "point" or t.key == "and" and tokens[j - 1].kind == "m" or t.key in ("oh", "o") and tokens[j - 1].digit and more.digit):
            j += 1
        else:
            break
    return j


class Parser:
    """Reads the tokens of a run; ``groups`` has its numbers as they are written, or None where they make up none."""

    def __init__(self, run: list[Token]) -> None:
        self.run, self.i = run, 0
        self.groups: list[str] | None = []
        while self.i < len(run) and self.groups is not None:
            self.read()

    def kind(self, ahead: int = 0) -> str:
        at = self.i + ahead
        return self.run[at].kind if at < len(self.run) else ""

    def value(self) -> float:
        self.i += 1
        return self.run[self.i - 1].value

    def read(self) -> None:
        t = self.run[self.i]
        if t.kind == "r":
            self.i += 1
            if self.kind() in ("n", "d") and self.run[self.i].digit | (self.kind() == "n" and self.run[self.i].value < 10):
                self.groups.append(str(self.value()) * int(t.value))
            else:
                self.groups = None
        elif t.kind == "d" and self.kind(1) != "m":
            self.groups.append(self.value())
        elif t.key in ("oh", "o"):
            self.i += 1
            self.groups.append("0")
        elif t.key == "point" and self.groups:
            self.i += 1
            part = ""
            while self.kind() in ("n", "d"):
                part += str(self.value())
            self.groups[-1] += f".{part}"
        else:
            found = self.number()
            if found is None:
                self.groups = None
            else:
                self.groups.append(str(int(found)) if found == int(found) else str(found))

    def small(self) -> float:
        """Tens and ones, or digits before a multiplier."""
        first = self.value()
        t = self.run[self.i - 1]
        if t.kind == "d":
            return int(first)
        if t.lang != "hi" and first >= 20 and first % 10 == 0 and self.kind() == "n" and 0 < self.run[self.i].value < 10 and self.run[self.i].lang != "hi":
            first += self.value()
        return first

    def hundreds(self) -> float | None:
        """A number below a thousand, or the fraction of what follows."""
        if self.kind() == "f":
            return self.value() if self.kind(1) == "m" else None
        added = self.value() if self.kind() == "a" else 0
        found = 1 if self.kind() == "m" else self.small() if self.kind() in ("n", "d") else None
        if found is None or added and self.kind() != "m":
            return None
        return found + added

    def number(self) -> float | None:
        total, last = 0.0, float("inf")
        while True:
            part = self.hundreds()
            if part is None:
                return None
            if self.kind() == "m" and self.run[self.i].value == 100:
                part *= self.value()
                self.skip_and()
                if self.kind() == "n" and not self.begins_multiple(100):
                    part += self.small()
            if self.kind() == "m" and self.run[self.i].value < last:
                last = self.value()
                total += part * last
                self.skip_and()
                if self.kind() in ("n", "f", "a") and self.remainder_fits(last):
                    continue
                return total
            return total + part

    def skip_and(self) -> None:
        if self.i < len(self.run) and self.run[self.i].key == "and":
            self.i += 1

    def begins_multiple(self, least: float) -> bool:
        """Whether the small number ahead is itself multiplied by as much."""
        at, self.i = self.i, self.i
        self.small()
        found = self.kind() == "m" and self.run[self.i].value <= least
        self.i = at
        return found

    def remainder_fits(self, last: float) -> bool:
        """Whether what follows a multiplier is less than it: no multiplier of its size comes with it."""
        at, kind = self.i, self.kind()
        self.i += kind in ("f", "a")
        if self.kind() in ("n", "d"):
            self.small()
        found = self.kind() != "m" or self.run[self.i].value < last
        self.i = at
        return found


def estimate(run: list[Token], after: Token | None) -> bool:
    """Two small numbers, the second a little greater, of what is counted (or in Hindi of nothing): no number is meant."""
    if len(run) != 2 or any(t.kind != "n" for t in run) or run[0].lang != "hi" and run[0].value >= 20:
        return False
    a, b = run[0].value, run[1].value
    near = a < b <= max(a + 2, 2 * a) and b <= 20
    return near and (after is not None and after.key in COUNTED or all(t.lang == "hi" for t in run) and (b - a <= 2 or b == 2 * a))


def alone(t: Token, before: Token | None, after: Token | None, prefixed: bool) -> bool:
    """Whether a single number word is meant as a number."""
    if t.kind == "d":
        return True
    if t.kind not in ("n", "m"):
        return False
    placed = before is not None and before.key in PLACES
    if after is not None and after.key in MOMENTS and (t.key in EVERYDAY or t.value == 1) and not placed:
        return False
    if prefixed or placed or after is not None and after.key in UNITS and not t.trail:
        return True
    return t.kind == "n" and t.lang == "en" and t.key not in SOUND_ALIKE


def written(run: list[Token], before: Token | None, after: Token | None, prefixed: bool) -> str | None:
    """A run as digits, or None if it stays as it is."""
    if len(run) == 1 and not alone(run[0], before, after, prefixed) or estimate(run, after):
        return None
    if all(t.kind == "d" for t in run):
        digits = "".join(t.value for t in run)
        return digits if len(run) == 1 and (not run[0].core.isascii() or run[0].prefix or prefixed) or len(run) > 1 and len(digits) == 10 else None
    groups = Parser(run).groups
    if not groups:
        return None
    if len(groups) == 2 and after is not None and after.key in CLOCK and all(g.isdigit() for g in groups) and 1 <= int(groups[0]) <= 12 and 10 <= int(groups[1]) < 60:
        return ":".join(groups)
    return "".join(groups)


def plain(raw: str) -> bool:
    """Whether neither a word nor all its parts between hyphens are number tokens."""
    core = raw.strip(MARKS)
    if core.isascii():
        key = core.lower()
        # All words of the tables are of letters alone, and what has digits ends with one.
        if core.isalpha():
            if key not in TABLE and (key[0] + key[-1] not in ENDS or sound(key) not in BY_SOUND):
                return True
        elif "-" not in raw and not core[-1:].isdigit():
            return True
    return not any(classed(x)[5] if len(x) <= LONG else classed.__wrapped__(x)[5] for x in pieces([raw]))


def pieces(words: Iterable[str]) -> Iterator[str]:
    """Words; number words with hyphens come apart."""
    for raw in words:
        parts = raw.split("-") if "-" in raw else ()
        yield from parts if parts and all(Token(p).kind == "n" for p in parts) else [raw]


def numbered(words: list[str]) -> set[str]:
    """Those of the words that have a number token."""
    fresh = set(words) - PLAIN
    found = {x for x in fresh if not plain(x)}
    if len(PLAIN) + len(fresh) > MOST:
        PLAIN.clear()
    PLAIN.update(x for x in fresh - found if len(x) <= LONG)
    return found


def surroundings(raw: list[str], at: list[int]) -> Iterator[tuple[int, int]]:
    """Spans of words that hold all number tokens, what belongs to them (capitals and ``at`` before them) and a word or two around; a word elsewhere neither changes nor changes anything."""
    start = stop = 0
    for i in at:
        a = i
        while a > stop and re.fullmatch("[A-Z]{1,4}|[Aa][Tt]", raw[a - 1].strip(MARKS)):
            a -= 1
        a = max(a - 2, 0)
        if a > stop:
            if stop > start:
                yield start, stop
            start = a
        stop = min(i + 3, len(raw))
    yield start, stop


def convert(text: str) -> str:
    """The text with its spoken numbers as digits; all else stays as it is."""
    words = text.split(" ")
    found = numbered(words)
    if not found:
        return text
    raw = list(pieces(words)) if any("-" in x for x in found) else words
    # Parts of a word with hyphens may be new.
    at = [i for i, x in enumerate(raw) if x in found or x not in PLAIN and not plain(x)]
    out, done = [], 0
    for a, b in surroundings(raw, at):
        out += raw[done:a]
        out += converted([Token(x) for x in raw[a:b]])
        done = b
    return " ".join(out + raw[done:])


def converted(tokens: list[Token]) -> list[str]:
    """Tokens as they are written, spoken numbers as digits."""
    hear_eights(tokens)
    out: list[str] = []
    i = 0
    while i < len(tokens):
        j = run_at(tokens, i)
        if j == i:
            out.append(tokens[i].lead + tokens[i].core + tokens[i].trail)
            i += 1
            continue
        run, start = tokens[i:j], prefix_before(tokens, i)
        found = written(run, tokens[i - 1] if i else None, tokens[j] if j < len(tokens) else None, start < i)
        if found is None:
            out += [t.lead + t.core + t.trail for t in run]
        else:
            taken = out[len(out) - (i - start) :] if start < i else []
            del out[len(out) - len(taken) :]
            lead = taken[0][: len(taken[0]) - len(taken[0].lstrip(MARKS))] if taken else run[0].lead
            letter = tokens[j].core if j < len(tokens) and not run[-1].trail and re.fullmatch("[A-Z]", tokens[j].core) and tokens[j].core != "I" and i and tokens[i - 1].key in SEATS else ""
            trail = tokens[j].trail if letter else run[-1].trail
            out.append(lead + "".join(x.strip(MARKS) for x in taken) + run[0].prefix + found + letter + trail)
            j += bool(letter)
        i = j
    return out


DIGITS = re.compile(r"[0-9]{1,3}(?:,[0-9]{2,3})+(?![0-9])|(?<![0-9A-Za-z])[0-9]+(?: [0-9]+)+(?![0-9A-Za-z])|[0-9]+")

FIRST_DIGIT, NATIVE = re.compile("[0-9]"), re.compile("[०-९]")


def numbers_in(text: str) -> list[str]:
    """The numbers of a text: grouped ones without commas; neighbours as one where they are single digits or ten digits together."""
    found = []
    text = text.translate(NATIVE_DIGITS) if NATIVE.search(text) else text
    at = FIRST_DIGIT.search(text)
    while at:
        m = DIGITS.match(text, at.start())
        at = FIRST_DIGIT.search(text, m.end())
        parts = m[0].replace(",", "").split(" ")
        found += ["".join(parts)] if all(len(p) == 1 for p in parts) or len("".join(parts)) == 10 else parts
    return found


@F.pandas_udf(T.StringType())
def spoken_to_written(x: pd.Series) -> pd.Series:
    """``convert`` on a column; null stays null."""
    return x.map(lambda t: None if t is None else convert(t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def written_numbers(x: pd.Series) -> pd.Series:
    """``numbers_in`` on a column; null stays null."""
    return x.map(lambda t: None if t is None else numbers_in(t))
