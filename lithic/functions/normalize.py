"""Text normalisation and field parsers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Endings of company names.
CORPORATE = (
    "inc", "incorporated", "llc", "l.l.c", "ltd", "limited", "co", "company", "corp", "corporation", "plc",
    "gmbh", "ag", "sa", "s.a", "nv", "n.v", "pty", "bv", "b.v",
)

# Address words and what they stand for.
ADDRESS = {
    "st": "Street", "ave": "Avenue", "av": "Avenue", "blvd": "Boulevard", "rd": "Road", "dr": "Drive", "ln": "Lane",
    "ct": "Court", "pl": "Place", "sq": "Square", "ter": "Terrace", "pkwy": "Parkway", "hwy": "Highway",
    "n": "North", "s": "South", "e": "East", "w": "West", "ne": "Northeast", "nw": "Northwest", "se": "Southeast",
    "sw": "Southwest", "fl": "Floor", "ste": "Suite", "apt": "Apartment",
}

#: Letters without a decomposition, and ASCII for them.
LETTERS = {"ß": "ss", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "þ": "th", "Þ": "Th", "ð": "d", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}

# Cyrillic and Greek letters in Latin ones.
LETTERS |= dict(zip("абвгдезийклмнопрстуфыэ", "abvgdeziiklmnoprstufye", strict=True)) | {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "iu", "я": "ia", "і": "i", "є": "ie", "ґ": "g", "ђ": "dj", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "џ": "dz"}
LETTERS |= dict(zip("αβγδεζηικλμνξοπρστυφωςϊϋ", "abgdeziiklmnxoprstyfosiy", strict=True)) | {"η": "e", "θ": "th", "χ": "ch", "ψ": "ps"}
LETTERS |= {k.upper(): v.capitalize() for k, v in LETTERS.items() if k.islower() and len(k.upper()) == 1 and k.upper() not in LETTERS}

RULES = ("nfkd_fold", "strip_special_chars", "expand_address_abbrev", "case_fold", "strip_punctuation", "strip_corporate_suffix", "collapse_whitespace")


@F.pandas_udf(T.StringType())
def _fold(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None or t.isascii():
            return t
        flat = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return "".join(LETTERS.get(c, c) for c in flat)

    return texts.map(one, na_action="ignore")


def nfkd_fold(text: Column) -> Column:
    return _fold(text)


# General categories of characters that are taken out.
SPECIAL = ("Cc", "Cf", "Cn", "Co", "Cs", "Sk", "So")
# Characters that punctuation is.
PUNCTUATION = ",;:!?\"'`()[]{}<>/\\|_*~^"


def strip_special_chars(text: Column) -> Column:
    return F.regexp_replace(text, "[" + "".join(rf"\p{{{c}}}" for c in SPECIAL) + "]", "")


def expand_address_abbrev(text: Column) -> Column:
    """Whole words of the table; a single letter only as a capital; "St" before a capital is "Saint".

    The text is cut into words and what stands between them, and each piece is looked up
    once. A dot behind an expanded word goes if a blank or the end follows it.
    """
    pieces = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), 0)
    none = F.array(F.lit(None).cast("string"))
    shifted = lambda k: F.concat(F.slice(pieces, k + 1, F.size(pieces)), *[none] * k)
    around = F.arrays_zip(F.concat(none, pieces).alias("before"), pieces.alias("own"), shifted(1).alias("next"), shifted(2).alias("after"))
    table = F.create_map(*[F.lit(x) for pair in ADDRESS.items() for x in pair])

    def full(word: Column, after: Column) -> Column:
        saint = (F.lower(word) == "st") & after.rlike(r"^(\.(?=\s))?\s*\p{Lu}")
        known = F.when((F.length(word) > 1) | (word == F.upper(word)), F.try_element_at(table, F.lower(word)))
        return F.when(saint, "Saint").otherwise(known)

    def piece(at: Column) -> Column:
        before, own = at["before"], at["own"]
        alone = full(before, F.concat_ws("", own, at["next"])).isNotNull() & own.rlike(r"^\.(\s|$)") & (own.rlike(r"^\.\s") | at["next"].isNull())
        return F.coalesce(full(own, F.concat_ws("", at["next"], at["after"])), F.when(alone, F.substring(own, F.lit(2), F.length(own))), own, F.lit(""))

    return F.when(F.size(pieces) > 0, F.array_join(F.transform(around, piece), "")).otherwise(text)


def case_fold(text: Column) -> Column:
    """Lower case; letters that fold to several or to another are exchanged first."""
    for letters, folded in (("[ßẞ]", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("[ﬅﬆ]", "st"), ("ŉ", "ʼn"), ("ſ", "s"), ("ς", "σ"), ("µ", "μ")):
        text = F.regexp_replace(text, letters, folded)
    return F.translate(F.lower(text), "ς", "σ")


def strip_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))


def strip_corporate_suffix(text: Column) -> Column:
    """Without the words at the end that name a kind of company; the first word stays."""
    words = F.regexp_extract_all(text, F.lit(r"[\s,]*[^\s,]+"), 0)
    bare = lambda w: F.lower(F.regexp_replace(w, r"^[\s,]+|\.$", ""))
    start = F.struct(F.lit(0).alias("gone"), F.lit(True).alias("on"))

    def step(at: Column, word: Column) -> Column:
        suffix = at["on"] & bare(word).isin(*CORPORATE)
        return F.struct(F.when(suffix, at["gone"] + 1).otherwise(at["gone"]).alias("gone"), suffix.alias("on"))

    gone = F.least(F.aggregate(F.reverse(words), start, step)["gone"], F.size(words) - 1)
    return F.when(gone > 0, F.array_join(F.slice(words, F.lit(1), F.size(words) - gone), "")).otherwise(text)


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column, toggles: dict[str, bool]) -> Column:
    """The enabled rules in their fixed order; blank results are null."""
    unknown = set(toggles) - set(RULES)
    if unknown:
        raise ValueError(f"unknown rules {sorted(unknown)}")
    text = text.cast("string")
    for rule in RULES:
        if toggles.get(rule):
            text = globals()[rule](text)
    return F.when(F.trim(text) != "", text)


def parse_email(text: Column) -> Column:
    """Struct (value, ok)."""
    value = F.lower(F.trim(text))
    ok = F.coalesce(value.rlike(r"^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$"), F.lit(False))
    return F.struct(F.when(ok, value).otherwise(text).alias("value"), ok.alias("ok"))


# National numbers by country calling code, without trunk prefix.
PLANS = {
    "1": r"[2-9]\d{2}[2-9]\d{6}", "7": r"[34689]\d{9}|7\d{9}", "20": r"1[0125]\d{8}|[23]\d{7,8}|[4-9]\d{7,8}", "27": r"[1-8]\d{8}", "30": r"[26]\d{9}", "31": r"[1-9]\d{8}", "32": r"4\d{8}|[1-9]\d{7}", "33": r"[1-9]\d{8}", "34": r"[5-9]\d{8}",
    "36": r"[1-9]\d{7,8}", "39": r"0\d{5,10}|3\d{8,9}|[89]\d{5,9}", "40": r"[2-9]\d{8}", "41": r"[2-9]\d{8}", "43": r"[1-9]\d{3,12}", "44": r"[1235]\d{9}|7\d{9}|[89]\d{8,9}|1\d{8}", "45": r"[2-9]\d{7}", "46": r"[1-9]\d{6,9}", "47": r"[2-9]\d{7}", "48": r"[1-9]\d{8}",
    "49": r"1[567]\d{8,9}|[2-9]\d{5,10}|1[0-489]\d{4,9}", "51": r"9\d{8}|[1-8]\d{7}", "52": r"[2-9]\d{9}", "54": r"9?[1-368]\d{9}", "55": r"[1-9]{2}(?:9\d{8}|[2-5]\d{7})", "56": r"[2-9]\d{8}", "57": r"[36]\d{9}", "58": r"[24]\d{9}", "60": r"[1-9]\d{7,9}", "61": r"[2-478]\d{8}",
    "62": r"[1-9]\d{6,11}", "63": r"[2-9]\d{7,9}", "64": r"[2-9]\d{7,9}", "65": r"[3689]\d{7}", "66": r"[2-9]\d{7,8}", "81": r"[1-9]\d{8,9}", "82": r"[1-9]\d{7,9}", "84": r"[2-9]\d{8,9}", "86": r"1[3-9]\d{9}|[2-9]\d{8,10}|10\d{8}", "90": r"[2-5]\d{9}", "91": r"[1-9]\d{9}",
    "92": r"[2-9]\d{8,9}", "94": r"[1-9]\d{8}", "98": r"[1-9]\d{9}", "234": r"[1-9]\d{6,9}", "254": r"[1-9]\d{6,9}", "351": r"[2-9]\d{8}", "353": r"[1-9]\d{6,9}", "354": r"[4-9]\d{6}", "358": r"[1-9]\d{4,11}", "359": r"[2-9]\d{6,8}", "370": r"[3-9]\d{7}", "371": r"[2689]\d{7}",
    "372": r"[3-9]\d{6,7}", "380": r"[3-9]\d{8}", "385": r"[1-9]\d{7,8}", "386": r"[1-7]\d{7}", "420": r"[2-9]\d{8}", "421": r"[2-9]\d{8}", "852": r"[2-9]\d{7}", "886": r"[2-9]\d{7,8}", "966": r"[1-9]\d{8}", "971": r"[2-9]\d{7,8}", "972": r"[2-9]\d{7,8}",
}
# The other calling codes in use; of their numbers only the length is known here.
OTHER_CODES = (
    "21[12368]", "22\\d", "23[0-35-9]", "24\\d", "25[0-35-8]", "26\\d", "29[01789]", "350", "35[2567]", "37[3-8]", "38[1-3789]", "423", "50\\d", "53", "59\\d", "67[02-9]", "68[0-35-9]", "69[0-2]",
    "80[08]", "85[0356]", "870", "878", "88[0-38]", "93", "95", "96[0-57-8]", "97[03-79]", "99[2-68]",
)
# Calling codes and trunk prefixes of regions.
REGIONS = {
    "US": ("1", "1"), "CA": ("1", "1"), "GB": ("44", "0"), "IE": ("353", "0"), "DE": ("49", "0"), "AT": ("43", "0"), "CH": ("41", "0"), "FR": ("33", "0"), "NL": ("31", "0"), "BE": ("32", "0"), "SE": ("46", "0"), "FI": ("358", "0"), "AU": ("61", "0"), "NZ": ("64", "0"), "JP": ("81", "0"), "KR": ("82", "0"),
    "IN": ("91", "0"), "CN": ("86", "0"), "ZA": ("27", "0"), "TR": ("90", "0"), "BR": ("55", "0"), "UA": ("380", "0"), "RU": ("7", "8"), "IT": ("39", ""), "ES": ("34", ""), "PT": ("351", ""), "DK": ("45", ""), "NO": ("47", ""), "PL": ("48", ""), "CZ": ("420", ""), "GR": ("30", ""), "MX": ("52", ""), "SG": ("65", ""),
}


def parse_phone(text: Column, region: str | None = None) -> Column:
    """Struct (value, ok) in E.164 form; without a region only numbers with a plus sign.

    The calling code must be in use, and the national number must have the first digits and
    the length of its country's plan, as far as PLANS knows it. A trunk zero behind the code
    is dropped where it stands in brackets, and where only without it the number fits.
    Letters and extensions are refused.
    """
    digits = F.regexp_replace(F.regexp_replace(F.trim(text), r"^(\+[\d\s.\-]+)\(0\)", "$1"), r"[\s().\-/]", "")
    codes = [f"{code}(?:{plan})" for code, plan in sorted(PLANS.items())]
    known = rf"^\+(?:{'|'.join(codes)})$"
    other = rf"^\+(?=\d{{7,15}}$)(?:{'|'.join(OTHER_CODES)})[1-9]\d+$"
    zeros = "|".join(c for c, trunk in sorted(set(REGIONS.values())) if trunk == "0")
    bare = F.regexp_replace(digits, rf"^(\+(?:{zeros}))0", "$1")
    number = F.when(digits.rlike(known) | digits.rlike(other), digits).when(bare.rlike(known), bare)
    if region is not None:
        code, trunk = REGIONS[region]
        local = F.regexp_extract(digits, rf"^(?:{trunk})?({PLANS[code]})$", 1)
        number = F.coalesce(number, F.when(local != "", F.concat(F.lit(f"+{code}"), local)))
    return F.struct(F.coalesce(number, text).alias("value"), number.isNotNull().alias("ok"))


# Names of months, and words that may stand in a date besides them.
MONTHS = (
    "january jan januar janvier enero gennaio janeiro januari", "february feb februar février fevrier febrero febbraio fevereiro februari", "march mar märz maerz mars marzo março maart", "april apr avril abril aprile",
    "may mai mayo maggio maio mei", "june jun juni juin junio giugno junho", "july jul juli juillet julio luglio julho", "august aug août aout agosto augustus", "september sept sep septembre septiembre settembre setembro",
    "october oct oktober octobre octubre ottobre outubro", "november nov novembre noviembre novembro", "december dec dezember décembre decembre diciembre dicembre dezembro",
)
DATE_WORDS = "of the de del den der le am on monday mon tuesday tue tues wednesday wed thursday thu thur thurs friday fri saturday sat sunday sun t z utc gmt"
#: Two-digit years from here on are of the last century.
PIVOT = 69


def parse_date(text: Column) -> Column:
    """Struct (value, ok) with an ISO date.

    A date is three fields in any of their orders: a day of one or two digits, a month of one
    or two digits or a name, a year of two or four digits. With a name, the other two are
    day and year, unless the first has four digits. In numbers, a year of four digits first
    means year, month, day (or year, day, month, if only that is a date); else month comes
    before day, or day before month where dots part them, unless only the other order is a date. Eight digits are year, month, day. A
    time and its zone at the end, weekdays, commas, endings of ordinals and words like ``of``
    are passed over. Dates without one of the fields, and any other word, are refused.
    """
    time = r"(?:t|\s+|,\s*|\s+at\s+)\d{1,2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:[ap]\.?m\.?)?|\s*[ap]\.?m\.?)\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2})?$"
    low = F.regexp_replace(F.lower(F.trim(text)), time, "")
    low = F.regexp_replace(low, r"(\d)(?:st|nd|rd|th|er|º|ª)\b", "$1")
    low = F.regexp_replace(low, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    plain = ~low.rlike(r"[^\d\p{L}\s,./'’\-]") & ~low.rlike(r"\d\p{L}{3,}\d|--|//|\.\.")
    tokens = F.regexp_extract_all(low, F.lit(r"(\d+|\p{L}+)"), 1)
    numbers = F.filter(tokens, lambda t: t.rlike(r"^\d"))
    months = F.create_map(*[F.lit(x) for i, names in enumerate(MONTHS, 1) for name in names.split() for x in (name, str(i))])
    words = F.filter(tokens, lambda t: ~t.rlike(r"^\d"))
    named = F.filter(F.transform(words, lambda w: F.try_element_at(months, w)), lambda m: m.isNotNull())
    other = F.filter(words, lambda w: F.try_element_at(months, w).isNull() & ~w.isin(DATE_WORDS.split()))
    field = lambda i: F.get(numbers, F.lit(i))
    short = lambda c: F.length(c) <= 2
    whole = lambda c: F.when(F.length(c) == 4, c).when(F.length(c) == 2, F.when(c.cast("int") < PIVOT, F.concat(F.lit("20"), c)).otherwise(F.concat(F.lit("19"), c)))
    made = lambda y, m, d: F.when(short(d), F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-M-d")))
    year_first = F.length(field(0)) == 4
    month = F.get(named, F.lit(0))
    with_name = F.when(year_first, made(field(0), month, field(1))).otherwise(made(whole(field(1)), month, field(0)))
    a, b, c = field(0), field(1), field(2)
    in_numbers = F.when(year_first, F.coalesce(made(a, b, c), made(a, c, b))).when(low.rlike(r"^\d+\.\d+\.\d+$"), F.coalesce(made(whole(c), b, a), made(whole(c), a, b))).otherwise(F.coalesce(made(whole(c), a, b), made(whole(c), b, a)))
    found = F.when((F.size(other) == 0) & plain, F.when((F.size(named) == 1) & (F.size(numbers) == 2), with_name).when((F.size(named) == 0) & (F.size(numbers) == 3), in_numbers))
    return F.struct(F.coalesce(F.date_format(found, "yyyy-MM-dd"), text).alias("value"), found.isNotNull().alias("ok"))
