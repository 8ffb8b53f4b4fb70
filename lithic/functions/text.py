"""Text and transcript functions: fences, cuts, citations, turns, safe addresses, the sound of words."""

from __future__ import annotations

import json
import re
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT_CHARS, PREVIEW_CHARS = 30_000, 300
CITATIONS = "array<struct<content:array<struct<citations:array<struct<url:string,title:string,cited_text:string>>>>>>"


_FENCED = re.compile(r"```(?:[^\n]*\n)?(.*?)(?:```)?", re.S)


def strip_codefence(raw: str) -> str:
    """What a code block holds, if the text is one; else the text."""
    text = raw.strip()
    found = _FENCED.fullmatch(text)
    return found[1].strip() if found else text


def strip_codefences(text: Column) -> Column:
    """The same as a column."""
    body = F.regexp_replace(F.regexp_replace(_strip(text), r"^```(?:[^\n]*\n)?", ""), r"```$", "")
    return F.when(_strip(text).startswith("```"), _strip(body)).otherwise(_strip(text))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def truncate(text: Column, most: int = RESULT_CHARS) -> Column:
    """Text of at most so many characters; a note with the whole length follows a cut."""
    note = F.concat(F.substring(text, 1, most), F.lit("\n\n[truncated, original was "), F.length(text).cast("string"), F.lit(" chars]"))
    return F.when(F.length(text) > most, note).otherwise(text)


def preview(text: Column, most: int = PREVIEW_CHARS) -> Column:
    note = F.concat(F.substring(text, 1, most), F.lit("... [+"), (F.length(text) - most).cast("string"), F.lit(" more chars]"))
    return F.when(F.length(text) > most, note).otherwise(text)


def join_turns(texts: Column, default: str = "") -> Column:
    """Texts that are not blank, stripped, with an empty line between them; else the default."""
    kept = F.filter(F.transform(texts, _strip), lambda t: t != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n\n")).otherwise(F.lit(default))


def citations(transcript: Column) -> Column:
    """array<struct<url, title, cited_text>>: a transcript's citations, the first of each url; [] for bad JSON."""
    parsed = F.from_json(transcript, CITATIONS)
    blocks = F.flatten(F.filter(F.transform(parsed, lambda s: s["content"]), lambda c: c.isNotNull()))
    cited = F.flatten(F.filter(F.transform(blocks, lambda b: b["citations"]), lambda c: c.isNotNull()))
    named = F.filter(cited, lambda c: F.coalesce(c["url"] != "", F.lit(False)))
    urls = F.transform(named, lambda c: c["url"])
    first = F.filter(named, lambda c, i: F.array_position(urls, c["url"]) == i + 1)
    shaped = F.transform(first, lambda c: F.struct(c["url"].alias("url"), F.when(c["title"] != "", c["title"]).otherwise(c["url"]).alias("title"), c["cited_text"].alias("cited_text")))
    return F.coalesce(shaped, F.from_json(F.lit("[]"), "array<struct<url:string,title:string,cited_text:string>>"))


#: Full-width signs and the ASCII ones that clients read in their place, dots of other scripts among them.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3002\uff61"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + ".."


def safe_url(url: Column) -> Column:
    """Whether an address is http(s) and does not name a private, local or reserved host.

    The authority is read as clients do: up to the first slash, question mark or hash, without
    what stands before an ``@``; with more than one ``@``, or with backslashes, spaces or
    percent signs, clients differ, and it is refused. Full-width signs and dots of other
    scripts count as the ASCII ones, numerals of other scripts are refused. Numeric hosts
    count only as four decimal numbers without leading zeros, bracketed ones only as global
    unicast addresses without an embedded older one; dots at the end of a name are dropped.
    """
    authority = F.translate(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), _WIDE, _NARROW)
    clear = ~authority.rlike(r"@.*@|[\\\s%\p{Cc}\p{Cf}]|[\p{N}&&[^0-9]]") & ~authority.rlike("[/?#]")
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^[^@]*@", ""), r":\d*$", ""))
    host = F.regexp_replace(host, r"\.+$", "")
    web = F.lower(url).rlike("^https?://")
    # Address ranges and names that are not public.
    closed = r"^(0|10|127)\.|^169\.254\.|^192\.168\.|^192\.0\.[02]\.|^198\.(1[89]|51)\.|^203\.0\.113\.|^172\.(1[6-9]|2\d|3[01])\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^(22[4-9]|2[3-5]\d)\."
    local = r"^localhost$|\.localhost$|\.local$|\.localdomain$|\.internal$"
    octet = r"(25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)"
    numeric = host.rlike(r"^(0x[0-9a-f]*|\d+)(\.(0x[0-9a-f]*|\d+))*$")
    fine = host.rlike(rf"^{octet}(\.{octet}){{3}}$") & ~host.rlike(closed)
    global6 = host.rlike(r"^\[[23][0-9a-f]{3}:[0-9a-f:]+\]$") & ~host.rlike(r"^\[(2001:(0{0,3}:|0?db8:)|2002:)")
    named = ~numeric & ~host.rlike(local) & host.rlike(r"^[^\[\]:]+$")
    return F.coalesce(web & clear & (host != "") & F.when(host.startswith("["), global6).when(numeric, fine).otherwise(named), F.lit(False))


#: What stands inside a tag: quoted values, which may hold an angle bracket, and the rest.
_INSIDE = r"""(?:[^<>"']++|"[^"]*+(?:"|$)|'[^']*+(?:'|$)|<)*+"""
#: Names of characters as HTML 4 has them, and the signs that numbers from 128 to 159 stand for there.
_NAMES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}
_SIGNS = {code: bytes([code]).decode("cp1252", "replace") for code in range(128, 160)} | {160: " "}
#: Names that end without a semicolon, too.
_OPEN_NAMES = "amp|lt|gt|quot|nbsp"


def references(text: Column, closed: bool = False) -> Column:
    """The text with its character references read: by name, by decimal or hexadecimal number; what is none stays.

    With ``closed`` only those that end in a semicolon are references.
    """
    end = ";" if closed else ";?"
    # The first part stands before any ampersand.
    parts = F.split(text, "&", -1)
    names = F.from_json(F.lit(json.dumps(_NAMES)), "map<string,string>")
    signs = F.from_json(F.lit(json.dumps(_SIGNS)), "map<string,string>")

    def read(part: Column, n: Column) -> Column:
        number = F.regexp_extract(part, rf"^#(\d{{1,7}}|[xX][0-9a-fA-F]{{1,6}}){end}", 1)
        code = F.when(number.rlike("^[xX]"), F.conv(F.substring(number, F.lit(2), F.length(number)), 16, 10)).otherwise(number).try_cast("int")
        strange = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        sign = F.when(strange, F.lit("\ufffd")).otherwise(F.coalesce(F.try_element_at(signs, code.cast("string")), F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")))
        name = F.try_element_at(names, F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*);", 1))
        name = name if closed else F.coalesce(name, F.try_element_at(names, F.regexp_extract(part, rf"^({_OPEN_NAMES})(?![A-Za-z0-9=])", 1)))
        rest = lambda pattern: F.regexp_replace(part, pattern, "")
        found = F.when(number != "", F.concat(sign, rest(r"^#(?:\d{1,7}|[xX][0-9a-fA-F]{1,6});?"))).when(name.isNotNull(), F.concat(name, rest(r"^[A-Za-z][A-Za-z0-9]*;?")))
        return F.when(n == 0, part).otherwise(F.coalesce(found, F.concat(F.lit("&"), part)))

    return F.array_join(F.transform(parts, read), "")


def html_text(html: Column, closed: bool = False) -> Column:
    """The text of a page, blocks on lines of their own.

    Comments, scripts, styles and declarations go, to the end of the page where they are not
    closed. A tag is an angle bracket before a letter, or a slash and a letter, up to the next
    closing bracket outside of quotes; any other bracket is text. Then references are read,
    with ``closed`` only those that end in a semicolon.
    """
    text = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", " ")
    text = F.regexp_replace(text, rf"(?is)<(script|style|noscript|template)\b{_INSIDE}(?:>|$).*?(?:</\1\s*>|$)", " ")
    text = F.regexp_replace(text, r"(?s)<[!?][^>]*(?:>|$)", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|blockquote|pre)\b{_INSIDE}(?:>|$)", "\n")
    text = F.regexp_replace(text, rf"</?[A-Za-z]{_INSIDE}(?:>|$)", "")
    text = references(text, closed)
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\xa0]+", " "), r" ?\n[\s]*", "\n")
    return _strip(text)


def thinking_text(transcript: Column) -> Column:
    """What a transcript's thinking blocks say, joined by empty lines; empty for bad JSON."""
    blocks = F.from_json(transcript, "array<struct<type:string,thinking:string>>")
    return join_turns(F.coalesce(F.transform(F.filter(blocks, lambda b: b["type"] == "thinking"), lambda b: F.coalesce(b["thinking"], F.lit(""))), F.array().cast("array<string>")))


def search_summary(results: Column, most: int = 5) -> Column:
    """A line for each of the first results of a search that have an address: title and address."""
    rows = F.from_json(results, "array<struct<title:string,url:string>>")
    named = F.slice(F.filter(rows, lambda r: F.coalesce(r["url"] != "", F.lit(False))), 1, most)
    lines = F.transform(named, lambda r: F.concat(F.lit("- "), F.when(r["title"] != "", r["title"]).otherwise(r["url"]), F.lit(" ("), r["url"], F.lit(")")))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def sse_frames(text: Column) -> Column:
    """array<struct<event, data>>: the frames of an event stream; lines of data are joined, frames without data left out."""
    frames = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n\n+")

    def read(frame: Column) -> Column:
        lines = F.split(frame, "\n")
        said = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
        events = said("event")
        return F.struct(F.when(F.size(events) > 0, F.element_at(events, -1)).otherwise("message").alias("event"), F.array_join(said("data"), "\n").alias("data"))

    return F.filter(F.transform(frames, read), lambda f: f["data"] != "")


#: Metaphone, as published by Philips in 1990: for each letter, the contexts in order and their sounds.
#: A context is (pattern before, pattern after); the first that fits decides.
_VOWELS = "AEIOU"
_SOUNDS: dict[str, list[tuple[str, str, str]]] = {
    "B": [("M$", "^$", ""), ("", "", "B")],
    "C": [("S$", "^[EIY]", ""), ("", "^IA", "X"), ("S$", "^H", "K"), ("^$", "^HR", "K"), ("", "^H", "X"), ("", "^[EIY]", "S"), ("", "", "K")],
    "D": [("", "^G[EIY]", "J"), ("", "", "T")],
    "F": [("", "", "F")],
    "G": [("", "^H[^AEIOU]", ""), ("", "^H$", ""), ("", "^N$", ""), ("", "^NED$", ""), ("D$", "^[EIY]", ""), ("", "^[EIY]", "J"), ("", "", "K")],
    "H": [("[CSPTG]$", "", ""), ("[AEIOU]$", "^[^AEIOU]", ""), ("[AEIOU]$", "^$", ""), ("", "^[AEIOU]", "H"), ("", "", "")],
    "J": [("", "", "J")],
    "K": [("C$", "", ""), ("", "", "K")],
    "L": [("", "", "L")],
    "M": [("", "", "M")],
    "N": [("", "", "N")],
    "P": [("", "^H", "F"), ("", "", "P")],
    "Q": [("", "", "K")],
    "R": [("", "", "R")],
    "S": [("", "^H", "X"), ("", "^I[OA]", "X"), ("", "^CHW", "X"), ("", "", "S")],
    "T": [("", "^I[OA]", "X"), ("", "^TH", ""), ("", "^CH", ""), ("", "^H", "0"), ("", "", "T")],
    "V": [("", "", "F")],
    "W": [("", "^[AEIOU]", "W"), ("", "", "")],
    "X": [("^$", "", "S"), ("", "", "KS")],
    "Y": [("", "^[AEIOU]", "Y"), ("", "", "")],
    "Z": [("", "", "S")],
}


def metaphone(text: Column) -> Column:
    """The sounds of a text's words, joined by spaces; empty without letters.

    A fold over the letters of each word; a letter's sound follows from what stands before
    and behind it. Of silent first letters and of doubled ones but C nothing is heard, of
    vowels only those that come first.
    """

    def code(word: Column) -> Column:
        word = F.regexp_replace(F.regexp_replace(word, "^(?:[KGP](?=N)|W(?=R)|A(?=E))", ""), "^WH", "W")

        def sound(out: Column, i: Column) -> Column:
            letter, before, after = F.substring(word, i, F.lit(1)), F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))
            heard = F.when((i > 1) & (letter == F.substring(word, i - 1, F.lit(1))) & (letter != "C"), "").when(letter.isin(*_VOWELS), F.when(i == 1, letter).otherwise(F.lit("")))
            for name, contexts in _SOUNDS.items():
                own = F.lit("")
                for left, right, told in reversed(contexts):
                    own = F.when((before.rlike(left) if left else F.lit(True)) & (after.rlike(right) if right else F.lit(True)), told).otherwise(own) if left or right else F.lit(told)
                heard = heard.when(letter == name, own)
            return F.concat(out, heard)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word))), F.lit(""), sound)

    words = F.transform(F.regexp_extract_all(F.upper(text), F.lit("([A-Z]+)"), 1), code)
    return F.array_join(F.filter(words, lambda c: c != ""), " ")


def with_sounds(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """``df`` with the sounds of texts as columns of these names; each distinct row of words is folded once and joined back."""
    for name, text in texts.items():
        df = df.withColumn("_words", F.array_join(F.regexp_extract_all(F.upper(text), F.lit("([A-Z]+)"), 1), " "))
        codes = df.select("_words").distinct().select("_words", metaphone(F.col("_words")).alias(name))
        df = df.join(codes, "_words", "left").drop("_words")
    return df


def metaphone_sql(text: str) -> str:
    """The same in DuckDB SQL, from the same table of sounds."""
    letter, before, after = "w[i]", "w[1:i-1]", "w[i+1:]"
    whens = [f"WHEN i > 1 AND {letter} = w[i-1] AND {letter} <> 'C' THEN ''", f"WHEN {letter} IN ('A', 'E', 'I', 'O', 'U') THEN CASE WHEN i = 1 THEN {letter} ELSE '' END"]
    for name, contexts in _SOUNDS.items():
        for left, right, told in contexts:
            on = " AND ".join([f"{letter} = '{name}'", *([f"regexp_matches({before}, '{left}')"] if left else []), *([f"regexp_matches({after}, '{right}')"] if right else [])])
            whens.append(f"WHEN {on} THEN '{told}'")
    code = f"array_to_string(list_transform(range(1, length(w) + 1), lambda i: CASE {' '.join(whens)} END), '')"
    cut = "regexp_replace(CASE WHEN regexp_matches(v, '^(KN|GN|PN|WR|AE)') THEN v[2:] ELSE v END, '^WH', 'W')"
    return f"array_to_string(list_filter(list_transform(list_transform(regexp_extract_all(upper({text}), '[A-Z]+'), lambda v: {cut}), lambda w: {code}), lambda c: c <> ''), ' ')"
