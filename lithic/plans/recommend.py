"""Recommendations for linkage from column profiles alone: pairs of columns, measures, parsers, rules."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.functions.normalize import RULES
from lithic.operators.linkage import TEXT_MEASURES, Config, Mapping

NAME_SHARE, LONG_TEXT, THRESHOLD = 0.3, 60, 0.85

# Words of column names that hint at their contents.
EMAIL = {"email", "mail"}
PHONE = {"phone", "mobile", "tel", "fax"}
KEY = {"id", "code", "sku", "ref", "number"}
NAME = {"name", "company", "customer", "client", "vendor", "supplier", "account"}
PLACE = {"address", "street", "addr", "city", "state", "zip", "postal"}
PROSE = {"description", "notes", "remarks", "comment", "summary", "details"}

#: What equal patterns ask for, and what hints ask for in order of precedence: (measure, parser).
BY_PATTERN = {"email": ("exact", "email"), "e164_phone": ("exact", "phone"), "iso_date": ("date_proximity", "date"), "uuid": ("exact", None)}
BY_HINT = ((EMAIL, ("exact", "email")), (PHONE, ("exact", "phone")), (KEY, ("exact", None)), (NAME, ("jaro_winkler", None)), (PLACE, ("jaccard_tokens", None)), (PROSE, ("cosine_tokens", None)))
FAMILY = {"integer": "number", "float": "number", "string": "text", "mixed": "text"}


@dataclass(frozen=True)
class Facts:
    name: str
    semantic_type: str
    pattern_label: str | None = None
    avg_length: float = 0.0
    distinct_pct: float = 100.0

    @property
    def words(self) -> set[str]:
        return set(re.findall(r"[a-z0-9]+", self.name.lower()))

    @property
    def family(self) -> str:
        return FAMILY.get(self.semantic_type, self.semantic_type)


def facts(profiles: DataFrame, tops: DataFrame) -> list[Facts]:
    """Facts of each column, one driver row per column; a share of distinct values of 0 counts as 100."""
    lengths = tops.groupBy("column").agg(F.avg(F.length("value")).alias("avg_length"))
    rows = profiles.join(lengths, "column", "left").orderBy("ordinal").select("column", "semantic_type", "pattern_label", "avg_length", "distinct_pct").collect()
    return [Facts(r.column, r.semantic_type, r.pattern_label, r.avg_length or 0.0, r.distinct_pct or 100.0) for r in rows]


def measure(a: Facts, b: Facts) -> tuple[str, str | None]:
    """(measure, parser) for a pair of columns: pattern, then type, then name, then length decides."""
    if a.pattern_label == b.pattern_label and a.pattern_label in BY_PATTERN:
        return BY_PATTERN[a.pattern_label]
    if a.family == b.family == "date":
        return "date_proximity", "date"
    if a.family == b.family == "number":
        return "numeric_tolerance", None
    if a.family != b.family:
        return "exact", None
    words = a.words | b.words
    for hints, choice in BY_HINT:
        if words & hints:
            return choice
    return ("jaccard_tokens" if max(a.avg_length, b.avg_length) >= LONG_TEXT else "levenshtein"), None


def rules(columns: list[Facts]) -> dict[str, bool]:
    """Four rules always; address words and company endings where names of columns hint at them."""
    on = {"case_fold", "collapse_whitespace", "nfkd_fold", "strip_special_chars"}
    words = set().union(*(c.words for c in columns)) if columns else set()
    if words & PLACE:
        on.add("expand_address_abbrev")
    if words & NAME:
        on |= {"strip_corporate_suffix", "strip_punctuation"}
    return {r: r in on for r in RULES}


def name_share(a: Facts, b: Facts) -> float:
    return len(a.words & b.words) / len(a.words | b.words) if a.words and b.words else 0.0


def mappings(left: list[Facts], right: list[Facts], least: float = NAME_SHARE) -> list[Mapping]:
    """Each column at most once, the most alike names first; no mapping is important until a person says so."""
    pairs = sorted(((-name_share(a, b), i, j) for i, a in enumerate(left) for j, b in enumerate(right) if a.family == b.family and name_share(a, b) >= least))
    out, seen_left, seen_right = [], set(), set()
    for _, i, j in pairs:
        if i not in seen_left and j not in seen_right:
            seen_left.add(i)
            seen_right.add(j)
            chosen, parser = measure(left[i], right[j])
            out.append(Mapping(left[i].name, right[j].name, chosen, 1.0, False, parser))
    return out


def config(left: list[Facts], right: list[Facts], threshold: float = THRESHOLD) -> Config:
    return Config(mappings(left, right), threshold, rules(left + right))


def blocking_mapping(found: list[Mapping]) -> Mapping | None:
    """The heaviest important mapping with a text measure, the first of equals."""
    texts = [m for m in found if m.important and m.measure in TEXT_MEASURES]
    return max(texts, key=lambda m: m.weight, default=None)


def refine(found: list[Mapping], suggest: Callable[[list[Mapping]], dict[tuple[str, str], tuple[str, str | None]]]) -> list[Mapping]:
    """Mappings with the measures and parsers that ``suggest`` names by pair; weight and importance stay."""
    new = suggest(found)
    return [replace(m, measure=new[m.left, m.right][0], parser=new[m.left, m.right][1]) if (m.left, m.right) in new else m for m in found]
