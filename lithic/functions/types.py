"""Cell predicates: blanks, conformance to semantic types, and known text patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = r"^\s*[+-]?\d+(_\d+)*\s*$"
FLOAT = r"^\s*[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$"
NOT_FINITE = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"
# The forms in which texts are dates, in order.
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s")
# Shares of non-null cells that make a type, and a pattern.
TYPE_SHARE, PATTERN_SHARE = 0.99, 0.95

# The named patterns in order of precedence.
PATTERNS = (
    ("email", r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"),
    ("uuid", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    ("url", r"^https?://[^\s]+$"),
    ("e164_phone", r"^\+[1-9]\d{1,14}$"),
    ("ipv4", r"^(25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)){3}$"),
    ("ipv6", r"^([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$"),
    ("iso_date", r"^\d{4}-\d{2}-\d{2}$"),
    ("us_zip", r"^\d{5}(-\d{4})?$"),
    ("ca_postal", r"(?i)^[ABCEGHJ-NPRSTVXY]\d[A-Z][ -]?\d[A-Z]\d$"),
    ("currency_usd", r"^-?\$?\d{1,3}(,\d{3})*(\.\d{1,2})?$|^-?\$?\d+(\.\d{1,2})?$"),
)


def cell(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_blank(text: Column) -> Column:
    """Null, empty or whitespace only."""
    return text.isNull() | (F.trim(F.regexp_replace(text, r"\s", " ")) == "")


def is_integer(text: Column) -> Column:
    return text.rlike(INTEGER)


def is_float(text: Column) -> Column:
    return text.rlike(FLOAT) | text.rlike(NOT_FINITE)


def to_number(text: Column) -> Column:
    """The finite number that a text spells, else null."""
    value = F.when(text.rlike(FLOAT), F.regexp_replace(F.trim(text), "_", "").try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def to_timestamp(text: Column) -> Column:
    """The first of the date formats that reads a text, day before month; else null."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in DATE_FORMATS])


def is_date(text: Column) -> Column:
    # each form begins with three numbers; to try them all on a text that is none takes long
    return F.when(text.rlike(r"^\s*\d+[-/]\d+[-/]\d"), to_timestamp(text).isNotNull()).otherwise(False)


def iso(moment: Column) -> Column:
    """Date text at midnight, else date and time."""
    return F.when(moment == F.date_trunc("DAY", moment), F.date_format(moment, "yyyy-MM-dd")).otherwise(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"))
