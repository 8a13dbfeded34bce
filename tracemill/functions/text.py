"""Text functions of the import path: cells, numbers, timestamps, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CELL = 4096
_BLANK = r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$"
TRUE_WORDS = ("1", "true", "yes", "y", "manual", "human")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _BLANK, "")


def sanitize(c: Column) -> Column:
    """A cell that no spreadsheet runs as a formula: stripped, cut, prefixed."""
    cut = F.substring(strip(c), 1, MAX_CELL)
    return F.when(cut.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cut)).otherwise(cut)


def canonical(c: Column) -> Column:
    """Stripped text without protecting quotes; blank is null."""
    out = bare(c)
    return F.when(out != "", out)


def number(c: Column) -> Column:
    """A number with a comma or point; anything else is null."""
    plain = F.translate(F.regexp_replace(c, r"[' ]", ""), ",", ".")
    return F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))


#: Forms besides ISO, with single letters since input need not be padded.
_FORMS = (
    (r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d.M.yyyy H:m:s"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{1,2}$", "d.M.yyyy H:m"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$", "M/d/yyyy H:m"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
)
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?)?"
_ZONE = r"([+-]\d{2}:?\d{2}|Z)$"


def bare(c: Column) -> Column:
    """Text without blanks and protecting quotes at its ends."""
    return F.regexp_replace(strip(c), r"^'+|'+$", "")


def timestamp(c: Column) -> Column:
    """A timestamp without zone, in UTC; naive input is UTC, other text null."""
    return bare_timestamp(bare(c))


def bare_timestamp(s: Column) -> Column:
    """As `timestamp`, of text that is bare already; s is named often, so it is best a column."""
    offset = F.regexp_extract(s, r"([+-]\d{2}):?(\d{2})$", 1)
    minutes = F.regexp_extract(s, r"([+-]\d{2}):?(\d{2})$", 2)
    local = F.regexp_replace(s, _ZONE, "")
    zoned = s.rlike(_ISO + _ZONE) & s.contains(":")
    shift = F.when(zoned & (offset != ""), offset.try_cast("int") * 60 + F.when(offset.startswith("-"), -1).otherwise(1) * minutes.try_cast("int")).otherwise(0)
    iso = F.when(zoned, local).when(s.rlike(_ISO + "$"), s).try_cast("timestamp_ntz")
    out = F.timestamp_add("MINUTE", -shift, iso)
    for pattern, form in _FORMS:
        out = F.coalesce(out, F.when(s.rlike(pattern), F.try_to_timestamp(s, F.lit(form)).cast("timestamp_ntz")))
    return out


def truthy(c: Column, words: tuple[str, ...] = TRUE_WORDS) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*words), F.lit(False))


# The patterns that results must agree on, with Unicode classes.
EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.]+"
IBAN = r"(?U)\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"
PHONE = r"(?U)(?<!\d)(\+?\d[\d\s\-()]{7,}\d)(?!\d)"


def redact(c: Column) -> Column:
    """E-mail addresses, account numbers and telephone numbers as their kind."""
    out = F.regexp_replace(c, EMAIL, "[email]")
    out = F.regexp_replace(out, IBAN, "[iban]")
    return F.regexp_replace(out, PHONE, "[phone]")
