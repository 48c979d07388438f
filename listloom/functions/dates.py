"""Dates of mail headers and pages, in UTC; what no format fits is null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once, trimmed

# Month names and the formats, in the order in which they are tried. `yy` formats see two-digit years with
# their century; `24h AM` formats ignore the AM or PM that must follow.
SWEDISH_MONTHS = {
    "januari": "January",
    "februari": "February",
    "mars": "March",
    "maj": "May",
    "juni": "June",
    "juli": "July",
    "augusti": "August",
    "oktober": "October",
}
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DAYS = "Mon|Tue|Wed|Thu|Fri|Sat|Sun|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
FORMATS = (
    ("yyyy-M-d'T'H:m:s", ""),
    ("yyyy-M-d H:m:s", ""),
    ("yyyy-M-d", ""),
    ("d MMM yyyy H:m:s Z", ""),
    ("d MMM yyyy H:m:s", ""),
    ("d MMM yyyy H:m", "24h AM"),
    ("d MMM yyyy H:m", ""),
    ("d MMM yyyy", ""),
    ("M/d/yyyy h:m a", ""),
    ("M/d/yyyy h:m:s a", ""),
    ("M/d/yyyy H:m", ""),
    ("M/d/yyyy H:m:s", ""),
    ("M/d/yyyy", ""),
    ("M/d/yyyy H:m:s", "yy"),
    ("M/d/yyyy H:m", "yy"),
    ("M/d/yyyy h:m a", "yy"),
    ("MMMM d, yyyy h:m a", ""),
    ("MMMM d, yyyy H:m", ""),
    ("MMMM d yyyy H:m", ""),
    ("MMMM d, yyyy H:m:s", "24h AM"),
    ("MMMM d yyyy", ""),
    ("MMM d, yyyy h:m a", ""),
    ("d-MMM-yyyy H:m:s", ""),
    ("d-MMM-yyyy H:m", ""),
    ("d MMMM yyyy H:m", ""),
    ("d MMMM yyyy h:m a", ""),
    ("d MMMM yyyy", ""),
    ("d MMMM yyyy", "yy"),
    ("MMM d H:m:s yyyy", ""),
    ("d MMM yyyy H:m:s", "yy"),
    ("d MMM yyyy", "yy"),
    ("M/d/yyyy", "yy"),
    ("MMMM d, yyyy", ""),
    ("MMM d, yyyy H:m", "24h AM"),
    ("MMM d, yyyy H:m", ""),
    ("MMM d, yyyy", ""),
    ("h:m a M/d/yyyy", "yy"),
)


def header_date(x: Column) -> Column:
    """A date as `Thu, 19 Mar 2026 10:20:38 -0700`."""
    return F.try_to_timestamp(F.regexp_replace(trimmed(x), r"(?U)^\w+,\s*", ""), F.lit("d MMM yyyy H:m:s Z"))


def scrubbed(x: Column) -> Column:
    """A date string without what people and programs put around dates. (Fixed values: the patterns and their order.)"""
    x = trimmed(F.regexp_replace(trimmed(x), r"^(Date:\s*)+", ""))
    x = F.regexp_replace(F.regexp_replace(x, r"\s*\([A-Za-z\s]+\)\s*$", ""), "  +", " ")
    x = F.regexp_replace(x, r"(\d)(am|pm|AM|PM)", "$1 $2")
    x = F.regexp_replace(F.regexp_replace(x, r"\bam\b", "AM"), r"\bpm\b", "PM")
    x = F.regexp_replace(x, r"\s+[+-]\d{3}\s*$", "")  # a cut-off offset
    x = F.regexp_replace(x, r"\s+(?!AM$|PM$)[A-Z]{2,5}[\dA-Z]*(?:[+-]\d{1,2})?\s*$", "")  # a zone's name
    x = F.regexp_replace(x, rf"(?i)^(?:{DAYS})\.?,?\s+", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(\d)\.\s+", "$1 "), r"(?i)^den\s+", "")
    for name, english in SWEDISH_MONTHS.items():
        x = F.regexp_replace(x, rf"(?i)\b{name}\b", english)
    x = F.regexp_replace(x, r",\s*Time:", " ")
    x = F.regexp_replace(x, r"(\d{2}:\d{2}:\d{2}(?:\s+[+-]\d{4})?)\s*[A-Za-z].*$", "$1")
    x = F.regexp_replace(x, r":\s*$", "")
    x = F.regexp_replace(x, rf"(?i)({MONTHS})[A-Za-z:&\[\]\s\(\)]+?(\d{{1,2}}[,\s])", "$1 $2")
    x = F.regexp_replace(x, r"(\b(?:1[3-9]|2[0-3]):\d{2})\s+[AP]M", "$1")
    return F.regexp_replace(x, r"(\d{4})\s+\1", "$1")


def with_century(x: Column) -> Column:
    """Two-digit years from 69 on are of the 1900s; null where there is none."""
    found = rf"(?i)^(.*?(?:\d{{1,2}}/\d{{1,2}}/|\d{{1,2}} (?:{MONTHS}|[a-z]{{3}}) ))(\d{{2}})(?!\d)(.*)$"
    year = F.regexp_extract(x, found, 2)
    century = F.when(year.cast("int") >= 69, F.lit("19")).otherwise("20")
    return F.when(year != "", F.concat(F.regexp_extract(x, found, 1), century, year, F.regexp_extract(x, found, 3)))


def _shape(x: Column) -> Column:
    """The string with each run of letters as A and each number, with its sign, as 9."""
    return F.regexp_replace(F.regexp_replace(x, "[A-Za-z]+", "A"), "[+-]?[0-9]+", "9")


def _shape_of(pattern: str) -> str:
    """The shape of every string that a format fits."""
    letters = re.sub("'[^']*'", "A", pattern)
    signs = re.sub(r"([A-Za-z])\1*", lambda run: "A" if run[0] in ("A", "a") or run[0].startswith("MMM") else "9", letters)
    return re.sub("[+-]9", "9", signs)


def _first_fit(candidate: Column) -> Column:
    """Formats are tried only on strings of their shape: a try that fails is an exception inside."""
    ignored = r"\s[AaPp][Mm]$"
    forms = F.array(candidate, with_century(candidate), F.when(candidate.rlike(ignored), F.regexp_replace(candidate, ignored, "")))
    place = {"": 0, "yy": 1, "24h AM": 2}

    def tried(pattern: str, form: Column) -> Column:
        return F.when(form["shape"] == _shape_of(pattern), F.try_to_timestamp(form["text"], F.lit(pattern)))

    shaped = F.transform(forms, lambda x: F.struct(x.alias("text"), _shape(x).alias("shape")))
    return once(shaped, lambda x: F.coalesce(*(tried(pattern, F.get(x, F.lit(place[kind]))) for pattern, kind in FORMATS)))


def flexible_date(x: Column) -> Column:
    """The first format that fits the scrubbed string, or else the string without a trailing offset. Strings without a
    digit aren't tried."""
    offset = r"\s+[+-]\d{4}\s*$"

    def fit(whole: Column) -> Column:
        return F.when(whole.rlike(r"\d"), F.coalesce(_first_fit(whole), F.when(whole.rlike(offset), once(F.regexp_replace(whole, offset, ""), _first_fit))))

    return once(scrubbed(x), fit)


def whole_days(later: Column, earlier: Column) -> Column:
    """Full days between two timestamps, rounded down."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000))


def short_date(x: Column) -> Column:
    return F.coalesce(F.date_format(x, "MMM dd, yyyy"), F.lit("?"))


def long_date(x: Column) -> Column:
    return F.coalesce(F.date_format(x, "MMMM dd, yyyy"), F.lit("Unknown date"))


def sort_date(x: Column) -> Column:
    return F.coalesce(F.date_format(x, "yyyy-MM-dd"), F.lit(""))
