"""Bodies: markup leftovers, links, and the split between a reply and what it quotes."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import trimmed

# How quoted mails begin, in several languages, and the labels of their headers.
_QUOTE = r"(?iu)\n(?:>\s*)?"
_LINES = r"[^\n]+(?:\n(?:>\s*)?[^\n]*){0,8}"
ORIGINAL = r"\n-+\s*Original Message\s*-+\s*\n"
REPLY_STARTS = (
    rf"{_QUOTE}On {_LINES}\bwrote:\s*\n",
    rf"{_QUOTE}Op {_LINES}\bhet volgende geschreven:\s*\n",
    rf"{_QUOTE}Op {_LINES}\bschreef:\s*\n",
    rf"{_QUOTE}El {_LINES}\bescribió:\s*\n",
    rf"{_QUOTE}Le {_LINES}\ba [ée]crit\s*:\s*\n",
    rf"{_QUOTE}-+\s*Original Message\s*-+\s*\n",
    r"(?iu)\n_{8,}\s*\n(?=(?:From:|보낸 사람:)\s)",
    r"(?i)\nFrom:\s+.+\n(?:Sent|Date):\s+.+\nTo:\s+.+\nSubject:\s+.+\n",
    r"(?i)\nVan:\s+.+\nVerzonden:\s+.+\nAan:\s+.+\nOnderwerp:\s+.+\n",
)
LABELS = {
    "start": ("from:", "van:", "보낸 사람:", "de:"),
    "sent": ("sent:", "date:", "verzonden:", "보냄:", "envoyé:", "envoye:"),
    "to": ("to:", "aan:", "받는 사람:", "à:", "a:"),
    "subject": ("subject:", "onderwerp:", "제목:", "objet:"),
}
SPAN = 20  # lines that a header block or a quoted block may take


def _label(line: str) -> set[str]:
    text = re.sub(r"\s*:\s*", ":", line.lstrip(" \t>\r\n"), count=1).casefold()
    return {k for k, labels in LABELS.items() if text.startswith(labels)}


def _header_block(lines: list[str]) -> int | None:
    """The first line that starts a header with sent, to and subject labels in the lines after it."""
    labels = [_label(x) for x in lines]
    for i, found in enumerate(labels):
        if "start" in found and {"sent", "to", "subject"} <= set().union(*labels[i + 1 : i + SPAN]):
            return i
    return None


def _dated_quote(lines: list[str]) -> int | None:
    """The first dated attribution that three quoted lines follow, with at most four lines of address between."""
    for i, line in enumerate(lines):
        if not re.match(r"^\s*\d{4}[/-]\d{1,2}[/-]\d{1,2}\s+\S", line):
            continue
        quoted = between = 0
        for x in filter(None, (y.strip() for y in lines[i + 1 : i + SPAN])):
            if x.startswith(">"):
                quoted += 1
            elif quoted or not (re.search(r"@|email|mailto:", x, re.IGNORECASE) or x[-1] in "<>"):
                break
            else:
                between += 1
            if between > 4:
                break
            if quoted == 3:
                return i
    return None


@F.pandas_udf(T.IntegerType())
def block_start(bodies: pd.Series) -> pd.Series:
    """Characters before the first quoted header block or dated quote; null for none. (Scans with state: no expression.)"""

    def one(body: str | None) -> int | None:
        lines = (body or "").splitlines(keepends=True)
        found = [i for i in (_header_block(lines), _dated_quote(lines)) if i]
        return len("".join(lines[: min(found)])) if found else None

    return bodies.map(one).astype("Int32")


def reply_split(body: Column, source: Column, header_sources: tuple[str, ...] = ("legacy",), scan: bool = True) -> Column:
    """struct(main, quoted): the body up to the first sign of a quoted mail, and the rest (null if there is none or one
    part would be empty). Sources in `header_sources` are split at original-message lines only. Null bodies are empty."""
    text = trimmed(F.coalesce(body, F.lit("")))

    def start(pattern: str) -> Column:
        """Characters before the first match; null for none (regexp_instr counts UTF-16 units, so the text itself is cut)."""
        return F.nullif(F.length(F.regexp_extract(text, f"^((?s:.*?)){pattern}", 1)), F.lit(0))

    some = start("(?i)" + ORIGINAL)
    every = [start(p) for p in REPLY_STARTS] + ([F.nullif(block_start(text), F.lit(0))] if scan else [])
    cut = F.when(source.isin(*header_sources), some).otherwise(F.least(*every))
    main = F.regexp_replace(F.substr(text, F.lit(1), cut), r"(?U)\s+$", "")
    quoted = F.regexp_replace(F.substr(text, cut + 1), r"(?U)^\s+", "")
    whole = F.struct(text.alias("main"), F.lit(None).cast("string").alias("quoted"))
    return F.when(cut.isNull() | (main == "") | (quoted == ""), whole).otherwise(F.struct(main.alias("main"), quoted.alias("quoted")))


@F.pandas_udf(T.StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Character references decoded (the full table is Python's)."""
    return texts.map(html.unescape, na_action="ignore")


def plain_markup(text: Column) -> Column:
    """Line ends of one kind, <br> and <p> as line breaks, no replacement characters."""
    x = F.regexp_replace(F.replace(text, F.lit("�"), F.lit("")), "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?>", "\n"), r"(?i)</?p\s*/?>", "\n\n")


def single_urls(text: Column) -> Column:
    """URLs without angle brackets and text stuck to them, one blank line at most."""
    x = F.regexp_replace(text, r"[^\s<]*<(https?://[^>]+)>", "$1")
    x = F.regexp_replace(F.regexp_replace(x, r"<(https?://[^>]+)>", "$1"), r"(?<=\S)(https?://)", " $1")
    return trimmed(F.regexp_replace(x, "\n{3,}", "\n\n"))


def escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def linked(text: Column) -> Column:
    """URLs of escaped text as anchors."""
    url = r"""(?:[^\s<>)\]"'&]|&amp;)+"""
    x = F.regexp_replace(text, rf"(https?://{url})", '<a href="$1">$1</a>')
    return F.regexp_replace(x, rf"(?<!/)(www\.{url})", '<a href="http://$1">$1</a>')


def clean_body(text: Column) -> Column:
    """A body as safe HTML with links."""
    return linked(escaped(single_urls(unescaped(plain_markup(text)))))
