"""Column functions for subjects, bodies and sender names. All but the decoding of rare charsets are built-in expressions.

Regular expressions use (?U) where white space and word characters must be Unicode. A null subject or body stays null
unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = "[list]"
TAGS = ("list", "external", "external email")
NO_SUBJECT = "(no subject)"
BLANK = ("", "no subject", NO_SUBJECT)

# Reply prefixes as they are written, spelling variants, disclaimers.
MERGE_PREFIXES = ("Re:", "RE:", "Fwd:", "FW:", "Fw:")
GROUP_PREFIXES = ("Re:", "RE:", "Fwd:", "FW:", "Fw:", "re:")
SPELLINGS = {
    "modelling": "modeling",
    "behaviour": "behavior",
    "minimisation": "minimization",
    "optimisation": "optimization",
    "parametrisation": "parametrization",
    "characterisation": "characterization",
}
DISCLAIMERS = (
    r"(?s)ICON plc made the following annotations\..*$",
    r"(?s)This e-?mail (transmission )?may contain confidential.*$",
    r"(?s)NOTICE: The information contained in this electronic.*$",
    r"(?s)De inhoud van dit bericht is vertrouwelijk.*$",
    r"(?s)Merck Serono does not accept liability.*$",
    r"-{10,}\s*$",
)


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x evaluated once however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def trimmed(x: Column) -> Column:
    """Without white space of any kind at either end (trim() takes spaces only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapsed(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trimmed(F.regexp_replace(x, r"(?U)\s+", " "))


def quoted(literal: str) -> str:
    """A literal for use in a regular expression that Java and RE2 read alike."""
    return "".join(c if c.isalnum() or c in " :" else "\\" + c for c in literal)


def without_prefixes(x: Column, prefixes: tuple[str, ...], tags: tuple[str, ...] = ()) -> Column:
    """Leading prefixes (case as written) and bracketed tags (any case) go, in any order and number."""
    tag = "|".join(quoted(t).replace(" ", r"\s+") for t in sorted(tags, key=len, reverse=True))
    any_of = "|".join([*([rf"(?i:\[(?:{tag})\])"] if tags else []), *prefixes])
    return trimmed(F.regexp_replace(trimmed(x), rf"(?U)^(?:(?:{any_of})\s*)+", ""))


def or_no_subject(x: Column) -> Column:
    return F.when(F.lower(x).isin(*BLANK), F.lit(NO_SUBJECT)).otherwise(x)


def cleaned_name(x: Column) -> Column:
    """Terminal escape sequences go, white space collapses."""
    return collapsed(F.regexp_replace(x, r"\x1b(?:\[[0-9;]*[A-Za-z]|\([A-Za-z])", ""))


def merge_key(subject: Column, tag: str = TAG) -> Column:
    """The subject key of duplicate resolution: the tag goes anywhere, prefixes go at the start, lower case."""
    x = trimmed(F.replace(trimmed(subject), F.lit(tag), F.lit("")))
    return or_no_subject(trimmed(F.lower(without_prefixes(x, MERGE_PREFIXES))))


def group_key(subject: Column, tags: tuple[str, ...] = TAGS) -> Column:
    """The subject key of thread grouping: leading tags and prefixes go, lower case, one spelling. Null counts as blank."""
    x = F.lower(without_prefixes(F.coalesce(subject, F.lit("")), GROUP_PREFIXES, tags))
    for variant, spelling in SPELLINGS.items():
        x = F.replace(x, F.lit(variant), F.lit(spelling))
    return or_no_subject(x)


def without_tags(subject: Column, tags: tuple[str, ...] = TAGS) -> Column:
    return without_prefixes(F.coalesce(subject, F.lit("")), (), tags)


def display_subject(subject: Column, tag: str = TAG) -> Column:
    """The subject without the tag, reply prefixes kept; blanks read (no subject)."""
    return or_no_subject(trimmed(F.replace(trimmed(F.coalesce(subject, F.lit(""))), F.lit(tag), F.lit(""))))


def display_thread_subject(subject: Column, tags: tuple[str, ...] = TAGS) -> Column:
    """The subject without tags and prefixes, case kept."""
    return or_no_subject(without_prefixes(F.coalesce(subject, F.lit("")), GROUP_PREFIXES, tags))


def is_reply(subject: Column, tags: tuple[str, ...] = TAGS) -> Column:
    return without_tags(subject, tags).rlike(r"(?i)^(?:re|fw|fwd|aw)\s*:")


def body_signature(body: Column, size: int = 160) -> Column:
    """The beginning of a body without soft line ends, white space runs and case."""
    x = F.regexp_replace(F.replace(body, F.lit("\xa0"), F.lit(" ")), r"(?U)=\s+", "")
    return F.substring(F.lower(collapsed(x)), 1, size)


def blank_subject_signature(subject_key: Column, body: Column) -> Column:
    """The body signature where the subject says nothing; else empty."""
    return F.when(subject_key == NO_SUBJECT, body_signature(F.coalesce(body, F.lit("")))).otherwise("")


def without_disclaimers(body: Column, patterns: tuple[str, ...] = DISCLAIMERS) -> Column:
    for p in patterns:
        body = F.regexp_replace(body, p, "")
    return trimmed(body)


def email_hash(email: Column) -> Column:
    """SHA-256 of the lower-cased address; null for none."""
    return F.when(F.coalesce(email, F.lit("")) != "", F.sha2(trimmed(F.lower(email)), 256))


def name_from_address(name: Column) -> Column:
    """Readable names: none reads Unknown, so do placeholders; an address gives the parts of its local part, capitalized."""
    parts = F.filter(F.split(F.element_at(F.split(name, "@"), 1), "[._-]"), lambda p: p != "")
    words = F.array_join(F.transform(parts, capitalized), " ")
    return (
        F.when(F.coalesce(name, F.lit("")) == "", F.when(name.isNotNull(), F.lit("Unknown")))
        .when(name.contains("email\xa0protected") | name.contains("[email"), F.lit("Unknown"))
        .when(name.contains("@") & ~name.contains(" "), words)
        .otherwise(name)
    )


def capitalized(x: Column) -> Column:
    """First character in upper case, the others in lower case."""
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))


def normalized_newlines(text: Column) -> Column:
    """One kind of line end, no spaces before it, at most one blank line, nothing at the ends."""
    x = F.replace(F.regexp_replace(text, "\r\n?", "\n"), F.lit("\xa0"), F.lit(" "))
    return trimmed(F.regexp_replace(F.regexp_replace(x, "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))


# Letters by their usual Latin spelling, those with a mark of their own first.
SPELLED = {
    "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ı": "i", "ŧ": "t",
    "ё": "io", "ї": "yi", "є": "ie", "і": "i", "ґ": "g", "ђ": "d", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "џ": "dz",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p",
    "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
MARKED = ((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000))  # code points of letters that Unicode composes with marks


def _bare_letters() -> dict[str, str]:
    """Lower-case letters with marks, and the letter without them."""
    found = ((chr(c), unicodedata.normalize("NFD", chr(c))[0]) for low, high in MARKED for c in range(low, high) if chr(c) not in SPELLED)
    return {c: bare for c, bare in found if bare != c and c == c.lower()}


def transliterated(text: Column) -> Column:
    """Lower-case text with Latin, Greek and Cyrillic letters spelled in ASCII: marks go, then each letter has its spelling.
    Text that is ASCII already is left alone."""
    bare = _bare_letters()
    one, more = {k: v for k, v in SPELLED.items() if len(v) == 1}, {k: v for k, v in SPELLED.items() if len(v) != 1}
    x = text
    for letter, spelled in more.items():
        x = F.replace(x, F.lit(letter), F.lit(spelled))
    for table in (bare, one):
        x = F.translate(x, "".join(table), "".join(table.values()))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(x, r"\p{M}+", "")).otherwise(text)


def slug(text: Column, size: int | None = None) -> Column:
    """Lower-case ASCII words joined by hyphens; letters are transliterated, separators in numbers go."""
    x = F.regexp_replace(F.regexp_replace(transliterated(F.lower(text)), r"(?<=\d),(?=\d)", ""), "[^a-z0-9]+", "-")
    x = F.regexp_replace(x, "^-+|-+$", "")
    return x if size is None else F.substring(x, 1, size)


def truncated(text: Column, size: int = 200) -> Column:
    """At most `size` characters, then three dots."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


@F.pandas_udf(T.StringType())
def in_charset(contents: pd.Series, charsets: pd.Series, errors: pd.Series) -> pd.Series:
    """Bytes in a charset that has to be looked up by name; null if it isn't known or (with errors "strict") doesn't fit."""

    def one(content: bytes | None, charset: str | None, kind: str) -> str | None:
        try:
            return bytes(content).decode(charset, kind)
        except (LookupError, TypeError, ValueError):
            return None

    return pd.Series([one(*x) for x in zip(contents, charsets, errors, strict=True)], dtype=object)
