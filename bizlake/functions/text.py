"""Text cleaning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import NULL_TOKENS

# fixed values: characters and the mark the registry text fields must not hold
SCRUB_CHARACTERS = "\n\t\r\"'|#-*"
SCRUB_MARK = "_x000D_"

# fixed value: the white-space characters
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends.

    Text that begins and ends with a visible ASCII character is taken as it is:
    it needs no search for the 29 characters at both ends.
    """
    last = F.substr(text, F.lit(-1))
    bare = (text >= "!") & (text < "\x7f") & (last >= "!") & (last < "\x7f")
    return F.when(bare, text).otherwise(F.btrim(text, F.lit(WHITE)))


def trim_or_empty(text: Column) -> Column:
    """Stripped text, with null turned into the empty string."""
    return strip(F.coalesce(text, F.lit("")))


def scrub(text: Column) -> Column:
    """Blank out separators, quotes and line marks, then strip; inner runs stay."""
    unmarked = F.replace(text, F.lit(SCRUB_MARK), F.lit(" "))
    return strip(F.translate(unmarked, SCRUB_CHARACTERS, " " * len(SCRUB_CHARACTERS)))


def null_when_token(text: Column, tokens: list[str] = NULL_TOKENS) -> Column:
    """Null for blank text and for the words that stand for a missing value."""
    return F.when(~text.isin(tokens), text)


def label_or(text: Column, default: Column | str) -> Column:
    """``text``, or ``default`` where it is null or blank."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(text, F.lit("")), fallback)


def contains_ignoring_case(text: Column, wanted: str) -> Column:
    """Literal, case-insensitive substring test; null text does not match."""
    return F.coalesce(F.contains(F.lower(text), F.lower(F.lit(wanted))), F.lit(False))


def programme_label(programme: Column) -> Column:
    """Spell out the short programme name."""
    return F.replace(programme, F.lit("HORIZON"), F.lit("HORIZON EUROPE"))


def topic_level_1(path: Column) -> Column:
    """First level of a ``/a/b/c`` path."""
    return F.try_element_at(F.split(path, "/"), F.lit(2))


def topic_level_2(path: Column, blank_falls_back: bool) -> Column:
    """Second level of a path, or the first one where there is no second.

    ``blank_falls_back`` also treats an empty second level (``/a/``) as absent.
    """
    second = F.try_element_at(F.split(path, "/"), F.lit(3))
    if blank_falls_back:
        second = F.nullif(second, F.lit(""))
    return F.coalesce(second, topic_level_1(path))
