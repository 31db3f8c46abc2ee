"""Scalar functions on text and timestamps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"
DATA_URI = r"(?i)data:[^\s)]*;base64,"
#: Fixed value: a link to a place in the same document, its text and its target.
LINK = r"\[([^\]\n]+)\]\(#([^\s)]+)\)"


def zoned_timestamp(raw: Column) -> Column:
    """A timestamp from epoch seconds or an ISO text with a zone; null for anything else, a text without a zone included."""
    return F.when(raw.rlike(NUMBER), F.timestamp_seconds(raw.try_cast("double"))).when(raw.rlike(ZONED), F.try_to_timestamp(raw))


def timestamp_state(raw: Column) -> Column:
    """missing, valid or invalid."""
    return F.when(raw.isNull(), "missing").when(zoned_timestamp(raw).isNotNull(), "valid").otherwise("invalid")


def span(text: Column, start: Column, end: Column) -> Column:
    """Code points start to end (half-open, from 0)."""
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text without overlaps; 0 for an empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def replace_once(text: Column, before: Column, after: Column) -> Column:
    """The text with its one occurrence of ``before`` replaced; null if it doesn't occur exactly once."""
    return F.when(occurrences(text, before) == 1, F.replace(text, before, after))


def fence(text: Column) -> Column:
    """A fence of backticks that no run in the text reaches; three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def fence_of(text: str) -> str:
    """The fence of one Python text, see fence()."""
    return "`" * max([3, *(len(run) + 1 for run in re.findall("`+", text))])


def slug(heading: Column) -> Column:
    """A heading's link target: tags and link targets dropped, letters, digits, - and _ kept, spaces to -."""
    plain = F.regexp_replace(F.regexp_replace(heading, "<[^>]+>", ""), r"\[([^\]]*)\]\([^)]*\)", "$1")
    kept = F.regexp_replace(F.lower(F.trim(plain)), r"[^\p{L}\p{N} _-]", "")
    return F.replace(kept, F.lit(" "), F.lit("-"))


def link_targets(text: Column) -> Column:
    """The targets of the text's Markdown links to places in the same document, percent-decoded."""
    raw = F.regexp_extract_all(text, F.lit(LINK), F.lit(2))
    return F.transform(raw, lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x))


def long_words(text: Column) -> Column:
    """The distinct words of three letters or more, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{3,})"), F.lit(1)))


def labelled_line(text: Column, name: str) -> Column:
    """What stands after ``**Name:**`` at a line's start; empty if no line has it."""
    return F.trim(F.regexp_extract(text, rf"(?m)^\*\*{name}:\*\*[ \t]*(.*)$", 1))
