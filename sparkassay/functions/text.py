"""Text columns: strip, tokens, sentences, lines. All JVM-side expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a default string strip removes, spelled so that Java and RE2 agree.
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
STRIP_PATTERN = f"^{SPACE_CLASS}+|{SPACE_CLASS}+$"
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, STRIP_PATTERN, "")


def is_blank(c: Column | str) -> Column:
    return strip(c) == ""


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order, with repeats."""
    return F.filter(F.split(F.lower(c), TOKEN_SPLIT), lambda t: t != "")


def sentences(c: Column | str) -> Column:
    """Pieces that end in ``.``, ``!`` or ``?`` followed by whitespace."""
    parts = F.split(strip(c), rf"(?<=[.!?]){SPACE_CLASS}+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


# Fixed value: line boundaries of a universal-newline split.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def lines(c: Column | str) -> Column:
    return F.split(c, LINE_BREAK)


def literal_head(pattern: str) -> str:
    """The fixed text a pattern starts with (after a word boundary), in lower case; empty if there is none."""
    body = pattern.removeprefix(r"\b")
    if body.startswith("\\") and not body[1].isalnum():
        return body[1]
    head = re.match(r"[\w `;-]*", body).group()
    return (head[:-1] if body[len(head):len(head) + 1] in ("?", "*", "{") else head).lower()


def matches(text: Column, folded: Column, pattern: str, flags: str = "") -> Column:
    """``text`` matches ``pattern``; a plain substring test on the folded text skips most regular expressions."""
    head = literal_head(pattern)
    hit = text.rlike(flags + pattern)
    return folded.contains(head) & hit if head else hit


def folded(text: Column) -> Column:
    """Lower case, with the three letters that only case-insensitive matching equates to s and i."""
    return F.translate(F.lower(text), "\u017f\u0131\u0130", "sii")
