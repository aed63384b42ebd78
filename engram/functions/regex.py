"""Adapts the shared patterns to the JVM regex dialect.

Two things differ between dialects and change results: ``\\b`` is Unicode-aware in
Java (the shared patterns mean the ASCII boundary) and ``$`` also matches before a
final line break (the shared patterns mean the end of the text).
"""

from __future__ import annotations

import re
from functools import lru_cache

from engram.functions import sql as F
from engram.functions.sql import Expr as Column

_ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: What ``\\s`` means to the JVM.
_SPACES = " \t\n\x0b\f\r"


@lru_cache(maxsize=None)
def jvm(pattern: str, ignore_case: bool = True) -> str:
    """The pattern as the JVM must see it."""
    out = pattern.replace(r"\b", _ASCII_BOUNDARY)
    out = re.sub(r"(?<!\\)\$", r"\\z", out)
    return ("(?i)" if ignore_case else "") + out


@lru_cache(maxsize=None)
def group_index(pattern: str, name: str) -> int:
    """Position of a named group, for engines that number groups."""
    plain = re.sub(r"\(\?<([A-Za-z]+)>", r"(?P<\1>", pattern)
    return re.compile(plain).groupindex[name]


@lru_cache(maxsize=None)
def unnamed(pattern: str) -> str:
    """The pattern with its named groups turned into numbered ones."""
    return re.sub(r"\(\?<[A-Za-z]+>", "(", pattern)


@lru_cache(maxsize=None)
def beginnings(pattern: str) -> tuple[str, ...]:
    """Plain beginnings, one of which a text that matches ``\\b(a|b ...)\\b`` must hold; none for
    other patterns."""
    listed = re.fullmatch(r"\\b\((?!\?)(.*)\)\\b", pattern)
    if not listed:
        return ()
    alternatives, depth = [""], 0
    for ch in listed[1]:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            alternatives.append("")
        else:
            alternatives[-1] += ch
    # A letter before a quantifier may be missing.
    plain = [re.match(r"(?:[a-z0-9' ](?![?*{]))*", a)[0] for a in alternatives]
    if depth or not all(plain):
        return ()
    return tuple(p for p in dict.fromkeys(plain) if not any(
        o in p and o != p for o in plain))


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Lists of words are looked for as plain text before their boundaries are tested at every
    place, which costs many times as much."""
    held = beginnings(pattern)
    if not held:
        return text.rlike(jvm(pattern, ignore_case))

    def tested(t):
        found = F.let(F.lower(t), lambda low: holds(low, *held)) if ignore_case else holds(t, *held)
        return found & t.rlike(jvm(pattern, ignore_case))
    return F.let(text, tested) if "(" in text.sql else tested(text)


def holds(text: Column, *parts: str) -> Column:
    """Whether a text holds any of the parts, as they are."""
    some = text.contains(parts[0])
    for part in parts[1:]:
        some = some | text.contains(part)
    return some


def group(text: Column, pattern: str, name: str | int, ignore_case: bool = True) -> Column:
    """One captured group, '' when the pattern or the group does not match."""
    index = name if isinstance(name, int) else group_index(pattern, name)
    return F.regexp_extract(text, jvm(pattern, ignore_case), index)


def remove(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.regexp_replace(text, jvm(pattern, ignore_case), "")


def strip(text: Column) -> Column:
    """Trim all whitespace, not only blanks."""
    return F.btrim(text, _SPACES)


def words(text: Column, pattern: str) -> Column:
    """All matches of a group-free pattern, in order."""
    return F.regexp_extract_all(text, pattern, 0)


def str_array(values) -> Column:
    return F.array_of(values)


def any_in(array: Column, values) -> Column:
    """Whether an array without nulls holds one of the values (hashed once)."""
    return F.exists(array, lambda w: w.isin(*values))
