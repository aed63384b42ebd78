"""Scalar text functions: normalisation, hashing, slugs, tokens, keywords."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as SF
from pyspark.sql import types as T

from engram.functions import sql as F
from engram.functions.sql import Expr as Column

from engram.functions import fixed_values as V
from engram.functions.regex import holds, jvm, strip, words


@SF.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def nfkc(column: str) -> SparkColumn:
    """Unicode NFKC.  ASCII text is already normal, so only other rows carry their
    text to the Arrow function; the rest travel as nulls."""
    text = SF.col(column)
    foreign = SF.when(text.rlike(r"[^\x00-\x7F]"), text)
    return SF.coalesce(_nfkc(foreign), text)


def canonical_content(content: Column, is_text: Column | None = None) -> Column:
    """Message content as text: null becomes '', structured content its JSON text."""
    if is_text is None:
        return F.coalesce(content, F.lit(""))
    return F.coalesce(F.when(is_text, content), F.to_json(content), F.lit(""))


def content_hash(role: Column, content: Column, ordinal: Column | None = None) -> Column:
    """SHA-256 of the JSON object {role, content[, ordinal]}; a null ordinal is left out."""
    fields = [role.alias("role"), content.alias("content")]
    if ordinal is not None:
        fields.append(ordinal.alias("ordinal"))
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def first_nonblank(*columns: Column) -> Column:
    """First value that is not null or blank, trimmed."""
    return F.coalesce(*[F.when(strip(c) != "", strip(c)) for c in columns])


def normalize_utterance(text: Column) -> Column:
    """Lower-case words separated by single blanks; punctuation other than + dropped.

    Pass text that is already NFKC (see ``nfkc``)."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\w+]+", " "))


def normalize_quotes(text: Column) -> Column:
    return F.translate(
        text, V.APOSTROPHES + V.DOUBLE_QUOTES,
        "'" * len(V.APOSTROPHES) + '"' * len(V.DOUBLE_QUOTES),
    )


def expand_contractions(text: Column) -> Column:
    """Expand each listed contraction, lower-case or capitalised, in list order."""
    for short, full in V.CONTRACTIONS:
        text = F.replace(text, short, full)
        text = F.replace(text, short.capitalize(), full.capitalize())
    return text


def normalize_text(text: Column) -> Column:
    """Quotes folded, contractions expanded, repeated marks and blanks collapsed, lower case."""
    out = expand_contractions(normalize_quotes(text))
    for mark in (".", "!", "?"):
        out = F.regexp_replace(out, f"[{mark}]{{2,}}", mark)
    return F.lower(strip(F.regexp_replace(out, r"\s+", " ")))


def slugify(text: Column) -> Column:
    """First six alphanumeric runs joined by underscores, or 'item'."""
    runs = F.slice(words(F.lower(text), "[a-z0-9]+"), 1, 6)
    return F.let(F.array_join(runs, "_"), lambda joined: F.when(
        joined == "", F.lit("item")).otherwise(joined))


def clean_value(text: Column) -> Column:
    """Trim, unwrap quotes, drop closing punctuation."""
    unquoted = F.btrim(strip(text), "'\"`")
    return strip(Column(f"trim(TRAILING '.!?' FROM {unquoted})"))


def american_spelling(text: Column) -> Column:
    def respelled(t):
        out = t
        for british, american in V.SPELLINGS:
            out = F.regexp_replace(out, jvm(rf"\b{british}\b", False), american)
        return F.when(holds(t, *[british for british, _ in V.SPELLINGS]), out).otherwise(t)
    return F.let(F.lower(text), respelled)


def drop_trailing_temporal(text: Column) -> Column:
    return strip(F.regexp_replace(text, jvm(V.TRAILING_TEMPORAL), ""))


def capitalize_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2147483647))


def is_invalid_key(text: Column) -> Column:
    return F.lower(text).isin(*V.INVALID_KEYS)


def estimate_tokens(text: Column) -> Column:
    """max(words and punctuation runs, characters / 3.8 rounded), 0 for blank text."""
    clean = strip(F.coalesce(text, F.lit("")))
    runs = F.regexp_count(clean, r"\w+|[^\w\s]+")
    by_length = F.floor(F.length(clean) / F.lit(3.8) + F.lit(0.5))
    return F.when(clean == "", F.lit(0)).otherwise(
        F.greatest(runs.cast("long"), by_length.cast("long"), F.lit(1).cast("long"))
    ).cast("long")


def message_tokens(content: Column, name: Column | None = None,
                   tool_call_id: Column | None = None,
                   tool_calls: Column | None = None, parts: Column | None = None) -> Column:
    """Tokens of one message: 3 overhead + content (or its parts) + name + tool ids + calls."""
    body = estimate_tokens(content)
    if parts is not None:
        listed = F.aggregate(parts, F.lit(0).cast("long"),
                             lambda acc, part: acc + estimate_tokens(part))
        body = F.when(parts.isNotNull(), listed).otherwise(body)
    total = F.lit(3).cast("long") + body
    for extra in (name, tool_call_id):
        if extra is not None:
            present = F.coalesce(extra, F.lit("")) != ""
            total = total + F.when(present, estimate_tokens(extra) + 1).otherwise(0)
    if tool_calls is not None:
        calls = F.aggregate(
            F.coalesce(tool_calls, F.array_of(()).cast("array<struct<name:string,arguments:string>>")),
            F.lit(0).cast("long"),
            lambda acc, call: acc + estimate_tokens(call["name"])
            + estimate_tokens(call["arguments"]) + F.lit(3),
        )
        total = total + calls
    return total


def keywords(text: Column) -> Column:
    """Distinct words of 3+ characters that are not stopwords, in order of appearance."""
    found = words(american_spelling(text), r"\w+")
    return F.array_distinct(
        F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*V.KEYWORD_STOPWORDS))
    )


def ranked_keywords(kws: Column, limit: int = V.KEYWORD_LIMIT) -> Column:
    """Longest first, then alphabetical, top ``limit``."""
    keyed = F.transform(kws, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(keyed), 1, limit), lambda s: s["w"])


def redact(text: Column) -> Column:
    """Mask key-like tokens and connection strings."""
    for pattern, replacement in V.SECRET_MASKS:
        text = F.regexp_replace(text, jvm(pattern, False), replacement)
    return text


def truncate_tool_output(role: Column, content: Column) -> Column:
    """Tool output over 1000 characters keeps its first ten lines and a line count."""
    lines = F.split(content, "\n")
    head = F.array_join(F.slice(lines, 1, V.TOOL_OUTPUT_HEAD_LINES), "\n")
    note = F.concat(F.lit("\n... [tool output truncated for context budget: "),
                    F.size(lines).cast("string"), F.lit(" lines total]"))
    too_long = (role == "tool") & (F.length(content) > V.TOOL_OUTPUT_MAX_CHARS)
    return F.when(too_long, F.concat(head, note)).otherwise(content)


def stability_score(label: Column) -> Column:
    chain = F.lit(None).cast("double")
    for name, score in V.STABILITY_LABELS.items():
        chain = F.when(label == name, F.lit(score)).otherwise(chain)
    return F.coalesce(chain, F.lit(0.85))


def stability_label(score: Column) -> Column:
    return (F.when(score >= 0.95, "permanent").when(score >= 0.7, "long-term")
            .when(score >= 0.4, "short-term").otherwise("session"))


def title_text(name: Column) -> Column:
    """'tech_stack' -> 'Tech Stack'."""
    parts = F.transform(F.split(name, "_"), lambda w: capitalize_first(w))
    return F.array_join(parts, " ")


def structured_text(name: Column, fields: Column) -> Column:
    """Map value as 'Title: k=v, k=v' (entries in key order)."""
    entries = F.array_sort(F.map_entries(fields))
    pairs = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(title_text(name), F.lit(": "), F.array_join(pairs, ", "))

