"""Row predicates: low information, questions, hedges, noise, preference domains."""

from __future__ import annotations

from engram.functions import sql as F
from engram.functions.sql import Expr as Column
from engram.functions.sql import let

from engram.functions import fixed_values as V
from engram.functions.regex import any_in, group, matches, str_array, strip, words
from engram.functions.text import american_spelling, normalize_utterance, slugify

VALUE_WORD = r"[a-z0-9+#.-]+"


def all_low_info(normalized: Column) -> Column:
    """Blank, a listed phrase, or made of listed words only."""
    return let(normalized, lambda n: (
        (n == "") | n.isin(*V.LOW_INFO_PHRASES)
        | F.forall(F.split(n, " "), lambda w: w.isin(*V.LOW_INFO_PHRASES))))


def is_low_info(plain: Column, role: Column) -> Column:
    """``plain`` is the NFKC text of the message."""
    return role.isin("user", "assistant") & all_low_info(normalize_utterance(plain))


def is_interrogative(text: Column, plain: Column | None = None) -> Column:
    """Question mark at the end, a lone question word, or a question opening.

    ``plain`` is the NFKC text, where it may differ from ``text``."""
    def ask(t):
        opens = (
            matches(t, V.WH_AUX)
            | matches(t, V.WH_CONTRACTED)
            | matches(t, V.HOW_MODIFIER)
            | (matches(t, V.WH_NOUN_AUX) & ~matches(t, V.WH_NOUN_PRONOUN))
            | (matches(t, V.INVERSION_AUX) & ~matches(t, V.INVERSION_NEGATED))
            | matches(t, V.INVERSION_OTHER)
            | matches(t, V.INQUIRY_REQUEST))
        alone = matches(F.lower(t if plain is None else F.coalesce(plain, "")),
                        r"^[^\w+]*(?:" + "|".join(V.STANDALONE_QUESTION_WORDS) + r")[^\w+]*$",
                        False)
        return (t != "") & (
            (t.contains("?") & matches(t, V.QUESTION_TAIL))
            | (matches(t, "^(?:" + "|".join(V.QUESTION_OPENINGS) + ")") & opens)
            | alone)
    return let(strip(F.coalesce(text, "")), ask)


def is_speculative(text: Column) -> Column:
    return matches(text, V.SPECULATIVE)


def is_correction_like(text: Column) -> Column:
    return matches(text, V.CORRECTION_MARKER)


def has_decision_marker(text: Column) -> Column:
    return matches(text, V.DECISION_MARKER)


def has_negation(text: Column) -> Column:
    return matches(text, V.NEGATION)


def wants_history(text: Column) -> Column:
    return matches(text, V.WANTS_HISTORY)


def is_noise(text: Column) -> Column:
    """Only filler words left after dropping punctuation."""
    return let(normalize_utterance(text), lambda flat: (flat == "") | F.forall(
        F.split(flat, " "), lambda w: w.isin(*V.NOISE_WORDS)))


def is_preference_noise(value: Column) -> Column:
    """A preference value that names nothing: empty, a question, a demonstrative or
    only discourse nouns."""
    bare = strip(F.regexp_replace(
        F.regexp_replace(strip(F.lower(value)), r"^(?:a|an|the)\s+", ""), r"[.!?]+\z", ""))
    return let(words(bare, VALUE_WORD), lambda found: (
        (F.size(found) == 0)
        | any_in(found, V.INVALID_KEYS)
        | F.coalesce(F.try_element_at(found, 1).isin(*V.DEMONSTRATIVES), False)
        | (F.size(F.array_except(found, str_array(V.PREFERENCE_NOISE_VALUES))) == 0)))


def authority(role: Column, content: Column) -> Column:
    return (F.when(is_speculative(content), "speculation")
            .when(role.isin("user", "assistant"), role).otherwise("speculation"))


def preference_domain(choice: Column, other: Column | None = None) -> Column:
    """Attribute a preference belongs to; 'preference' when no family matches."""
    both = american_spelling(F.concat(choice, " ", "" if other is None else other))

    def route(m):
        chain = None
        for family, pieces, extra, attribute in V.PREFERENCE_DOMAINS:
            hit = any_in(m["words"], family + extra)
            for piece in pieces:
                hit = hit | m["text"].contains(piece)
            chain = F.when(hit, attribute) if chain is None else chain.when(hit, attribute)
        return chain.otherwise("preference")
    return let(both, lambda text: let(
        F.struct(text.alias("text"), words(text, VALUE_WORD).alias("words")), route))


def preference_topic(choice: Column, domain: Column) -> Column:
    """Topic of a preference from its domain, or from the choice itself."""
    return let(domain, lambda d: F.concat(
        "preference:", F.when(d == "preference", slugify(choice)).otherwise(d)))


def routed(text: Column, table, otherwise: str | None) -> Column:
    """First (name, pattern) of the table found in the text."""
    def route(lowered):
        chain = None
        for name, pattern in table:
            hit = matches(lowered, pattern, False)
            chain = F.when(hit, name) if chain is None else chain.when(hit, name)
        return chain.otherwise(F.lit(otherwise).cast("string"))
    return let(F.lower(text), route)


def value_attribute(value: Column) -> Column:
    return routed(value, V.VALUE_ATTRIBUTES, "technology")


def purpose_attribute(purpose: Column) -> Column:
    return routed(purpose, V.PURPOSE_ATTRIBUTES, None)


def switch_attribute(value: Column) -> Column:
    return routed(value, V.SWITCH_VALUE_ATTRIBUTES, "technology")


def lookup(key: Column, table: dict) -> Column:
    """Value of a small fixed table, null when the key is absent."""
    pairs = [x for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def canonical_attribute(attribute: Column) -> Column:
    """One of the ten canonical attributes, or null (reject)."""
    slug = slugify(strip(american_spelling(attribute)))
    return F.when(slug.startswith("disliked_"), "dislike").otherwise(
        lookup(slug, V.ATTRIBUTE_ALIASES))


def split_comparison(value: Column) -> tuple[Column, Column]:
    """'A over B' / 'A than B' -> (A, B); otherwise (value, '')."""
    over, than = matches(value, V.OVER), matches(value, V.THAN)
    left = (F.when(over, group(value, V.OVER, "value"))
            .when(than, group(value, V.THAN, "value")).otherwise(value))
    right = (F.when(over, group(value, V.OVER, "other"))
             .when(than, group(value, V.THAN, "other")).otherwise(F.lit("")))
    return left, right
