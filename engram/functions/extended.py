"""The extended fact rules: every rule that matches a clause gives a fact."""

from __future__ import annotations

from engram.functions import sql as F
from engram.functions.sql import Expr as Column
from engram.functions.sql import let

from engram.functions import fixed_values as V
from engram.functions.classify import (
    is_interrogative, is_preference_noise, lookup, preference_domain,
)
from engram.functions.facts import fact, note, split_by_boundary
from engram.functions.regex import group, matches, strip
from engram.functions.text import (
    american_spelling, clean_value, is_invalid_key, normalize_text, slugify,
)


def _usable(val: Column) -> Column:
    return (val != "") & ~is_invalid_key(val)


def _value_rule(text: Column, pattern: str, attribute: str, mtype: str, state: str,
                confidence: float, scope: str = "user", key: str | None = None) -> Column:
    """Template for rules whose captured value is the fact's value."""
    return let(clean_value(group(text, pattern, "val")), lambda val: F.when(
        _usable(val), fact("user", attribute, val, mtype, text, key or f"user.{attribute}",
                           scope, state=state, confidence=confidence)))


def identity(text: Column) -> Column:
    named = [_value_rule(text, p, a, "fact", "current", c) for a, p, c in V.IDENTITY_RULES]
    role = let(clean_value(group(text, V.IDENTITY_ROLE, "val")), lambda val: F.when(
        _usable(val) & ~F.lower(val).isin(*V.TRANSIENT_IDENTITY_WORDS),
        fact("user", "occupation", val, "fact", text, "user.occupation", "user",
             state="current", confidence=0.95)))

    def place(attribute, pattern):
        if attribute != "age":
            return _value_rule(text, pattern, attribute, "fact", "current", 1.0)

        def age(val):
            digits = F.regexp_extract(val, r"\d+", 0)
            return F.when(_usable(val), fact(
                "user", "age", F.when(digits != "", digits).otherwise(val), "fact", text,
                "user.age", "user", state="current", confidence=1.0))
        return let(clean_value(group(text, pattern, "val")), age)
    return F.coalesce(*named, role, *[place(a, p) for a, p in V.IDENTITY_PLACE_RULES])


def ownership(text: Column) -> Column:
    def one(pattern, confidence):
        attr = (clean_value(group(text, pattern, "attr")) if "<attr>" in pattern
                else F.lit("ownership"))
        entity = attr if "<attr>" in pattern else F.lit("user")
        return let(clean_value(group(text, pattern, "val")), lambda val: F.when(
            _usable(val) & ~F.lower(val).isin(*V.TRANSIENT_POSSESSIONS),
            fact(entity, attr, val, "fact", text, F.concat(F.lit("user."), slugify(attr)),
                 "user", state="current", confidence=confidence)))
    return F.coalesce(*[one(p, c) for p, c in V.OWNERSHIP_RULES])


def current_usage(text: Column) -> Column:
    negated = matches(text, V.USAGE_NEGATION)
    return F.coalesce(*[
        F.when(negated, _value_rule(text, p, "technology", "fact", "stopped",
                                    V.NEGATED_USAGE_CONFIDENCE))
        .otherwise(_value_rule(text, p, "technology", "fact", "current", c))
        for p, c in V.USAGE_RULES])


def past_usage(text: Column) -> Column:
    return _value_rule(text, V.PAST_USAGE, "technology", "fact", "past", 0.95)


def stopped_usage(text: Column) -> Column:
    reason = clean_value(group(text, V.STOPPED_USAGE, "reason"))
    return let(clean_value(group(text, V.STOPPED_USAGE, "val")), lambda val: F.when(
        _usable(val), fact("user", "technology", val, "fact", text, "user.technology", "user",
                           state="stopped", confidence=0.95, metadata=note("reason", reason))))


def local_preference(text: Column) -> Column:
    def one(pattern, confidence):
        over = (clean_value(group(text, pattern, "over")) if "<over>" in pattern else F.lit(""))
        return let(clean_value(group(text, pattern, "val")), lambda val: F.when(
            _usable(val), let(preference_domain(val, over), lambda domain: fact(
                "user", domain, val, "preference", text,
                F.concat(F.lit("user.preference."), slugify(domain)), "user", state="current",
                confidence=confidence, metadata=note("preferred_over", over)))))
    return F.coalesce(*[one(p, c) for p, c in V.LOCAL_PREFERENCE_RULES])


def local_dislike(text: Column) -> Column:
    def one(pattern, confidence):
        return let(clean_value(group(text, pattern, "val")), lambda val: F.when(
            _usable(val), fact(
                "user", "dislike", val, "preference", text,
                F.concat(F.lit("user.dislike."), slugify(val)), "user", state="current",
                confidence=confidence)))
    return F.when(~matches(text, V.NOT_A_DISLIKE),
                  F.coalesce(*[one(p, c) for p, c in V.LOCAL_DISLIKE_RULES]))


def favorite(text: Column) -> Column:
    def one(pattern, confidence):
        attr = american_spelling(strip(group(text, pattern, "attr")))

        def build(m):
            known = matches(m["a"], V.FAVORITE_DOMAIN)
            name = F.when(known, F.coalesce(lookup(m["a"], V.FAVORITE_DOMAIN_NAMES), m["a"])
                          ).otherwise(slugify(m["a"]))
            predicate = F.concat(F.lit("favorite_"), name)
            return F.when((m["v"] != "") & ~is_preference_noise(m["v"]), fact(
                "user", predicate, m["v"], "preference", text,
                F.concat(F.lit("user."), predicate), "user", state="current",
                confidence=confidence))
        return let(F.struct(attr.alias("a"),
                            clean_value(group(text, pattern, "val")).alias("v")), build)
    return F.coalesce(*[one(p, c) for p, c in V.FAVORITE_RULES])


def goal(text: Column) -> Column:
    return _value_rule(text, V.GOAL_RULE, "goal", "goal", "planned", 0.95)


def plan(text: Column) -> Column:
    return _value_rule(text, V.PLAN_RULE, "plan", "goal", "planned", 0.95)


def possible_plan(text: Column) -> Column:
    return _value_rule(text, V.POSSIBLE_PLAN_RULE, "plan", "goal", "possible", 0.7)


def decision(text: Column) -> Column:
    return _value_rule(text, V.DECISION_RULE, "decision", "decision", "current", 0.95)


def temporary_state(text: Column) -> Column:
    return _value_rule(text, V.TEMPORARY_RULE, "temporary_state", "temporary_state", "current",
                       0.4, scope="session")


def conditional(text: Column) -> Column:
    action = matches(text, V.CONDITIONAL_RULE) & matches(text, V.CONDITIONAL_ACTION)
    return F.when(action, fact(
        "user", "plan", clean_value(group(text, V.CONDITIONAL_ACTION, "val")), "goal", text,
        "user.plan", "user", state="conditional", confidence=0.6))


EXTENDED_RULES = {
    "identity": identity, "ownership": ownership, "usage": current_usage,
    "past_usage": past_usage, "stopped_usage": stopped_usage, "preference": local_preference,
    "dislike": local_dislike, "favorite": favorite, "goal": goal, "plan": plan,
    "possible_plan": possible_plan, "decision": decision, "temporary": temporary_state,
    "conditional": conditional,
}


def clause_facts(clause: Column) -> Column:
    return F.array_compact(F.array_of([rule(clause) for rule in EXTENDED_RULES.values()]))


def local_facts(text: Column) -> Column:
    """All extended facts of a text, distinct by key and value, in clause and rule order."""
    found = F.flatten(F.transform(split_by_boundary(text), clause_facts))

    def distinct(facts):
        indexed = F.transform(facts, lambda f, i: F.struct(i.alias("i"), f.alias("f")))
        kept = F.filter(indexed, lambda x: ~F.exists(indexed, lambda y: (
            (y["i"] < x["i"]) & (y["f"]["key"] == x["f"]["key"])
            & (y["f"]["value"] == x["f"]["value"]))))
        return F.transform(kept, lambda x: x["f"])
    return let(found, distinct)


# --- memory gate -------------------------------------------------------------

def _any(clause: Column, patterns) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | matches(clause, p)
    return hit


# Kinds whose patterns cover a clause locally, in test order.
GATE_KINDS = (
    ("identity", [p for _, p, _ in V.IDENTITY_RULES]),
    ("usage", [p for p, _ in V.USAGE_RULES]),
    ("preference", [p for p, _ in V.LOCAL_PREFERENCE_RULES]),
    ("dislike", [p for p, _ in V.LOCAL_DISLIKE_RULES] + [V.VALUELESS_DISLIKE]),
    ("favorite", [p for p, _ in V.FAVORITE_RULES]),
    ("goal", [V.GOAL_RULE]), ("plan", [V.PLAN_RULE]),
    ("possible_plan", [V.POSSIBLE_PLAN_RULE]), ("decision", [V.DECISION_RULE]),
    ("ownership", [p for p, _ in V.OWNERSHIP_RULES]), ("past_usage", [V.PAST_USAGE]),
    ("stopped_usage", [V.STOPPED_USAGE]), ("temporary", [V.TEMPORARY_RULE]),
)


def clause_kind(clause: Column) -> Column:
    chain = None
    for kind, patterns in GATE_KINDS:
        hit = _any(clause, patterns)
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain


def memory_gate(text: Column) -> Column:
    """struct(external, confidence, reason, kinds): skip, handle locally, or escalate."""
    def result(external, confidence, reason, kinds=None):
        empty = F.array_of(()).cast("array<string>")
        return F.struct(F.lit(external).alias("external"), F.lit(confidence).alias("confidence"),
                        F.lit(reason).alias("reason"),
                        (empty if kinds is None else kinds).alias("kinds"))

    def gate(s):
        clean, flat, clauses = s["clean"], s["flat"], s["clauses"]
        first = F.lower(F.regexp_extract(
            strip(F.regexp_replace(clean, r"[.!?]\s*\z", "")), r"^\S+", 0))
        lone_question = (is_interrogative(clean) & (F.size(clauses) == 1)
                         & first.isin(*V.INTERROGATIVE_STARTS))
        bare = strip(F.regexp_replace(flat, r"[.!?]+\z", ""))
        low = bare.isin(*V.GATE_LOW_INFO) | F.forall(
            F.split(bare, r"\s+"), lambda w: w.isin(*V.GATE_LOW_INFO))
        kinds = F.transform(clauses, clause_kind)
        known = F.array_distinct(F.array_compact(kinds))
        uncovered = F.exists(kinds, lambda k: k.isNull())
        mention = matches(flat, r"\b(?:" + "|".join(V.GATE_KEYWORDS) + r")\b", False)
        chain = F.when(clean == "", result(False, 0.99, "empty"))
        for reason, pattern in V.NON_MEMORY:
            chain = chain.when(matches(flat, pattern), result(False, 0.99, reason))
        return (chain.when(lone_question, result(False, 0.99, "pure_question"))
                .when(low, result(False, 0.99, "low_info"))
                .when(uncovered & ~mention & (F.size(known) == 0),
                      result(False, 0.85, "no_memory_keywords"))
                .when(uncovered, result(True, 0.5, "ambiguous_semantic",
                                        F.concat(known, F.array_of(["ambiguous"]))))
                .when(F.size(known) > 0, result(False, 0.95, "local_patterns", known))
                .otherwise(result(False, 0.85, "no_memory_keywords")))
    clean = strip(text)
    return let(F.struct(clean.alias("clean"), normalize_text(clean).alias("flat"),
                        split_by_boundary(clean).alias("clauses")), gate)


def gate_route(gate: Column, local_count: Column) -> Column:
    """skip / local / external for the combined extraction."""
    return (F.when(~gate["external"] & (F.size(gate["kinds"]) == 0), "skip")
            .when((local_count > 0) & (gate["confidence"] >= 0.9), "local")
            .when(~gate["external"], "local").otherwise("external"))


