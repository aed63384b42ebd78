"""Validation of externally extracted facts, as expressions over one message's facts."""

from __future__ import annotations

from engram.functions import fixed_values as V
from engram.functions import sql as F
from engram.functions.classify import (
    canonical_attribute, has_negation, is_interrogative, lookup, split_comparison,
    value_attribute,
)
from engram.functions.facts import FACT_TYPE, clause_attribute, fact, split_clauses
from engram.functions.regex import group, matches, strip, words
from engram.functions.sql import Expr, let
from engram.functions.text import clean_value, is_invalid_key, slugify

EMPTY_FACTS = F.array_of(()).cast(f"array<{FACT_TYPE}>")
NOT_NAMES = ("user", "project", "session")
METADATA = ("preferred_over", "condition", "reason")


def smallest_clause(source: Expr, clauses: Expr, value: Expr, preferred: Expr) -> Expr:
    """The given clause if it is a proper part of the source, else the shortest clause that
    mentions the value (or all its words), else the first clause."""
    chosen = strip(F.coalesce(preferred, ""))
    usable = ((chosen != "") & (F.length(chosen) < F.length(source))
              & F.lower(source).contains(F.lower(chosen)))

    def shortest(v):
        parts = words(v, r"[a-z0-9+#.-]+")
        hits = F.filter(
            F.transform(clauses, lambda c, i: F.struct(
                F.length(c).alias("n"), i.alias("i"), c.alias("c"))),
            lambda s: F.lower(s["c"]).contains(v) | ((F.size(parts) > 0) & F.forall(
                parts, lambda w: F.lower(s["c"]).contains(w))))
        return F.coalesce(F.try_element_at(F.array_sort(hits), 1)["c"],
                          F.try_element_at(clauses, 1), source)
    return F.when(usable, chosen).otherwise(let(F.lower(value), shortest))


def named_project(source: Expr, facts: Expr) -> Expr:
    """Project name from the facts, from 'called X', or after for / in / on; else null."""
    def own(f):
        entity = F.coalesce(f["entity"], "")
        is_project = canonical_attribute(f["attribute"]) == "project"
        other = ((f["scope"] == "project") & (entity != "")
                 & ~F.lower(entity).isin(*NOT_NAMES))
        named = (entity != "") & ~F.lower(entity).isin(*NOT_NAMES, "my")
        return (F.when(F.coalesce(is_project, False) & (strip(f["value"]) != ""),
                       clean_value(f["value"]))
                .when((F.coalesce(is_project, False) | other) & named, strip(entity)))
    after = group(source, V.PROJECT_AFTER_PREPOSITION, "name", ignore_case=False)
    return F.coalesce(
        F.try_element_at(F.array_compact(F.transform(facts, own)), 1),
        F.when(matches(source, V.PROJECT_NAMED),
               clean_value(group(source, V.PROJECT_NAMED, "name"))),
        F.when((after != "") & ~F.lower(after).isin(*V.TECH_KEYWORDS), after))


def looks_like_person(entity: Expr, names: Expr) -> Expr:
    """A known name, or two or more capitalised words that are no technology."""
    e = strip(entity)
    plain = ~F.lower(e).isin(*NOT_NAMES, "my", "we", "our")
    return (e != "") & plain & (F.array_contains(names, F.lower(e)) | (
        ~F.lower(e).isin(*V.TECH_KEYWORDS)
        & matches(e, r"^[A-Z][a-z'-]*(?:\s+[A-Z][a-z'-]*)+$", ignore_case=False)))


def type_of(attribute: Expr, state: Expr) -> Expr:
    return (F.when(attribute.isin("preference", "dislike"), "preference")
            .when(attribute.isin("goal", "plan"), "goal")
            .when(attribute == "experiment", "temporary_state")
            .when(attribute == "database", "decision")
            .when((attribute == "uses") & state.isin("planned", "possible", "conditional"),
                  "goal").otherwise("fact"))


def key_of(scope: Expr, attribute: Expr, value: Expr) -> Expr:
    plain = F.concat(scope, ".", slugify(attribute))
    return (F.when(attribute == "project", "project.name")
            .when(slugify(attribute).isin(*V.SINGLE_VALUE_ATTRIBUTES), plain)
            .otherwise(F.concat(plain, ".", slugify(value))))


def identity_of(f: Expr) -> Expr:
    """Facts with equal identity are one fact."""
    scope = F.coalesce(f["scope"], F.when(F.lower(f["entity"]).isin("user", "my"), "user")
                       .otherwise("project"))
    attr = slugify(f["attribute"])
    return F.when(attr.isin(*V.SINGLE_VALUE_ATTRIBUTES), F.concat(scope, "|", attr)).otherwise(
        F.concat(scope, "|", attr, "|", slugify(f["value"]), "|",
                 F.coalesce(f["state"], "current")))


def metadata_map(**values: Expr) -> Expr:
    """Map of the non-empty entries, null when there are none."""
    pairs = F.filter(F.array_of([F.struct(F.lit(k).alias("key"), v.alias("value"))
                                 for k, v in values.items()]),
                     lambda e: F.coalesce(e["value"], "") != "")
    return let(pairs, lambda p: F.when(F.size(p) > 0, F.map_from_entries(p)))


PROPOSAL_TYPE = ("struct<entity:string,attribute:string,value:string,state:string,"
                 "scope:string,metadata:map<string,string>>")
NO_PROPOSALS = F.array_of(()).cast(f"array<{PROPOSAL_TYPE}>")


def propose(entity, attribute, value, state, scope, metadata) -> Expr:
    """What a fact should become, as an array of one."""
    return F.array_of([F.struct(
        F.lit(entity).alias("entity"), F.lit(attribute).alias("attribute"),
        F.lit(value).alias("value"), F.lit(state).alias("state"), F.lit(scope).alias("scope"),
        F.lit(metadata).cast("map<string,string>").alias("metadata")).cast(PROPOSAL_TYPE)])


def _finish(m: Expr, p: Expr, raw: Expr, confidence: Expr) -> Expr:
    """Array of one finished fact, or empty when it has no value or no clause of its own."""
    def build(v):
        def anchored(clause):
            own = F.when(p["attribute"] == "project", v).when(
                p["attribute"].isin(*V.USER_OWNED_ATTRIBUTES), "user").otherwise(p["entity"])
            where = (F.when(p["attribute"] == "project", "project")
                     .when(p["attribute"] == "experiment", "session").otherwise(p["scope"]))
            ok = ((v != "") & ~is_invalid_key(v)
                  & ((F.size(m["clauses"]) <= 1) | (clause != m["source"])))
            return F.when(ok, F.array_of([fact(
                own, p["attribute"], v, type_of(p["attribute"], p["state"]), clause,
                key_of(where, p["attribute"], v), where, False, p["state"], confidence,
                p["metadata"])])).otherwise(EMPTY_FACTS)
        return let(smallest_clause(m["source"], m["clauses"], v, raw), anchored)
    return let(clean_value(p["value"]), build)


def atomic_values(value: Expr) -> Expr:
    """Parts of a compound technology value, each 'uses' or (with that role) 'database'."""
    def part(clause):
        return let(clause_attribute(clause), lambda c: let(clean_value(c["value"]), lambda v: (
            F.struct(F.when(
                ((c["attr"] == "database") | (value_attribute(v) == "database"))
                & matches(clause, V.DATABASE_ROLE), "database").otherwise("uses").alias("attr"),
                v.alias("value")))))
    return let(clean_value(value), lambda whole: let(split_clauses(whole), lambda cs: let(
        F.filter(F.transform(F.when(F.size(cs) <= 1, F.array_of([whole])).otherwise(cs), part),
                 lambda p: p["value"] != ""),
        lambda ps: F.when(F.size(ps) > 0, F.array_distinct(ps)).otherwise(
            F.array_of([F.struct(F.lit("uses").alias("attr"), whole.alias("value"))])))))


def _usage(m: Expr, f: Expr, attribute: Expr, clause: Expr) -> Expr:
    """Uses / database facts: state from the clause, compound values split."""
    stopped = matches(clause, V.STOPPED_HINT)
    past = matches(clause, V.PAST_HINT) & ~matches(clause, r"\bnow\b")
    given = F.coalesce(f["state"], "current")
    state = (F.when(stopped, "stopped").when(past, "past")
             .when(has_negation(clause) & (given == "current"), "stopped")
             .when(given.isin("past", "stopped"), given).otherwise("current"))
    because = clean_value(F.regexp_replace(group(clause, V.REASON_TEXT, "text"),
                                           r"\s*[.!?]+\z", ""))
    own = F.try_element_at(f["metadata"], "reason")
    reason = F.when(stopped & (F.coalesce(own, "") == ""), because).otherwise(own)
    value = F.when(stopped, clean_value(F.regexp_replace(
        f["value"], "(?i)" + V.REASON_TAIL.replace("$", r"\z"), ""))).otherwise(f["value"])
    compound = matches(f["value"], r",&|\band\b|\bwith\b") | (attribute == "uses")
    parts = F.when(compound, atomic_values(value)).otherwise(F.array_of(
        [F.struct(attribute.alias("attr"), clean_value(value).alias("value"))]))
    single = F.when((attribute == "database") & (F.size(parts) == 1), F.transform(
        parts, lambda p: F.struct(F.lit("database").alias("attr"), p["value"].alias("value")))
    ).otherwise(parts)
    entity = strip(F.coalesce(f["entity"], "user"))
    pronoun = F.lower(entity).isin(*V.PROJECT_PRONOUNS)
    in_project = m["project_scoped"] | (f["scope"] == "project") | pronoun
    person = looks_like_person(entity, m["names"]) | (F.lower(entity) == "user")
    about = F.coalesce(m["project"], F.when(
        m["project_scoped"] | person | pronoun, "project").otherwise(entity))
    meta = metadata_map(preferred_over=F.try_element_at(f["metadata"], "preferred_over"),
                        condition=F.try_element_at(f["metadata"], "condition"), reason=reason)
    about_what = F.struct(
        F.when(in_project, about).otherwise("user").alias("entity"), state.alias("state"),
        F.when(in_project, "project").otherwise("user").alias("scope"), meta.alias("metadata"))
    return let(about_what, lambda u: F.flatten(F.transform(single, lambda p: propose(
        u["entity"], p["attr"], p["value"], u["state"], u["scope"], u["metadata"]))))


def _aim(f: Expr, attribute: Expr, clause: Expr) -> Expr:
    """Goals and plans, with their condition."""
    given = F.coalesce(f["state"], "current")
    bare = strip(F.regexp_replace(
        f["value"], "(?i)" + V.GOAL_CONDITION_TAIL.replace(r"\b", "").replace("$", r"\z"), ""))
    led = F.regexp_replace(bare, "(?i)" + V.GOAL_LEAD, "")
    own = F.try_element_at(f["metadata"], "condition")

    def build(value):
        conditional = given.isin("possible", "conditional") | matches(clause, V.CONDITION_WORD)
        found = clean_value(F.regexp_replace(group(clause, V.CONDITION_TEXT, "text"),
                                             r"\s*[.!?]+\z", ""))
        condition = F.when(F.coalesce(own, "") != "", own).when(conditional, found)
        planned = (attribute == "plan") | matches(clause, r"\bplan\b")
        state = F.when(conditional, F.when(given == "possible", "possible").otherwise(
            "conditional")).otherwise("planned")
        reject = (matches(value, V.CONDITION_FRAGMENT) | matches(strip(clause), r"^if\b")
                  | F.coalesce(F.lower(value) == F.lower(own), False))
        return F.when(reject, NO_PROPOSALS).otherwise(propose(
            "user", F.when(conditional | planned, "plan").otherwise("goal"),
            F.when(value != "", value).otherwise(f["value"]), state, "user", metadata_map(
                preferred_over=F.try_element_at(f["metadata"], "preferred_over"),
                condition=condition, reason=F.try_element_at(f["metadata"], "reason"))))
    return let(clean_value(F.when(led != "", led).otherwise(bare)), build)


def _taste(f: Expr) -> Expr:
    value, other = split_comparison(f["value"])
    over = F.coalesce(F.nullif(clean_value(other), ""),
                      F.try_element_at(f["metadata"], "preferred_over"))
    return propose("user", "preference", clean_value(value), "current", "user", metadata_map(
        preferred_over=over, condition=F.try_element_at(f["metadata"], "condition"),
        reason=F.try_element_at(f["metadata"], "reason")))


def validated(m: Expr, f: Expr) -> Expr:
    """Facts one external fact stands for after normalisation (none when it is rejected)."""
    def by_attribute(attribute):
        def by_clause(clause):
            hinted = matches(clause, V.TEMPORARY_HINT) | (f["type"] == "temporary_state")
            question = (strip(clause).endswith("?") | is_interrogative(clause)
                        | matches(strip(clause), V.QUESTION_START))
            disliked = (attribute == "dislike") | matches(clause, V.DISLIKE_HINT)
            prefers = (((attribute == "preference") | (f["type"] == "preference"))
                       & (attribute != "dislike"))
            state = F.coalesce(f["state"], "current")
            meta = f["metadata"]

            def plain(name, where, value=f["value"], at="current", kept=meta):
                return propose("user", name, value, at, where, kept)
            proposals = (
                F.when(hinted, plain("experiment", "session"))
                .when(question, NO_PROPOSALS)
                .when(prefers, _taste(f))
                .when(disliked, plain("dislike", "user", F.regexp_replace(
                    f["value"], r"(?i)\s+anymore\s*\z", ""), kept=F.lit(None)))
                .when(attribute.isin("goal", "plan") | (f["type"] == "goal"),
                      _aim(f, attribute, clause))
                .when(attribute.isin("name", "occupation"), plain(attribute, "user"))
                .when(attribute == "project", plain("project", "project"))
                .when(attribute.isin("uses", "database"), _usage(m, f, attribute, clause))
                .otherwise(plain("experiment", F.coalesce(f["scope"], "user"), at=state)))
            return F.flatten(F.transform(proposals, lambda p: _finish(
                m, p, clause, f["confidence"])))
        usable = ((strip(f["value"]) != "") & ~strip(f["value"]).endswith("?")
                  & ~is_invalid_key(f["attribute"]) & attribute.isNotNull())
        return F.when(usable, let(smallest_clause(
            m["source"], m["clauses"], f["value"], f["raw_text"]), by_clause)
        ).otherwise(EMPTY_FACTS)
    return let(canonical_attribute(f["attribute"]), by_attribute)


def resolved(f: Expr, names: Expr, project: Expr) -> Expr:
    """Pronoun and person entities become user or project; scope and key follow."""
    lower = F.lower(f["entity"])
    mapped = (F.when(lower.isin(*V.ENTITY_PRONOUNS_PROJECT), F.coalesce(project, "project"))
              .when(lower.isin(*V.ENTITY_PRONOUNS_USER), "user").otherwise(f["entity"]))
    owned = f["attribute"].isin(*V.USER_OWNED_ATTRIBUTES)

    def build(entity):
        person = F.array_contains(names, lower) | looks_like_person(entity, names)
        who = (F.when(f["attribute"] == "project", f["value"]).when(owned, "user")
               .when(person & (f["scope"] == "project"), F.coalesce(project, "project"))
               .when(person, "user")
               .when(f["attribute"].isin("uses", "database") & (f["scope"] == "project")
                     & (entity == "project"), F.coalesce(project, "project")).otherwise(entity))
        scope = (F.when(f["attribute"] == "project", "project")
                 .when(owned & (f["attribute"] != "experiment"), "user").otherwise(f["scope"]))
        where = F.coalesce(scope, F.when(F.lower(who).isin("user", "my"), "user")
                           .otherwise("project"))
        return fact(who, f["attribute"], f["value"], f["type"], f["raw_text"],
                    key_of(where, f["attribute"], f["value"]), scope, f["is_update"], f["state"],
                    f["confidence"], f["metadata"])
    return let(mapped, build)


def deduplicated(facts: Expr) -> Expr:
    """One fact per identity: the most confident, first on ties, with merged metadata; then
    one dislike per value."""
    def one(group):
        ranked = F.array_sort(F.transform(group, lambda x: F.struct(
            (-F.coalesce(x["f"]["confidence"], 0.0)).alias("c"), x["i"].alias("i"))))

        def best(i):
            kept = F.element_at(F.filter(group, lambda x: x["i"] == i), 1)["f"]

            def merged(name):
                others = F.array_compact(F.transform(group, lambda x: F.try_element_at(
                    x["f"]["metadata"], name)))
                return F.coalesce(F.try_element_at(kept["metadata"], name),
                                  F.try_element_at(others, 1))
            meta = metadata_map(**{n: merged(n) for n in METADATA})
            return let(kept, lambda k: fact(
                k["entity"], k["attribute"], k["value"], k["type"], k["raw_text"], k["key"],
                k["scope"], k["is_update"], k["state"], k["confidence"], meta))
        return let(F.element_at(ranked, 1)["i"], best)
    indexed = F.transform(facts, lambda f, i: F.struct(
        i.alias("i"), identity_of(f).alias("k"), f.alias("f")))

    def collapse(rows):
        keys = F.array_distinct(F.transform(rows, lambda r: r["k"]))
        unique = F.transform(keys, lambda k: let(F.filter(rows, lambda r: r["k"] == k), one))

        def dislikes(us):
            numbered = F.transform(us, lambda f, i: F.struct(i.alias("i"), f.alias("f")))
            return let(numbered, lambda ns: F.transform(F.filter(ns, lambda x: ~(
                (x["f"]["attribute"] == "dislike") & F.exists(ns, lambda y: (
                    (y["i"] < x["i"]) & (y["f"]["attribute"] == "dislike")
                    & (slugify(y["f"]["value"]) == slugify(x["f"]["value"])))))),
                lambda x: x["f"]))
        return let(unique, dislikes)
    return let(indexed, collapse)


def canonical(f: Expr) -> Expr:
    """A fact with its attribute made canonical, null when that is not possible."""
    def build(attribute):
        owned = attribute.isin(*V.USER_OWNED_ATTRIBUTES)
        return F.when(attribute.isNotNull(), fact(
            F.when(owned, "user").otherwise(f["entity"]), attribute, f["value"], f["type"],
            f["raw_text"], f["key"],
            F.when(owned & (attribute != "experiment"), "user").otherwise(f["scope"]),
            f["is_update"], f["state"], f["confidence"], f["metadata"]))
    return let(canonical_attribute(f["attribute"]), build)


def state_of(state: Expr) -> Expr:
    return F.coalesce(lookup(state, V.EXTERNAL_STATES), "current")


def names_in(facts: Expr) -> Expr:
    """Lower-case names of the people a message's facts are about."""
    named = F.filter(facts, lambda f: F.coalesce(
        canonical_attribute(f["attribute"]) == "name", False))
    return F.concat(F.transform(named, lambda f: F.lower(f["value"])),
                    F.transform(named, lambda f: F.lower(f["entity"])))

