"""Rules that turn one sentence into a fact, as column expressions.

Every rule is a nullable struct; rules are combined by ``coalesce`` (first match).
All of this is evaluated inside the row, so extraction never shuffles.
"""

from __future__ import annotations

from engram.functions import sql as F
from engram.functions.sql import Expr as Column
from engram.functions.sql import let

from engram.functions import fixed_values as V
from engram.functions.classify import (
    VALUE_WORD, is_interrogative, is_preference_noise, lookup, preference_domain,
    preference_topic, purpose_attribute, switch_attribute, value_attribute,
)
from engram.functions.regex import (
    any_in, group, holds, jvm, matches, remove, strip, words,
)
from engram.functions.text import (
    american_spelling, capitalize_first, clean_value, drop_trailing_temporal,
    is_invalid_key, slugify,
)

FACT_TYPE = (
    "struct<entity:string,attribute:string,value:string,type:string,raw_text:string,"
    "key:string,scope:string,is_update:boolean,state:string,confidence:double,"
    "metadata:map<string,string>>"
)


def fact(entity, attribute, value, mtype, raw_text, key=None, scope=None, is_update=False,
         state=None, confidence=None, metadata=None) -> Column:
    def col(x, kind="string"):
        return (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(
        col(entity).alias("entity"), col(attribute).alias("attribute"),
        col(value).alias("value"), col(mtype).alias("type"), col(raw_text).alias("raw_text"),
        col(key).alias("key"), col(scope).alias("scope"),
        col(is_update, "boolean").alias("is_update"), col(state).alias("state"),
        col(confidence, "double").alias("confidence"),
        col(metadata, "map<string,string>").alias("metadata"),
    )


def note(name: str, value: Column) -> Column:
    """One-entry metadata map, null when the value is empty."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.create_map(F.lit(name), value))


def _parts(**values) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def _named(text: Column, pattern: str, **cleaners) -> Column:
    """Captured groups of a pattern as a struct, each cleaned once."""
    return _parts(**{name: f(group(text, pattern, name)) for name, f in cleaners.items()})


def user_or_project(entity: Column, *user_words: str) -> Column:
    return F.when(F.lower(entity).isin(*(user_words or ("user",))), "user").otherwise("project")


def scoped_key(scope: Column, attribute: Column) -> Column:
    return F.concat(scope, F.lit("."), slugify(attribute))


# --- single rules ----------------------------------------------------------

def building(text: Column) -> Column:
    def build(val):
        name = group(val, V.CALLED, "name")
        project = F.when(name != "", name).otherwise(val)
        return F.when((val != "") & ~is_invalid_key(val), fact(
            project, "project", project, "fact", text, "project.name", "project"))
    return let(clean_value(group(text, V.BUILDING, "val")), build)


def location(text: Column) -> Column:
    place = F.when(matches(text, V.LIVES_IN), group(text, V.LIVES_IN, "val")).otherwise(
        group(text, V.IS_FROM, "val"))
    return let(clean_value(place), lambda val: F.when(
        (val != "") & ~is_invalid_key(val),
        fact("user", "location", val, "fact", text, "user.location", "user",
             state="current", confidence=1.0)))


def possessive(text: Column) -> Column:
    def build(m):
        attr = F.lower(m["attr"])
        mtype = (F.when(attr.contains("architecture") | attr.contains("design"), "architecture")
                 .when(attr.contains("goal") | attr.contains("objective"), "goal")
                 .otherwise("fact"))
        scope = user_or_project(m["entity"])
        ok = ((m["entity"] != "") & (m["attr"] != "") & (m["val"] != "")
              & ~is_invalid_key(m["entity"]) & ~is_invalid_key(m["attr"]))
        return F.when(ok, fact(m["entity"], m["attr"], m["val"], mtype, text,
                               scoped_key(scope, m["attr"]), scope))
    return F.when(matches(text, V.POSSESSIVE), let(
        _named(text, V.POSSESSIVE, entity=strip, attr=strip, val=clean_value), build))


def favorite_is(text: Column) -> Column:
    def build(m):
        kind = F.when(m["kind"] == "preferred", "preferred").otherwise("favorite")
        predicate = F.concat(kind, F.lit("_"), m["attr"])
        ok = (~is_invalid_key(m["attr"]) & (m["val"] != "") & ~is_preference_noise(m["val"]))
        return F.when(ok, fact("user", predicate, m["val"], "preference", text,
                               F.concat(F.lit("user."), predicate), "user"))
    return F.when(matches(text, V.FAVORITE_IS), let(_named(
        text, V.FAVORITE_IS, kind=F.lower,
        attr=lambda c: slugify(american_spelling(strip(c))),
        val=lambda c: drop_trailing_temporal(clean_value(c))), build))


def prefers(text: Column) -> Column:
    def build(m):
        choice = F.when(F.lower(m["choice"]).startswith("use "),
                        strip(F.substring(m["choice"], 5, 2147483647))).otherwise(m["choice"])
        other = F.when(m["other"] != "", m["other"]).otherwise(m["than"])
        ok = (m["choice"] != "") & ~is_invalid_key(m["choice"])
        return F.when(ok, let(preference_domain(choice, other), lambda domain: fact(
            "user", domain, choice, "preference", text,
            F.concat(F.lit("user.preference."), slugify(domain)), "user",
            metadata=note("preferred_over", other))))
    return F.when(matches(text, V.PREFERS), let(_named(
        text, V.PREFERS, choice=clean_value, other=clean_value, than=clean_value), build))


def affect(text: Column) -> Column:
    def value(c):
        bare = drop_trailing_temporal(clean_value(c))
        return strip(F.regexp_replace(bare, r"(?i)^(?:a|an|the)\s+", ""))

    def build(m):
        negative = (m["negVerb"] != "") | m["verb"].isin("hate", "dislike")

        def named(domain):
            plain = F.when(domain == "preference", slugify(m["val"])).otherwise(domain)
            disliked = F.concat(F.lit("disliked_"),
                                F.when(domain == "favorite_color", "color").otherwise(plain))
            return F.when(negative, disliked).otherwise(plain)
        return F.when((m["val"] != "") & ~is_preference_noise(m["val"]), let(
            let(preference_domain(m["val"]), named), lambda attribute: fact(
                "user", attribute, m["val"], "preference", text,
                F.concat(F.lit("user."), attribute), "user")))
    return F.when(matches(text, V.AFFECT), let(_named(
        text, V.AFFECT, negVerb=F.lower, verb=F.lower, val=value), build))


def uses(text: Column) -> Column:
    def build(m):
        entity = F.when(F.lower(m["entity"]).startswith("the "),
                        strip(F.substring(m["entity"], 5, 2147483647))).otherwise(m["entity"])
        scope = user_or_project(entity, "user", "my")

        def route(r):
            by_purpose = (r["purpose"] != "") & ~matches(r["purpose"], V.PLACE_PURPOSE)
            by_value = r["by_value"] != "technology"
            ui = any_in(r["words"], V.UI_WORDS)
            frontend = any_in(r["words"], V.FRONTEND_WORDS)
            attribute = (
                F.when(by_purpose, F.coalesce(purpose_attribute(r["purpose"]),
                                              slugify(r["purpose"])))
                .when(by_value, r["by_value"]).when(ui, "ui_library").when(frontend, "frontend")
                .when(any_in(r["words"], V.WORKFLOW_WORDS), "workflow")
                .when(F.lower(entity) == "team", "workflow").otherwise("technology"))
            mtype = F.when(by_purpose | by_value | ui | frontend, "decision").otherwise("fact")
            return F.struct(attribute.alias("a"), mtype.alias("t"))
        routed = let(F.struct(
            strip(group(m["val"], V.FOR_PURPOSE, "purpose")).alias("purpose"),
            value_attribute(m["val"]).alias("by_value"),
            words(F.lower(m["val"]), VALUE_WORD).alias("words")), route)
        ok = (m["entity"] != "") & (m["val"] != "") & ~is_invalid_key(m["entity"])
        return F.when(ok, let(routed, lambda r: fact(
            entity, r["a"], m["val"], r["t"], text, scoped_key(scope, r["a"]), scope)))
    return F.when(matches(text, V.USES), let(
        _named(text, V.USES, entity=strip, val=clean_value), build))


def the_y_is_x(text: Column) -> Column:
    def build(m):
        found = words(F.lower(m["attr"]), VALUE_WORD)

        def has(*names):
            return any_in(found, names)
        mtype = (F.when(matches(m["attr"], V.DECISION_ATTRIBUTE), "decision")
                 .when(has("architecture", "design"), "architecture")
                 .when(has("goal", "objective"), "goal")
                 .when(has("preference", "prefer"), "preference").otherwise("fact"))
        named = F.lower(strip(text)).startswith("my name")
        entity = F.when(named, "user").otherwise(m["attr"])
        attr = F.when(named, "name").otherwise(m["attr"])
        scope = user_or_project(entity)
        ok = (m["attr"] != "") & (m["val"] != "") & ~is_invalid_key(m["attr"])
        return F.when(ok, fact(entity, attr, m["val"], mtype, text,
                               scoped_key(scope, attr), scope))
    return F.when(matches(text, V.THE_Y_IS_X), let(
        _named(text, V.THE_Y_IS_X, attr=strip, val=clean_value), build))


RULES = {
    "building": building, "location": location, "possessive": possessive,
    "favorite": favorite_is, "prefer": prefers, "affect": affect, "uses": uses,
    "y_is_x": the_y_is_x,
}


def first_fact(text: Column) -> Column:
    """The first rule that matches a trimmed statement (questions give none)."""
    return F.when((text != "") & ~is_interrogative(text),
                  F.coalesce(*[rule(text) for rule in RULES.values()]))


# --- updates and lists -----------------------------------------------------

def switch_update(text: Column) -> Column:
    """'switched [T] to N' as a project decision flagged as an update."""
    def build(target):
        def inner(m):
            new = strip(F.regexp_replace(m["new"], "(?i)" + V.SWITCH_TAIL.replace("$", r"\z"), ""))
            entity = F.when((target == "") | matches(F.lower(target), V.SWITCH_PRONOUN),
                            "project").otherwise(target)
            return let(_parts(v=new, a=switch_attribute(new)), lambda s: fact(
                entity, s["a"], s["v"], "decision", text,
                F.concat(F.lit("project."), slugify(s["a"])), "project", is_update=True))
        return inner
    with_target = matches(text, V.SWITCHED_FROM_TO)
    return (F.when(with_target, let(
        _named(text, V.SWITCHED_FROM_TO, target=strip, new=strip),
        lambda m: build(m["target"])(m)))
        .when(matches(text, V.SWITCHED_TO), let(
            _named(text, V.SWITCHED_TO, new=strip), lambda m: build(F.lit(""))(m))))


def split_clauses(text: Column) -> Column:
    """List items separated by commas, 'and' or 'with'."""
    parts = F.transform(F.split(text, jvm(V.CLAUSE_SEPARATOR)), strip)
    return F.filter(parts, lambda p: p != "")


def clause_attribute(clause: Column) -> Column:
    """(attr, value) of a list item: 'X as Y', 'X for purpose', or routed by value."""
    as_role, for_purpose = matches(clause, V.AS_ROLE), matches(clause, V.FOR_PURPOSE)
    purpose = strip(group(clause, V.FOR_PURPOSE, "purpose"))
    known = purpose_attribute(purpose)
    attr = (F.when(as_role, slugify(strip(group(clause, V.AS_ROLE, "role"))))
            .when(for_purpose, F.coalesce(known, slugify(purpose)))
            .otherwise(value_attribute(clause)))
    value = (F.when(as_role, strip(group(clause, V.AS_ROLE, "value")))
             .when(for_purpose, strip(group(clause, V.FOR_PURPOSE, "value")))
             .otherwise(strip(clause)))
    return _parts(attr=attr, value=value)


def item_fact(clause: Column, subject: Column, raw: Column) -> Column:
    """Decision for one item of a uses-list."""
    scope = user_or_project(subject)
    return let(clause_attribute(clause), lambda c: fact(
        subject, c["attr"], clean_value(c["value"]), "decision", raw,
        scoped_key(scope, c["attr"]), scope))


# --- statements: the units a rule is tried on --------------------------------

STATEMENT_TYPE = "struct<s:int,rank:int,kind:string,text:string,subject:string,raw:string>"
FOUND_TYPE = f"struct<s:int,f:{FACT_TYPE}>"
FALLBACK = -1


def statement(s, rank, kind, text, subject=None, raw=None) -> Column:
    return F.struct(
        F.lit(s).cast("int").alias("s"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
        text.alias("text"), F.lit(subject).cast("string").alias("subject"),
        F.lit(raw).cast("string").alias("raw")).cast(STATEMENT_TYPE)


def statements(sentence: Column, index: Column) -> Column:
    """What to try on a sentence: an update, the items of a uses-list, the two halves of
    'A and I prefer B' (the whole only if neither half is a fact), or the whole."""
    whole = F.array_of([statement(index, 0, "plain", sentence)])

    def items(m):
        subject = F.when(F.lower(m["subject"]).isin(*V.PROJECT_PRONOUNS), "project").otherwise(
            m["subject"])
        return let(split_clauses(m["rest"]), lambda clauses: F.when(
            (subject != "") & ~is_invalid_key(subject) & (F.size(clauses) >= 2),
            F.transform(clauses, lambda c: statement(index, 0, "item", c, subject, sentence))))
    halves = F.array_of([
        statement(index, 0, "plain", strip(group(sentence, V.AND_I_PREFER, "first"))),
        statement(index, 0, "plain", F.concat(
            F.lit("I prefer "), strip(group(sentence, V.AND_I_PREFER, "second")))),
        statement(index, 1, "plain", sentence)])
    return (F.when(matches(sentence, V.SWITCHED_FROM_TO) | matches(sentence, V.SWITCHED_TO),
                   F.array_of([statement(index, 0, "switch", sentence)]))
            .otherwise(F.coalesce(
                F.when(matches(sentence, V.USES_LIST), let(
                    _named(sentence, V.USES_LIST, subject=strip, rest=strip), items)),
                F.when(matches(sentence, V.AND_I_PREFER), halves),
                whole)))


def facts_of_statements(units: Column) -> Column:
    """Facts found in order.  A rank-1 unit counts only if its sentence gave nothing so
    far, a fallback unit only if nothing was found at all."""
    none = F.array_of(()).cast(f"array<{FOUND_TYPE}>")

    def found(p):
        return (F.when(p["kind"] == "switch", switch_update(p["text"]))
                .when(p["kind"] == "item", item_fact(p["text"], p["subject"], p["raw"]))
                .otherwise(first_fact(p["text"])))

    def merge(acc, p):
        done = (((p["rank"] == 1) & F.exists(acc, lambda a: a["s"] == p["s"]))
                | ((p["s"] == FALLBACK) & (F.size(acc) > 0)))
        return F.when(done, acc).otherwise(let(found(p), lambda f: F.when(
            f.isNull(), acc).otherwise(F.array_append(
                acc, F.struct(p["s"].alias("s"), f.alias("f")).cast(FOUND_TYPE)))))
    return F.aggregate(units, none, merge)


def first_per_key(facts: Column) -> Column:
    """Keep the first fact of every key; updates are always kept and claim no key."""
    return let(F.transform(facts, lambda f, i: F.struct(i.alias("i"), f.alias("f"))),
               lambda indexed: F.transform(F.filter(indexed, lambda x: (
                   x["f"]["is_update"] | ~F.exists(indexed, lambda y: (
                       (y["i"] < x["i"]) & ~y["f"]["is_update"]
                       & (y["f"]["key"] == x["f"]["key"]))))), lambda x: x["f"]))


def split_sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, V.SENTENCE_GAP), strip)
    return F.filter(parts, lambda p: p != "")


def split_by_boundary(text: Column) -> Column:
    """Sentences, and clauses split at contrast or first-person joins."""
    parts = F.transform(F.split(text, jvm(V.CLAUSE_GAP)), strip)
    return F.filter(parts, lambda p: p != "")


# --- text and topic of a fact ----------------------------------------------

def fact_content(attribute: Column, value: Column, mtype: Column) -> Column:
    title = F.when(F.coalesce(attribute, F.lit("")) == "", F.lit("Item")).otherwise(
        capitalize_first(F.translate(attribute, "_", " ")))
    return (F.when(mtype == "preference", value)
            .when(attribute == "project", F.concat(F.lit("Project: "), value))
            .otherwise(F.concat(title, F.lit(": "), value)))


def fact_topic(entity: Column, attribute: Column, value: Column, mtype: Column,
               key: Column, scope: Column) -> Column:
    own_scope = F.coalesce(scope, user_or_project(entity, "user", "my"))
    preferred = let(american_spelling(attribute), lambda spelled: F.when(
        (spelled != "") & (spelled != "preference"), F.concat("preference:", slugify(spelled)))
        .otherwise(preference_topic(value, preference_domain(value))))
    return (F.when(mtype == "preference", preferred)
            .when(attribute == "project", F.lit("project.name"))
            .otherwise(F.coalesce(key, scoped_key(own_scope, attribute))))


# --- corrections, revocations, labels --------------------------------------

def strip_correction_prefix(text: Column) -> tuple[Column, Column]:
    had = matches(text, V.CORRECTION_PREFIX)
    return F.when(had, strip(remove(text, V.CORRECTION_PREFIX))).otherwise(text), had


def parse_correction(text: Column) -> Column:
    """First of five templates -> struct(target, old_value, new_value)."""
    def one(pattern):
        old = (clean_value(group(text, pattern, "old")) if "<old>" in pattern else F.lit(""))
        return F.when(matches(text, pattern), F.struct(
            clean_value(group(text, pattern, "target")).alias("target"),
            old.alias("old_value"),
            clean_value(group(text, pattern, "new")).alias("new_value")))
    return F.when(let(F.lower(text), lambda t: holds(t, "changed", "instead")),
                  F.coalesce(*[one(p) for p in V.CORRECTIONS]))


def parse_revocation(text: Column) -> Column:
    """First of five templates with a target -> struct(target, value)."""
    def target_of(t):
        return F.coalesce(*[
            F.when(strip(group(t, p, "target")) != "", strip(group(t, p, "target")))
            for p in V.REVOCATIONS])

    def value_of(t, target):
        found = F.regexp_extract_all(t, jvm(V.REVOKED_VALUE), 1)
        own = words(F.lower(target), "[a-z0-9]+")
        useful = F.filter(F.transform(found, clean_value), lambda v: (
            ~F.lower(v).isin(*V.REVOCATION_COMMON_WORDS)
            & ~F.array_contains(own, F.lower(v))))
        return F.coalesce(F.try_element_at(useful, 1), F.lit(""))

    def build(t):
        said = let(F.lower(t), lambda low: holds(
            low, "reset", "ignore", "valid", "revoked", "forget"))
        return F.when(said, let(target_of(t), lambda target: F.when(
            target.isNotNull(), F.struct(clean_value(target).alias("target"),
                                         value_of(t, target).alias("value")))))
    return let(strip(text), build)


def parse_label(text: Column) -> tuple[Column, Column]:
    """'[label] body' or 'label: body' -> (type or null, body)."""
    pattern = "(?s)" + V.LABEL_PREFIX
    bracket, label = group(text, pattern, "bracket"), group(text, pattern, "label")
    name = F.lower(strip(F.when(bracket != "", bracket).otherwise(label)))
    return lookup(name, V.LABEL_TYPES), strip(group(text, pattern, "body"))


def topic_from_content(content: Column, mtype: Column) -> Column:
    """Topic of an unstructured statement."""
    decision = dict(V.TYPED_STATEMENTS)["decision"]
    tokens = words(F.lower(content), "[a-z0-9]+")
    head = F.slice(F.filter(tokens, lambda t: ~t.isin(*V.TOPIC_STOPWORDS)), 1, 3)

    def of_body(body):
        purpose = group(body, V.FOR_PURPOSE, "purpose")
        return slugify(F.when(purpose != "", purpose).otherwise(body))
    return let(strip(content), lambda text: (
        F.when(mtype == "preference", preference_topic(content, preference_domain(content)))
        .when(matches(text, V.KEY_VALUE), slugify(group(text, V.KEY_VALUE, "key")))
        .when(matches(text, decision), let(group(text, decision, "body"), of_body))
        .otherwise(let(head, lambda h: F.when(
            F.size(h) == 0, slugify(F.substring(content, 1, 48)))
            .otherwise(F.concat(mtype, ":", F.array_join(h, "_")))))))


def typed_statement(text: Column) -> Column:
    """First of seven typed templates, then key = value -> struct(type, content)."""
    def one(name, pattern):
        body = strip(group(text, pattern, "body"))
        if name == "decision":
            body = capitalize_first(F.when(F.lower(body).startswith("use "), body).otherwise(
                F.concat(F.lit("Use "), body)))
        return F.when(matches(text, pattern), F.struct(
            F.lit(name).alias("type"), body.alias("content")))
    key, value = (strip(group(text, V.KEY_VALUE, g)) for g in ("key", "value"))
    pair = F.when(
        matches(text, V.KEY_VALUE) & ~value.endswith("?") & ~is_invalid_key(key),
        F.struct(F.when(matches(key, V.DECISION_KEY), "decision").otherwise("fact").alias("type"),
                 F.concat(key, F.lit(" = "), value).alias("content")))
    return F.coalesce(*[one(n, p) for n, p in V.TYPED_STATEMENTS], pair)
