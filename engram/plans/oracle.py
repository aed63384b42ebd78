"""The same results as plain DuckDB SQL over the same tables, for checking.

Written against the RE2 regex dialect and plain windows, independently of the Spark
expressions; only fixed values (patterns, word lists) are shared.
"""

from __future__ import annotations

from engram.functions import fixed_values as V
from engram.functions.regex import group_index, unnamed
from engram.sources import tables as S


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def m(x: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({x}, {q(unnamed(pattern))}, '{flags}')"


def g(x: str, pattern: str, name) -> str:
    index = name if isinstance(name, int) else group_index(pattern, name)
    return f"regexp_extract({x}, {q(unnamed(pattern))}, {index}, 'i')"


def sub(x: str, pattern: str, to: str = "", flags: str = "ig") -> str:
    return f"regexp_replace({x}, {q(unnamed(pattern))}, {q(to)}, '{flags}')"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$")


def clean(x: str) -> str:
    return strip(sub(sub(strip(x), "^['\"`]+|['\"`]+$"), r"[.!?]+$"))


def slug(x: str) -> str:
    runs = f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
    return f"coalesce(nullif(array_to_string(list_slice({runs}, 1, 6), '_'), ''), 'item')"


def norm(x: str) -> str:
    """Normalised utterance; nfc differs from NFKC only in compatibility letters, which the
    test tables do not contain."""
    return strip(sub(sub(f"lower(nfc_normalize({x}))", r"[^\w\s+]+", " "), r"\s+", " "))


def low(x: str) -> str:
    n = norm(x)
    return (f"({n} = '' OR {n} IN {in_list(V.LOW_INFO_PHRASES)} OR "
            f"len(list_filter(string_split({n}, ' '), lambda w: NOT list_contains("
            f"{arr(V.LOW_INFO_PHRASES)}, w))) = 0)")


def question(x: str) -> str:
    t = strip(x)
    return ("(" + " OR ".join([
        m(t, V.QUESTION_TAIL), m(t, V.WH_AUX), m(t, V.WH_CONTRACTED), m(t, V.HOW_MODIFIER),
        f"({m(t, V.WH_NOUN_AUX)} AND NOT {m(t, V.WH_NOUN_PRONOUN)})",
        f"({m(t, V.INVERSION_AUX)} AND NOT {m(t, V.INVERSION_NEGATED)})",
        m(t, V.INVERSION_OTHER), m(t, V.INQUIRY_REQUEST),
        f"{norm(t)} IN {in_list(V.STANDALONE_QUESTION_WORDS)}"]) + ")")


def american(x: str) -> str:
    out = f"lower({x})"
    for a, b in V.SPELLINGS:
        out = sub(out, rf"\b{a}\b", b, "g")
    return out


def domain(choice: str, other: str = "''") -> str:
    text = american(f"{choice} || ' ' || {other}")
    found = f"regexp_extract_all({text}, '[a-z0-9+#.-]+')"
    branches = []
    for family, pieces, extra, name in V.PREFERENCE_DOMAINS:
        hit = [f"list_has_any({found}, {arr(family + extra)})"]
        hit += [f"contains({text}, {q(p)})" for p in pieces]
        branches.append(f"WHEN {' OR '.join(hit)} THEN {q(name)}")
    return "CASE " + " ".join(branches) + " ELSE 'preference' END"


def noise_value(x: str) -> str:
    bare = strip(sub(sub(f"lower({strip(x)})", r"^(?:a|an|the)\s+"), r"[.!?]+$"))
    found = f"regexp_extract_all({bare}, '[a-z0-9+#.-]+')"
    return (f"(len({found}) = 0 OR list_has_any({found}, {arr(V.INVALID_KEYS)}) OR "
            f"coalesce({found}[1] IN {in_list(V.DEMONSTRATIVES)}, false) OR "
            f"len(list_filter({found}, lambda w: NOT list_contains("
            f"{arr(V.PREFERENCE_NOISE_VALUES)}, w))) = 0)")


def route(x: str, table, otherwise: str) -> str:
    branches = " ".join(f"WHEN {m(f'lower({x})', p)} THEN {q(n)}" for n, p in table)
    return f"CASE {branches} ELSE {otherwise} END"


def invalid(x: str) -> str:
    return f"lower({x}) IN {in_list(V.INVALID_KEYS)}"


def cap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"


def lookup(x: str, table: dict) -> str:
    return f"CASE {x} " + " ".join(
        f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items()) + " END"


def tokens(x: str) -> str:
    t = strip(x)
    return (f"(CASE WHEN {t} = '' THEN 0 ELSE greatest(len(regexp_extract_all({t}, "
            f"'\\w+|[^\\w\\s]+')), CAST(floor(length({t}) / 3.8::DOUBLE + 0.5) AS BIGINT), 1) "
            f"END)")


def keyword_list(x: str) -> str:
    found = f"regexp_extract_all({american(x)}, '\\w+')"
    return (f"list_filter({found}, lambda w: length(w) > 2 AND NOT list_contains("
            f"{arr(V.KEYWORD_STOPWORDS)}, w))")


EVENTS_K = "(SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


def utterances() -> str:
    return (f"utt AS (SELECT user_id, event_id AS seq, ts, {S.ROLE} AS role, "
            f"{S.utterance_text()} AS content FROM {EVENTS_K})")


def gate(source: str) -> str:
    """Messages with their skip reason."""
    return f"""
gated AS (SELECT *, CASE WHEN role NOT IN ('user', 'assistant') THEN 'role'
    WHEN {low('content')} THEN 'low_info' WHEN {question('content')} THEN 'interrogative'
    WHEN {m('content', V.SPECULATIVE)} THEN 'speculative' END AS skip_reason FROM {source})"""


def pieces(source: str) -> str:
    """Statements to try per sentence of ``source`` (seq, x = text)."""
    switch = f"({m('x', V.SWITCHED_FROM_TO)} OR {m('x', V.SWITCHED_TO)})"
    subject = strip(g("x", V.USES_LIST, "subject"))
    rest = strip(g("x", V.USES_LIST, "rest"))
    clauses = (f"list_filter(list_transform(string_split({sub(rest, V.CLAUSE_SEPARATOR, chr(1))}"
               f", chr(1)), lambda c: {strip('c')}), lambda c: c <> '')")
    return f"""
cut AS (SELECT seq, unnest(string_split(regexp_replace(x,
        '([.;!?])\\s+([A-Z"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS y,
        generate_subscripts(string_split(regexp_replace(x,
        '([.;!?])\\s+([A-Z"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), 1) AS sidx
    FROM {source}),
sent AS (SELECT seq, sidx, x FROM (SELECT seq, sidx, {strip('y')} AS x FROM cut)
    WHERE x <> '' AND NOT {low('x')} AND NOT {question('x')}),
shaped AS (SELECT *, {switch} AS is_switch, CASE WHEN {m('x', V.USES_LIST)}
        THEN {subject} END AS subj0, CASE WHEN {m('x', V.USES_LIST)} THEN {clauses} END AS cl
    FROM sent),
listed AS (SELECT *, CASE WHEN lower(subj0) IN {in_list(V.PROJECT_PRONOUNS)} THEN 'project'
        ELSE subj0 END AS subj FROM shaped),
kinds AS (SELECT *, CASE WHEN is_switch THEN 'switch'
        WHEN subj <> '' AND NOT {invalid('subj')} AND len(cl) >= 2 THEN 'list'
        WHEN {m('x', V.AND_I_PREFER)} THEN 'halves' ELSE 'whole' END AS shape FROM listed),
piece AS (
    SELECT seq, sidx, 0 AS pidx, 0 AS prank, 'switch' AS kind, x AS p, '' AS subj, x AS raw
        FROM kinds WHERE shape = 'switch'
    UNION ALL SELECT seq, sidx, generate_subscripts(cl, 1), 0, 'item', unnest(cl), subj, x
        FROM kinds WHERE shape = 'list'
    UNION ALL SELECT seq, sidx, 0, 0, 'plain', {strip(g('x', V.AND_I_PREFER, 'first'))}, '', x
        FROM kinds WHERE shape = 'halves'
    UNION ALL SELECT seq, sidx, 1, 0, 'plain',
        'I prefer ' || {strip(g('x', V.AND_I_PREFER, 'second'))}, '', x
        FROM kinds WHERE shape = 'halves'
    UNION ALL SELECT seq, sidx, 2, 1, 'plain', x, '', x FROM kinds WHERE shape = 'halves'
    UNION ALL SELECT seq, sidx, 0, 0, 'plain', x, '', x FROM kinds WHERE shape = 'whole')"""


def hits(source: str, carry: str) -> str:
    """Facts of statements: ``source`` has kind, p (text), subj and the ``carry`` columns."""
    building = clean(g("p", V.BUILDING, "val"))
    called = g("bval", V.CALLED, "name")
    loc = clean(f"CASE WHEN {m('p', V.LIVES_IN)} THEN {g('p', V.LIVES_IN, 'val')} "
                f"ELSE {g('p', V.IS_FROM, 'val')} END")
    temporal = V.TRAILING_TEMPORAL
    fav = strip(sub(clean(g("p", V.FAVORITE_IS, "val")), temporal))
    aff = strip(sub(strip(sub(clean(g("p", V.AFFECT, "val")), temporal)),
                    r"^(?:a|an|the)\s+"))
    choice = clean(g("p", V.PREFERS, "choice"))
    is_as, is_for = m("p", V.AS_ROLE), m("p", V.FOR_PURPOSE)
    purpose = strip(g("p", V.FOR_PURPOSE, "purpose"))
    switch_new = strip(sub(
        f"CASE WHEN {m('p', V.SWITCHED_FROM_TO)} THEN {strip(g('p', V.SWITCHED_FROM_TO, 'new'))}"
        f" ELSE {strip(g('p', V.SWITCHED_TO, 'new'))} END", V.SWITCH_TAIL))
    sub_target = strip(g("p", V.SWITCHED_FROM_TO, "target"))
    words = "regexp_extract_all(lower({0}), '[a-z0-9+#.-]+')"
    up = strip(g("uval", V.FOR_PURPOSE, "purpose"))
    return f"""
grp AS (SELECT *, {building} AS bval, {loc} AS lval,
        {strip(g('p', V.POSSESSIVE, 'entity'))} AS pent, {strip(g('p', V.POSSESSIVE, 'attr'))}
        AS pattr, {clean(g('p', V.POSSESSIVE, 'val'))} AS pval,
        lower({g('p', V.FAVORITE_IS, 'kind')}) AS fkind,
        {slug(american(strip(g('p', V.FAVORITE_IS, 'attr'))))} AS fattr, {fav} AS fval,
        {choice} AS ch0, {clean(g('p', V.PREFERS, 'other'))} AS oth,
        {clean(g('p', V.PREFERS, 'than'))} AS tha,
        lower({g('p', V.AFFECT, 'negVerb')}) AS negv, lower({g('p', V.AFFECT, 'verb')}) AS verb,
        {aff} AS aval, {strip(g('p', V.USES, 'entity'))} AS uent0,
        {clean(g('p', V.USES, 'val'))} AS uval, {strip(g('p', V.THE_Y_IS_X, 'attr'))} AS yattr,
        {clean(g('p', V.THE_Y_IS_X, 'val'))} AS yval FROM {source}),
grp2 AS (SELECT *, CASE WHEN lower(ch0) LIKE 'use %' THEN {strip('substr(ch0, 5)')} ELSE ch0
        END AS ch, CASE WHEN oth <> '' THEN oth ELSE tha END AS other,
        CASE WHEN lower(uent0) LIKE 'the %' THEN {strip('substr(uent0, 5)')} ELSE uent0 END
        AS uent, {up} AS upur, CASE WHEN kind = 'item' THEN {strip(
            f"CASE WHEN {is_as} THEN {g('p', V.AS_ROLE, 'value')} WHEN {is_for} THEN "
            f"{g('p', V.FOR_PURPOSE, 'value')} ELSE p END")} END AS ival,
        CASE WHEN kind = 'switch' THEN {switch_new} END AS snew FROM grp),
ruled AS (SELECT *, CASE WHEN kind <> 'plain' THEN kind
    WHEN p = '' OR {question('p')} THEN NULL
    WHEN bval <> '' AND NOT {invalid('bval')} THEN 'building'
    WHEN lval <> '' AND NOT {invalid('lval')} THEN 'location'
    WHEN pent <> '' AND pattr <> '' AND pval <> '' AND NOT {invalid('pent')}
        AND NOT {invalid('pattr')} THEN 'possessive'
    WHEN {m('p', V.FAVORITE_IS)} AND NOT {invalid('fattr')} AND fval <> ''
        AND NOT {noise_value('fval')} THEN 'favorite'
    WHEN ch0 <> '' AND NOT {invalid('ch0')} THEN 'prefer'
    WHEN aval <> '' AND NOT {noise_value('aval')} THEN 'affect'
    WHEN uent0 <> '' AND uval <> '' AND NOT {invalid('uent0')} THEN 'uses'
    WHEN yattr <> '' AND yval <> '' AND NOT {invalid('yattr')} THEN 'y_is_x' END AS rule
    FROM grp2),
dom AS (SELECT *, CASE rule WHEN 'prefer' THEN {domain('ch', 'other')}
        WHEN 'affect' THEN {domain('aval')} END AS dm,
    CASE WHEN rule = 'uses' THEN
        CASE WHEN upur <> '' AND NOT {m('upur', V.PLACE_PURPOSE)} THEN 'purpose'
        WHEN {route('uval', V.VALUE_ATTRIBUTES, "'technology'")} <> 'technology' THEN 'value'
        WHEN list_has_any({words.format('uval')}, {arr(V.UI_WORDS)}) THEN 'ui'
        WHEN list_has_any({words.format('uval')}, {arr(V.FRONTEND_WORDS)}) THEN 'front'
        ELSE 'plain' END END AS uway,
    (negv <> '' OR verb IN ('hate', 'dislike')) AS neg FROM ruled WHERE rule IS NOT NULL),
att AS (SELECT *, CASE rule WHEN 'building' THEN 'project' WHEN 'location' THEN 'location'
    WHEN 'possessive' THEN pattr
    WHEN 'favorite' THEN CASE WHEN fkind = 'preferred' THEN 'preferred_' ELSE 'favorite_' END
        || fattr
    WHEN 'prefer' THEN dm
    WHEN 'affect' THEN CASE WHEN neg THEN 'disliked_' || CASE dm WHEN 'favorite_color' THEN
        'color' WHEN 'preference' THEN {slug('aval')} ELSE dm END
        WHEN dm = 'preference' THEN {slug('aval')} ELSE dm END
    WHEN 'uses' THEN CASE uway WHEN 'purpose' THEN coalesce({route(
        'upur', V.PURPOSE_ATTRIBUTES, 'NULL')}, {slug('upur')})
        WHEN 'value' THEN {route('uval', V.VALUE_ATTRIBUTES, "'technology'")}
        WHEN 'ui' THEN 'ui_library' WHEN 'front' THEN 'frontend'
        ELSE CASE WHEN list_has_any({words.format('uval')}, {arr(V.WORKFLOW_WORDS)})
            OR lower(uent) = 'team' THEN 'workflow' ELSE 'technology' END END
    WHEN 'y_is_x' THEN CASE WHEN lower({strip('p')}) LIKE 'my name%' THEN 'name' ELSE yattr END
    WHEN 'item' THEN CASE WHEN {is_as} THEN {slug(strip(g('p', V.AS_ROLE, 'role')))}
        WHEN {is_for} THEN coalesce({route(purpose, V.PURPOSE_ATTRIBUTES, 'NULL')},
            {slug(purpose)})
        ELSE {route('p', V.VALUE_ATTRIBUTES, "'technology'")} END
    WHEN 'switch' THEN {route('snew', V.SWITCH_VALUE_ATTRIBUTES, "'technology'")} END
    AS attribute,
    CASE rule WHEN 'building' THEN CASE WHEN {called} <> '' THEN {called} ELSE bval END
    WHEN 'location' THEN lval WHEN 'possessive' THEN pval WHEN 'favorite' THEN fval
    WHEN 'prefer' THEN ch WHEN 'affect' THEN aval WHEN 'uses' THEN uval WHEN 'y_is_x' THEN yval
    WHEN 'item' THEN {clean('ival')} WHEN 'switch' THEN snew END AS value,
    CASE rule WHEN 'building' THEN CASE WHEN {called} <> '' THEN {called} ELSE bval END
    WHEN 'possessive' THEN pent WHEN 'uses' THEN uent
    WHEN 'y_is_x' THEN CASE WHEN lower({strip('p')}) LIKE 'my name%' THEN 'user' ELSE yattr END
    WHEN 'item' THEN subj
    WHEN 'switch' THEN CASE WHEN {m('p', V.SWITCHED_FROM_TO)} AND NOT {m(
        sub_target, V.SWITCH_PRONOUN)} THEN {sub_target} ELSE 'project' END
    ELSE 'user' END AS entity FROM dom),
fact AS (SELECT {carry}, rule, entity, attribute, value, rule = 'switch' AS is_update,
    CASE WHEN rule IN ('building', 'location') THEN 'fact'
    WHEN rule = 'possessive' THEN CASE
        WHEN contains(lower(pattr), 'architecture') OR contains(lower(pattr), 'design')
            THEN 'architecture'
        WHEN contains(lower(pattr), 'goal') OR contains(lower(pattr), 'objective') THEN 'goal'
        ELSE 'fact' END
    WHEN rule IN ('favorite', 'prefer', 'affect') THEN 'preference'
    WHEN rule = 'uses' THEN CASE WHEN uway = 'plain' THEN 'fact' ELSE 'decision' END
    WHEN rule = 'y_is_x' THEN CASE WHEN {m('yattr', V.DECISION_ATTRIBUTE)} THEN 'decision'
        WHEN list_has_any({words.format('yattr')}, ['architecture', 'design'])
            THEN 'architecture'
        WHEN list_has_any({words.format('yattr')}, ['goal', 'objective']) THEN 'goal'
        WHEN list_has_any({words.format('yattr')}, ['preference', 'prefer']) THEN 'preference'
        ELSE 'fact' END
    ELSE 'decision' END AS type,
    CASE WHEN rule IN ('location', 'favorite', 'prefer', 'affect') THEN 'user'
    WHEN rule IN ('building', 'switch') THEN 'project'
    WHEN rule = 'uses' THEN CASE WHEN lower(uent) IN ('user', 'my') THEN 'user' ELSE 'project'
        END
    WHEN lower(entity) = 'user' THEN 'user' ELSE 'project' END AS scope,
    CASE rule WHEN 'prefer' THEN other ELSE '' END AS preferred_over FROM att),
keyed AS (SELECT *, CASE WHEN rule = 'building' THEN 'project.name'
    WHEN rule = 'location' THEN 'user.location'
    WHEN rule IN ('favorite', 'affect') THEN 'user.' || attribute
    WHEN rule = 'prefer' THEN 'user.preference.' || {slug('attribute')}
    ELSE scope || '.' || {slug('attribute')} END AS key FROM fact)"""


def content_of(attribute="attribute", value="value", kind="type") -> str:
    return (f"CASE WHEN {kind} = 'preference' THEN {value} WHEN {attribute} = 'project' THEN "
            f"'Project: ' || {value} ELSE {cap(f'replace({attribute}, ' + chr(39) + '_' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ')')} || ': ' || {value} END")


def topic_of() -> str:
    a = american("attribute")
    d = domain("value")
    return (f"CASE WHEN type = 'preference' THEN CASE WHEN {a} <> '' AND {a} <> 'preference' "
            f"THEN 'preference:' || {slug(a)} ELSE 'preference:' || CASE WHEN {d} = "
            f"'preference' THEN {slug('value')} ELSE {d} END END "
            f"WHEN attribute = 'project' THEN 'project.name' ELSE key END")


def facts_cte(source: str) -> str:
    """kept: the first fact per key of every message of ``source`` (seq, x)."""
    return (pieces(source) + "," + hits("piece", "seq, sidx, pidx, prank") + """,
firstrank AS (SELECT *, min(prank) OVER (PARTITION BY seq, sidx) AS lowest FROM keyed),
kept AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY sidx, pidx) - 1 AS pos FROM (
    SELECT *, row_number() OVER (PARTITION BY seq, key, is_update ORDER BY sidx, pidx) AS rk
    FROM firstrank WHERE prank = lowest) WHERE is_update OR rk = 1)""")


def correction_cols(x: str) -> str:
    def one(name):
        branches = []
        for p in V.CORRECTIONS:
            value = clean(g(x, p, name)) if f"<{name}>" in p else "''"
            branches.append(f"WHEN {m(x, p)} THEN {value}")
        return "CASE " + " ".join(branches) + " END"
    return f"{one('target')} AS c_target, {one('old')} AS c_old, {one('new')} AS c_new"


def revocation_cols(x: str) -> str:
    t = strip(x)
    target = "coalesce(" + ", ".join(
        f"nullif({strip(g(t, p, 'target'))}, '')" for p in V.REVOCATIONS) + ")"
    return f"{target} AS r_target0, regexp_extract_all({t}, {q(unnamed(V.REVOKED_VALUE))}, 1, 'i') AS r_found"


def parsed(source: str) -> str:
    """Eligible messages with correction prefix stripped, correction and revocation parsed."""
    had = m("content", V.CORRECTION_PREFIX)
    own = "regexp_extract_all(lower(r_target0), '[a-z0-9]+')"
    value = (f"list_filter(list_transform(r_found, lambda v: {clean('v')}), lambda v: NOT "
             f"list_contains({arr(V.REVOCATION_COMMON_WORDS)}, lower(v)) AND NOT "
             f"list_contains({own}, lower(v)))")
    return gate(source) + f""",
prefixed AS (SELECT *, {had} AS had_prefix, CASE WHEN {had} THEN {strip(sub(
        'content', V.CORRECTION_PREFIX))} ELSE content END AS x FROM gated
    WHERE skip_reason IS NULL),
parsed0 AS (SELECT *, {correction_cols('x')}, {revocation_cols('x')} FROM prefixed
    WHERE NOT {question('x')}),
parsed AS (SELECT * EXCLUDE (r_target0, r_found), {clean('r_target0')} AS r_target,
    coalesce({value}[1], '') AS r_value, r_target0 IS NOT NULL AS is_revocation,
    c_target IS NOT NULL AS is_corr FROM parsed0)"""


def candidates_cte(source: str = "utt") -> str:
    """cand: scored candidates of the core rules (labels are not used by the utterances)."""
    d = domain("c_new", "c_old")
    pref = f"lower(c_target) IN {in_list(V.CORRECTION_PREFERENCE_TARGETS)}"
    bare = (f"CASE WHEN {m('c_target', V.DECISION_ATTRIBUTE)} THEN 'decision' WHEN "
            f"contains(lower(c_target), 'prefer') THEN 'preference' ELSE 'fact' END")
    typed = " ".join(
        f"WHEN {m('tx', p)} THEN " + (
            f"struct_pack(t := {q(n)}, c := {strip(g('tx', p, 'body'))})" if n != "decision" else
            f"struct_pack(t := 'decision', c := {cap('dbody')})")
        for n, p in V.TYPED_STATEMENTS)
    decision = dict(V.TYPED_STATEMENTS)["decision"]
    dbody = strip(g("tx", decision, "body"))
    dtopic = g("s.c", decision, "body")
    head = (f"list_slice(list_filter(regexp_extract_all(lower(s.c), '[a-z0-9]+'), lambda w: NOT "
            f"list_contains({arr(V.TOPIC_STOPWORDS)}, w)), 1, 3)")
    importance = lookup("type", V.TYPE_IMPORTANCE)
    return parsed(source) + ",\n" + (
        "plainmsg AS (SELECT seq, x FROM parsed WHERE NOT is_revocation AND NOT is_corr),"
        + facts_cte("plainmsg")) + f""",
fc AS (SELECT k.seq, k.pos, {content_of()} AS cc, type, {topic_of()} AS topic_key, is_update,
    entity, attribute, value, scope, key, true AS has_fact, NULL::VARCHAR AS c_target,
    NULL::VARCHAR AS c_old, NULL::VARCHAR AS c_new, NULL::VARCHAR AS r_target,
    NULL::VARCHAR AS r_value FROM kept k),
corr0 AS (SELECT seq, c_target, c_old, c_new, {d} AS dm, {pref} AS pref, {bare} AS bare
    FROM parsed WHERE is_corr AND NOT is_revocation),
corr1 AS (SELECT *, CASE WHEN pref THEN 'preference' WHEN c_old = '' THEN bare
    WHEN dm IN {in_list(V.CORRECTION_DECISION_DOMAINS)} THEN 'decision' ELSE 'fact' END AS type,
    CASE WHEN pref THEN 'user' ELSE c_target END AS entity,
    CASE WHEN NOT pref AND c_old = '' THEN c_target ELSE dm END AS attribute, c_new AS value,
    NULL::VARCHAR AS scope, CASE WHEN pref THEN '' ELSE CASE WHEN lower(c_target) IN
    ('user', 'my') THEN 'user' ELSE 'project' END || '.' || {slug(
        "CASE WHEN c_old = '' THEN c_target ELSE dm END")} END AS key FROM corr0),
cc AS (SELECT seq, 0 AS pos, {content_of()} AS cc, type, CASE WHEN pref THEN 'preference:' ||
    CASE WHEN dm = 'preference' THEN {slug('c_new')} ELSE dm END ELSE {topic_of()} END
    AS topic_key, false AS is_update, entity, attribute, value, scope, NULL::VARCHAR AS key,
    true AS has_fact, c_target, c_old, c_new, NULL::VARCHAR AS r_target, NULL::VARCHAR AS r_value
    FROM corr1),
rc AS (SELECT seq, 0 AS pos, 'REVOKE: ' || r_target AS cc, 'fact' AS type,
    {q(V.REVOCATION_TOPIC)} AS topic_key, false AS is_update, NULL::VARCHAR AS entity,
    NULL::VARCHAR AS attribute, NULL::VARCHAR AS value, NULL::VARCHAR AS scope,
    NULL::VARCHAR AS key, false AS has_fact, NULL::VARCHAR AS c_target, NULL::VARCHAR AS c_old,
    NULL::VARCHAR AS c_new, r_target, r_value FROM parsed WHERE is_revocation AND role = 'user'),
rest0 AS (SELECT seq, {strip('x')} AS tx FROM parsed WHERE NOT is_revocation AND NOT is_corr
    AND role <> 'assistant' AND seq NOT IN (SELECT seq FROM kept)),
rest1 AS (SELECT *, CASE WHEN lower({dbody}) LIKE 'use %' THEN {dbody} ELSE 'Use ' || {dbody}
    END AS dbody FROM rest0),
rest2 AS (SELECT seq, CASE {typed} END AS s FROM rest1),
tc AS (SELECT seq, 0 AS pos, s.c AS cc, s.t AS type, CASE
    WHEN {m('s.c', V.KEY_VALUE)} THEN {slug(g('s.c', V.KEY_VALUE, 'key'))}
    WHEN {m('s.c', decision)} THEN {slug(
        f"CASE WHEN {m(dtopic, V.FOR_PURPOSE)} THEN {g(dtopic, V.FOR_PURPOSE, 'purpose')} "
        f"ELSE {dtopic} END")}
    WHEN len({head}) = 0 THEN {slug('substr(s.c, 1, 48)')}
    ELSE s.t || ':' || array_to_string({head}, '_') END AS topic_key, false AS is_update,
    NULL::VARCHAR AS entity, NULL::VARCHAR AS attribute, NULL::VARCHAR AS value,
    NULL::VARCHAR AS scope, NULL::VARCHAR AS key, false AS has_fact, NULL::VARCHAR AS c_target,
    NULL::VARCHAR AS c_old, NULL::VARCHAR AS c_new, NULL::VARCHAR AS r_target,
    NULL::VARCHAR AS r_value FROM rest2 WHERE s IS NOT NULL),
allc AS (SELECT * FROM fc UNION ALL SELECT * FROM cc UNION ALL SELECT * FROM rc
    UNION ALL SELECT * FROM tc),
auth AS (SELECT a.*, p.user_id, p.ts, p.role, p.content AS message,
    CASE WHEN a.r_target IS NOT NULL THEN 'user' WHEN a.c_target IS NULL AND role = 'assistant'
        AND a.type IN ('decision', 'constraint') THEN 'speculation' ELSE role END AS authority,
    CASE WHEN a.c_target IS NOT NULL THEN true WHEN a.r_target IS NOT NULL THEN false
        WHEN has_fact THEN {m('p.content', V.CORRECTION_MARKER)} OR is_update
        ELSE had_prefix OR {m('p.content', V.CORRECTION_MARKER)} END AS is_correction
    FROM allc a JOIN parsed p USING (seq)),
spec AS (SELECT *, {m('cc', V.SPECULATIVE)} OR authority = 'speculation' AS spec FROM auth),
cand AS (SELECT *, greatest(
    CASE WHEN spec THEN 0.55::DOUBLE WHEN authority = 'user' AND type = 'decision'
        THEN 0.95::DOUBLE WHEN authority = 'user' THEN 0.88::DOUBLE ELSE 0.7::DOUBLE END,
    CASE WHEN is_correction OR {m('cc', V.CORRECTION_MARKER)} THEN 0.92::DOUBLE ELSE 0 END,
    CASE WHEN {m('cc', V.DECISION_MARKER)} AND authority = 'user' AND NOT spec
        THEN 0.93::DOUBLE ELSE 0 END) AS confidence,
    CASE WHEN is_correction THEN greatest({importance}, 0.9)::DOUBLE
        ELSE ({importance})::DOUBLE END AS importance,
    CASE WHEN authority = 'user' AND NOT spec THEN 0.55::DOUBLE WHEN spec THEN 0.3::DOUBLE
        ELSE 0.35::DOUBLE END AS stability FROM spec)"""


def noise(x: str) -> str:
    n = strip(sub(sub(f"lower({x})", r"[^\w\s+]+", " "), r"\s+", " "))
    return (f"({n} = '' OR len(list_filter(string_split({n}, ' '), lambda w: NOT list_contains("
            f"{arr(V.NOISE_WORDS)}, w))) = 0)")


def routed_cte(source: str = "utt") -> str:
    pv = "CASE WHEN coalesce(value, '') <> '' THEN value ELSE cc END"
    kv = m(strip("cc"), V.KEY_VALUE_PLAIN)
    return candidates_cte(source) + f""",
routed AS (SELECT *, CASE WHEN {noise('cc')} THEN 'discard'
    WHEN type = 'preference' AND {noise_value(pv)} THEN 'discard'
    WHEN {m('cc', V.CONTEXT_MARKER)} THEN 'context'
    WHEN is_correction OR c_target IS NOT NULL OR r_target IS NOT NULL THEN 'store'
    WHEN type IN {in_list(V.DURABLE_TYPES)} THEN 'store'
    WHEN type IN ('active_task', 'temporary_state') THEN 'context' ELSE 'discard' END AS bucket,
    CASE WHEN has_fact THEN coalesce(nullif(entity, ''), 'project') ELSE 'project' END AS subject,
    CASE WHEN has_fact THEN coalesce(nullif(attribute, ''), 'attribute')
        WHEN {kv} THEN regexp_replace(lower({strip(g(strip('cc'), V.KEY_VALUE_PLAIN, 'key'))}),
            '\\s+', '_', 'g') ELSE type END AS predicate,
    CASE WHEN has_fact THEN coalesce(nullif(value, ''), cc)
        WHEN {kv} THEN {strip(g(strip('cc'), V.KEY_VALUE_PLAIN, 'value'))} ELSE cc END AS val,
    CASE WHEN has_fact THEN coalesce(scope, 'project') ELSE 'project' END AS item_scope,
    {route('cc', V.CONTEXT_KEYS, q(V.DEFAULT_CONTEXT_KEY))} AS context_key FROM cand)"""


def close_pairs_cte() -> str:
    """close(kind, l, r, sim): pairs of contents (kind: a type) or of an old value and a content
    (kind: '') with a similarity of 0.75 or more.

    The length of the longest common subsequence comes from one bit per character of the left
    text, which has 126 at most; a longer one makes the query fail."""
    one, full = "1::UHUGEINT", "((1::UHUGEINT << len(l)::UHUGEINT) - 1::UHUGEINT)"
    row = (f"list_reduce(list_prepend({full}, list_transform(string_split(r, ''), lambda c: "
           f"list_reduce(list_prepend(0::UHUGEINT, list_transform(range(len(l)), lambda i: "
           f"CASE WHEN l[i + 1] = c THEN {one} << i::UHUGEINT ELSE 0::UHUGEINT END)), "
           "lambda p, q: p | q))), lambda acc, hit: ((acc + (acc & hit)) | (acc - (acc & hit))) "
           f"& {full})")
    return f"""
mem_texts AS (SELECT DISTINCT type AS kind, lower({strip('cc')}) AS x FROM routed
    WHERE bucket = 'store' AND r_target IS NULL),
mem_olds AS (SELECT DISTINCT lower(trim(c_old)) AS x FROM routed
    WHERE bucket = 'store' AND coalesce(c_old, '') <> ''),
mem_pairs AS (SELECT a.kind, a.x AS l, b.x AS r FROM mem_texts a JOIN mem_texts b ON a.kind = b.kind
        AND 2 * least(len(a.x), len(b.x)) >= 0.75 * (len(a.x) + len(b.x))
    UNION ALL SELECT DISTINCT '', o.x, t.x FROM mem_olds o JOIN mem_texts t
        ON 2 * least(len(o.x), len(t.x)) >= 0.75 * (len(o.x) + len(t.x))),
mem_measured AS (SELECT kind, l, r, CASE WHEN l = r THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (len(l)
    - bit_count(({row})::HUGEINT)) / (len(l) + len(r)) END AS sim FROM mem_pairs),
mem_close AS (SELECT * FROM mem_measured WHERE sim >= 0.75)"""


def memory_cte() -> str:
    """final: the version history of the utterances, by applying one candidate after the other.

    walk holds the active items of every user after each candidate; `born` is the number of the
    candidate that made an item."""
    words = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
    may = ("(NOT (authority = 'speculation' AND (({0}.type = 'decision' AND {0}.conf >= 0.85) "
           "OR {0}.conf >= confidence)) AND NOT ({0}.type = 'decision' AND type <> 'decision' "
           "AND NOT is_correction AND authority <> 'user'))")
    item = ("STRUCT(born BIGINT, type VARCHAR, topic VARCHAR, lc VARCHAR, st VARCHAR, "
            "conf DOUBLE, ver BIGINT)")
    fresh = ("{'born': rn, 'type': type, 'topic': topic_key, 'lc': lower(cc), 'st': st, "
             "'conf': confidence, 'ver': CASE WHEN act IN ('correct', 'replace') "
             "THEN target.ver + 1 ELSE 1 END}")
    return routed_cte() + "," + close_pairs_cte() + f""",
mem_near AS (SELECT kind, l, list(r) AS near75, list(r) FILTER (sim >= 0.9) AS near90,
    list(r) FILTER (sim >= 0.92) AS near92 FROM mem_close WHERE kind <> '' GROUP BY kind, l),
mem_like_old AS (SELECT l AS old, map(list(r), list(sim)) AS sims FROM mem_close WHERE kind = ''
    GROUP BY l),
mem_steps AS MATERIALIZED (SELECT r.*, lower({strip('cc')}) AS st, row_number() OVER (
        PARTITION BY user_id ORDER BY seq, pos) AS rn, lower(trim(coalesce(c_old, ''))) AS old,
    {words.format("coalesce(r_target, '')")} AS r_words,
    lower(trim(coalesce(r_value, ''))) AS r_needle FROM routed r WHERE bucket = 'store'),
mem_cands AS MATERIALIZED (SELECT s.user_id, rn, type, topic_key, cc, st, authority, is_correction,
    confidence, s.old, r_target IS NOT NULL AS revokes, r_words, r_needle,
    coalesce(near75, []) AS near75, coalesce(near90, []) AS near90, coalesce(near92, []) AS near92,
    coalesce(sims, map([], [])) AS sims
    FROM mem_steps s LEFT JOIN mem_near n ON n.kind = s.type AND n.l = s.st
    LEFT JOIN mem_like_old o ON o.old = s.old),
mem_walk AS (
  SELECT user_id, 0::BIGINT AS rn, []::{item}[] AS items, '' AS act, NULL::{item} AS target,
      []::BIGINT[] AS gone, 0.0::DOUBLE AS gain FROM (SELECT DISTINCT user_id FROM mem_cands)
  UNION ALL
  SELECT user_id, rn, CASE act
      WHEN 'revoke' THEN list_filter(items, lambda i: NOT list_contains(gone, i.born))
      WHEN 'merge' THEN list_transform(items, lambda i: CASE WHEN i.born = target.born THEN
          struct_update(i, conf := greatest(i.conf, confidence)) ELSE i END)
      WHEN 'create' THEN list_append(items, {fresh})
      WHEN 'correct' THEN list_append(list_filter(items, lambda i: i.born <> target.born), {fresh})
      WHEN 'replace' THEN list_append(list_filter(items, lambda i: i.born <> target.born), {fresh})
      ELSE items END, act, target, gone, gain
  FROM (SELECT *, CASE act WHEN 'correct' THEN held WHEN 'merge' THEN twin
          WHEN 'replace' THEN same WHEN 'reject' THEN same END AS target
    FROM (SELECT *, CASE WHEN revokes THEN CASE WHEN len(gone) > 0 THEN 'revoke' ELSE 'skip' END
          WHEN held IS NOT NULL AND {may.format('held')} THEN 'correct'
          WHEN twin IS NOT NULL THEN 'merge'
          WHEN same IS NOT NULL THEN CASE WHEN {may.format('same')} THEN 'replace'
              ELSE 'reject' END ELSE 'create' END AS act
      FROM (SELECT c.*, w.items,
          CASE WHEN revokes THEN list_transform(list_filter(w.items, lambda i: list_has_any(
              c.r_words, {words.format("i.lc || ' ' || i.topic")}) OR (c.r_needle <> ''
              AND contains(i.lc, c.r_needle))), lambda i: i.born) ELSE [] END AS gone,
          CASE WHEN c.old = '' THEN NULL ELSE coalesce(
              list_filter(w.items, lambda i: contains(i.lc, c.old))[1],
              list_filter(w.items, lambda i: coalesce(c.sims[i.st], 0) >= 0.75 AND c.sims[i.st]
                  = list_max(list_transform(w.items, lambda j: coalesce(c.sims[j.st], 0))))[1])
              END AS held,
          list_filter(w.items, lambda i: i.type = c.type AND list_contains(c.near90, i.st))[1]
              AS twin,
          list_filter(w.items, lambda i: i.type = c.type AND i.topic = c.topic_key)[1] AS same,
          CASE WHEN len(list_filter(w.items, lambda i: i.type = c.type)) = 0 THEN 0.85
              WHEN len(list_filter(w.items, lambda i: i.type = c.type
                  AND list_contains(c.near92, i.st))) > 0 THEN 0.05
              WHEN len(list_filter(w.items, lambda i: i.type = c.type
                  AND list_contains(c.near75, i.st))) > 0 THEN 0.25 ELSE 0.8 END::DOUBLE AS gain
        FROM mem_walk w JOIN mem_cands c ON c.user_id = w.user_id AND c.rn = w.rn + 1)))),
mem_log AS MATERIALIZED (SELECT user_id, rn, act, target.born AS target, target.ver AS target_ver,
    gone, gain FROM mem_walk WHERE rn > 0),
mem_told AS (SELECT l.*, s.* EXCLUDE (user_id, rn), CASE WHEN act = 'merge' THEN target ELSE l.rn END
    AS born FROM mem_log l JOIN mem_steps s USING (user_id, rn)
    WHERE act IN ('create', 'correct', 'replace', 'merge')),
mem_merged AS (SELECT *, row_number() OVER (PARTITION BY user_id, born ORDER BY rn) - 1 AS nth
    FROM mem_told),
mem_over AS (SELECT user_id, target AS born, rn, 'superseded' AS end_status FROM mem_log
    WHERE act IN ('correct', 'replace')
    UNION ALL SELECT user_id, unnest(gone), rn, 'revoked' FROM mem_log),
mem_ends AS (SELECT o.user_id, o.born, o.end_status, s.seq AS ended_seq, (s.seq, s.pos) AS ended_at
    FROM mem_over o JOIN mem_steps s USING (user_id, rn)),
mem_made AS (SELECT user_id, born, arg_min(type, rn) AS type, arg_min(topic_key, rn) AS topic_key,
    arg_min(cc, rn) AS content, arg_min(st, rn) AS state, arg_min(authority, rn) AS authority,
    arg_min(is_correction, rn) AS is_correction, first(c_target ORDER BY rn) AS c_target,
    first(c_old ORDER BY rn) AS c_old, first(c_new ORDER BY rn) AS c_new,
    arg_max(subject, rn) FILTER (subject <> '') AS subject,
    arg_max(predicate, rn) FILTER (predicate <> '') AS predicate,
    arg_max(val, rn) FILTER (val <> '') AS value,
    arg_max(item_scope, rn) FILTER (item_scope <> '') AS scope, max(confidence) AS confidence,
    max(importance) AS importance, max(stability - 0.08 * nth + CASE WHEN nth = 0 THEN 0
        ELSE 0.08 END) AS sm, max(nth) AS last_nth, count(*) AS source_count,
    arg_max(gain, rn) AS information_gain, min(seq) AS started_seq, min((seq, pos)) AS s_at,
    max(seq) AS updated_seq, arg_min(CASE WHEN act = 'create' THEN 1 ELSE target_ver + 1 END, rn)
    AS version, first(CASE WHEN act IN ('correct', 'replace') THEN target END ORDER BY rn)
    AS old_born FROM mem_merged GROUP BY user_id, born),
mem_numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id, type, topic_key ORDER BY born)
    AS segment FROM mem_made),
mem_named AS (SELECT *, md5(concat_ws('|', user_id, type, topic_key, segment)) AS item_id
    FROM mem_numbered),
final AS (SELECT n.* EXCLUDE (version), n.version::BIGINT AS version, round(least(1, n.sm + 0.08 *
    n.last_nth), 6) AS stability, e.ended_seq, e.ended_at, e.end_status,
    o.item_id AS supersedes_id FROM mem_named n
    LEFT JOIN mem_ends e ON e.user_id = n.user_id AND e.born = n.born
    LEFT JOIN mem_named o ON o.user_id = n.user_id AND o.born = n.old_born),
items AS (SELECT *, coalesce(end_status, 'active') AS status FROM final)"""
