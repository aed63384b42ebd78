"""Retrieval: filters, ranking, keyword search, links, tiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import fixed_values as V
from engram.functions import sql as X
from engram.functions.classify import wants_history
from engram.functions.sql import Expr, col
from engram.functions.text import keywords, ranked_keywords
from engram.operators.substrings import containment, text_id
from engram.session import written

SEARCHED = ("content", "value", "predicate", "subject", "topic_key")
ORDERS = {"recency": "updated_seq", "importance": "importance", "confidence": "confidence"}


@dataclass(frozen=True)
class Query:
    """Conjunctive filters over memory items; None = no condition."""
    subject: str | None = None
    predicate: str | None = None
    scope: str | None = None
    statuses: tuple[str, ...] = ("active",)
    include_historical: bool = False
    keyword: str | None = None
    keywords: tuple[str, ...] = ()
    min_confidence: float | None = None
    min_importance: float | None = None
    min_stability: float | None = None
    since_seq: int | None = None
    order: str = "recency"
    limit: int = V.DEFAULT_RETRIEVE_LIMIT


def _contains(names, word: str) -> Column:
    hit = F.lit(False)
    for n in names:
        hit = hit | F.lower(F.coalesce(F.col(n), F.lit(""))).contains(word.lower())
    return hit


def top_per_user(items: DataFrame, order: str, limit: int) -> DataFrame:
    """First ``limit`` items per user by the order, newest and id as tiebreaks."""
    w = Window.partitionBy("user_id").orderBy(
        F.col(ORDERS[order]).desc(), F.col("updated_seq").desc(), F.col("item_id"))
    return items.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def retrieve(items: DataFrame, query: Query) -> DataFrame:
    """The query for every user at once; adds rank and current."""
    out = items
    for name in ("subject", "predicate", "scope"):
        wanted = getattr(query, name)
        if wanted:
            out = out.filter(F.col(name) == wanted)
    for name in ("confidence", "importance", "stability"):
        least = getattr(query, f"min_{name}")
        if least is not None:
            out = out.filter(F.col(name) >= least)
    if not query.include_historical:
        out = out.filter(F.col("status").isin(*query.statuses))
    if query.keyword:
        out = out.filter(_contains(("content", "value", "predicate"), query.keyword.strip()))
    terms = [k.strip() for k in query.keywords if len(k.strip()) > 1]
    if terms:
        hit = F.lit(False)
        for t in terms:
            hit = hit | _contains(SEARCHED, t)
        out = out.filter(hit)
    if query.since_seq is not None:
        out = out.filter(F.col("updated_seq") >= query.since_seq)
    return top_per_user(out, query.order, query.limit).withColumn(
        "current", F.col("status") == "active")


def search(rows: DataFrame, text: str, needle: str, order: str,
           limit: int = V.SEARCH_LIMIT) -> DataFrame:
    """Substring search per user, first ``limit`` hits in order, score 1."""
    w = Window.partitionBy("user_id").orderBy(order)
    return (rows.filter(F.col(text).contains(needle.strip()))
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
            .withColumn("score", F.lit(1.0)))


def link_edges(items: DataFrame) -> DataFrame:
    """Links between items: what an item superseded, contradicted or is related to."""
    kinds = [c for c in ("supersedes_id", "contradicts_id", "related_id") if c in items.columns]
    edges = None
    for k in kinds:
        e = items.filter(F.col(k).isNotNull()).select(
            "user_id", F.col("item_id").alias("src_id"), F.col(k).alias("dst_id"))
        edges = e if edges is None else edges.unionByName(e)
    return edges.distinct()


def expand_relations(items: DataFrame, seeds: DataFrame, depth: int = 1,
                     active_only: bool = True) -> DataFrame:
    """Items linked from the seeds within ``depth`` hops, seeds excluded, with the hop.

    Each hop is an equi-join of the frontier with the edges, minus what was seen, so
    cycles end."""
    edges = link_edges(items)
    reachable = items.filter("status = 'active'") if active_only else items
    keys = ["user_id", "item_id"]
    seen = seeds.select(*keys).distinct()
    frontier, found = seen, None
    for hop in range(1, depth + 1):
        step = (frontier.withColumnRenamed("item_id", "src_id").join(edges, ["user_id", "src_id"])
                .select("user_id", F.col("dst_id").alias("item_id")).distinct()
                .join(seen, keys, "left_anti")
                .join(reachable.select(*keys), keys, "left_semi"))
        found = (step.withColumn("hop", F.lit(hop)) if found is None
                 else found.unionByName(step.withColumn("hop", F.lit(hop))))
        seen, frontier = seen.unionByName(step), step
    return items.join(found, keys)


def request_keywords(requests: DataFrame) -> DataFrame:
    """Adds query_words, the ranked keywords and the wants-history flag of each request."""
    text = X.coalesce(col("latest_user_text"), "")
    rows = requests.selectExpr("*", str(keywords(text).alias("query_words")),
                               str(wants_history(text).alias("wants_history")))
    return rows.selectExpr("*", str(ranked_keywords(col("query_words")).alias("ranked_words")))


def _places(items: DataFrame) -> DataFrame:
    """Items by number as a stored table: user_id, item_id, nth (1 = the user's newest), what
    choosing reads.

    ``topic`` is the smallest nth of the user's items of that topic, a blank topic its own.
    Numbers stand for items wherever rows multiply by requests."""
    newest = Window.partitionBy("user_id").orderBy(F.col("updated_seq").desc(), "item_id")
    topic = F.trim(F.coalesce("topic_key", F.lit("")))
    numbered = items.select(
        "user_id", "item_id", F.row_number().over(newest).alias("nth"), "version",
        (F.col("status") == "active").alias("active"),
        (F.col("status") == "superseded").alias("superseded"),
        ((F.col("scope") == "user") & F.col("type").isin(
            "fact", "preference", "constraint")).alias("durable"),
        (F.col("scope") == "user").alias("own"), topic.alias("_t"),
        F.lower(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in SEARCHED]))
        .alias("text"))
    same = Window.partitionBy("user_id", "_t")
    return written(numbered.withColumn("topic", F.when(F.col("_t") == "", F.col("nth")).otherwise(
        F.min("nth").over(same))).drop("_t"))


def _with_links(places: DataFrame, items: DataFrame) -> DataFrame:
    """user_id, FACTS and ``links``, the FACTS of the items that an item links to."""
    ends = places.select("user_id", F.col("item_id").alias("dst_id"),
                         F.struct(*FACTS).alias("_end"))
    # An item links to one other per kind of link at most.
    links = link_edges(items).join(ends, ["user_id", "dst_id"]).groupBy(
        "user_id", F.col("src_id").alias("item_id")).agg(F.collect_set("_end").alias("links"))
    return places.select("user_id", "item_id", *FACTS).join(
        links, ["user_id", "item_id"], "left").withColumn("links", F.coalesce(
            "links", F.array().cast(dict(links.dtypes)["links"])))


FACTS = ("nth", "topic", "version", "active", "superseded")
#: Items of a user that travel to the requests in one row.
CHUNK = 32


def _tiers(requests: DataFrame, places: DataFrame, *carried: str) -> DataFrame:
    """request_id, user_id, carried and ``_i``, the nth and tier of what fetch_tiers() gives."""
    active = places.filter("active")
    asked = requests.select("request_id", "user_id", F.explode("ranked_words").alias("needle"))
    found = containment(active.select("user_id", "text"),
                        asked.select("user_id", "needle"), ["user_id"])
    newest = Window.partitionBy("user_id", "needle").orderBy("nth")
    hits = (found.drop("text").join(
        active.select("user_id", "nth", text_id("text").alias("text_id")), ["user_id", "text_id"])
        .withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= V.KEYWORD_HITS)
        .groupBy("user_id", "needle").agg(F.collect_list("nth").alias("_hits")))
    none = F.array().cast("array<int>")
    named = asked.join(hits, ["user_id", "needle"]).select("request_id", "user_id", "_hits")
    # A request has 12 keywords at most, a keyword 40 items.
    first = requests.select("request_id", "user_id", none.alias("_hits")).unionByName(
        named).groupBy("request_id", "user_id").agg(F.slice(F.array_sort(F.array_distinct(
            F.flatten(F.collect_list("_hits")))), 1, V.KEYWORD_HITS).alias("_hits"))

    def newest_of(rows, limit, kept=F.lit(True)):
        w = Window.partitionBy("user_id").orderBy("nth")
        return rows.withColumn("_r", F.row_number().over(w)).filter(
            F.col("_r") <= limit).filter(kept).groupBy("user_id").agg(
            F.array_sort(F.collect_list("nth")).alias("_n"))
    known = newest_of(active, V.KEYWORD_HITS).withColumnRenamed("_n", "_recent").join(
        newest_of(active.filter("own"), V.DURABLE_HITS, F.col("durable")).withColumnRenamed(
            "_n", "_durable"), "user_id", "left")
    wordless = requests.select("request_id", "user_id", *carried,
                               (F.size("ranked_words") == 0).alias("_wordless"))
    rows = wordless.join(first, ["request_id", "user_id"]).join(known, "user_id")
    # Requests without any keyword take the newest items, as an unfiltered query would.
    rows = rows.withColumn("_1", F.when(F.col("_wordless"), F.col("_recent")).otherwise(
        F.col("_hits")))
    rows = rows.withColumn("_2", F.when(F.size("_1") < V.SPARSE_HITS, F.array_except(
        F.slice("_recent", 1, V.RECENT_HITS), "_1")).otherwise(none))
    rows = rows.withColumn("_3", F.array_except(
        F.coalesce("_durable", none), F.concat("_1", "_2")))

    def tier(n):
        return F.transform(f"_{n}", lambda i: F.struct(i.alias("nth"), F.lit(n).alias("tier")))
    return rows.select("request_id", "user_id", *carried,
                       F.concat(tier(1), tier(2), tier(3)).alias("_i"))


def fetch_tiers(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Active items for every request in three tiers, one row per (request, item).

    1. up to 40 newest that contain one of 12 keywords; 2. the 20 newest of the user when
    fewer than 4 hit; 3. user-scope facts, preferences and constraints among the user's 40
    newest user-scope items.  ``requests``: request_id, user_id, ranked_words.

    Tier 1 runs on distinct (user, keyword) pairs and keeps the 40 newest of each, which
    include the 40 newest of any union, so a user with many requests costs no more.  A request
    is one row until its tiers are known.
    """
    places = _places(items)
    return _tiers(requests, places).select("request_id", "user_id", F.explode("_i").alias("_i")).select(
        "request_id", "user_id", "_i.*").join(
        places.select("user_id", "nth", "item_id"), ["user_id", "nth"]).select(
        "request_id", "user_id", "item_id", "tier")


def _part(nth) -> str:
    return f"int(({nth} - 1) div {CHUNK})"


def _by_parts(rows: DataFrame, items: str) -> DataFrame:
    """A row for each part of the user's items that the array names, with those of the part."""
    return rows.withColumn("_part", F.explode(F.expr(
        f"array_distinct(transform({items}, i -> {_part('i.nth')}))"))).withColumn(
        items, F.expr(f"filter({items}, i -> {_part('i.nth')} = _part)"))


def _in_parts(items: DataFrame, name: str, *columns: str) -> DataFrame:
    """user_id, _part and a map from nth to the columns, a part of a user's items in a row."""
    return items.groupBy("user_id", F.expr(_part("nth")).alias("_part")).agg(
        F.map_from_entries(F.collect_list(F.struct("nth", F.struct(*columns)))).alias(name))


def _first_of(rows: Expr, field: str, also=None) -> Expr:
    """Of sorted rows the first of every value of the field, and those that are kept as well."""
    def kept(x, i):
        first = Expr(f"(NOT (get({rows}, {i} - 1).`{field}` <=> {x[field]}))")
        return first if also is None else first | also(x)
    return X.lambda_call("filter", rows, kept, arity=2)


def _one_per_topic(found: Expr) -> Expr:
    """nth and tier of what a request keeps, in order, of the array ``found``: nth, tier, topic,
    idle, older, superseded."""
    def limited(sorted_):
        once = _first_of(sorted_, "nth")
        return X.let(once, lambda rows: X.concat(
            X.filter(rows, lambda x: x["tier"] < 4),
            X.slice(X.filter(rows, lambda x: x["tier"] == 4), 1, V.EXPANSION_LIMIT)))

    def best(rows):
        by_topic = X.array_sort(X.transform(rows, lambda x: X.struct(*[
            x[n].alias(n) for n in ("topic", "idle", "older", "nth", "tier", "superseded")])))
        return X.let(by_topic, lambda b: _first_of(
            b, "topic", lambda x: col("wants_history") & x["superseded"]))
    # Sorted by nth and tier: a linked item that was fetched as well keeps its tier.
    kept = X.let(X.let(X.array_sort(found), limited), best)
    return X.array_sort(X.transform(kept, lambda x: X.struct(
        x["tier"].alias("tier"), x["nth"].alias("nth"))))


def _choice(requests: DataFrame, items: DataFrame) -> DataFrame:
    """request_id, user_id and ``_sought``: nth, tier and rank of what a request keeps.

    A request's items, 100 fetched ones and what those link to, are one array throughout."""
    places = _places(items)
    known = _in_parts(_with_links(places, items), "_facts", *FACTS[1:], "links")
    met = _by_parts(_tiers(requests, places, "wants_history"), "_i").join(
        known, ["user_id", "_part"])

    def place(nth, tier, of):
        return X.struct(nth.alias("nth"), X.lit(tier).alias("tier"), of["topic"].alias("topic"),
                        (~of["active"]).alias("idle"), (-of["version"]).alias("older"),
                        of["superseded"].alias("superseded"))

    def found(i):
        linked = X.filter(i["f"]["links"], lambda e: col("wants_history") | e["active"])
        return X.concat(X.array_of([place(i["nth"], i["tier"], i["f"])]),
                        X.transform(linked, lambda e: place(e["nth"], 4, e)))
    looked_up = X.transform(col("_i"), lambda i: X.struct(
        i["nth"].alias("nth"), i["tier"].alias("tier"),
        X.element_at(col("_facts"), i["nth"]).alias("f")))
    rows = met.selectExpr("request_id", "user_id", "wants_history", str(
        X.flatten(X.transform(looked_up, found)).alias("_f"))).repartition("request_id").groupBy(
        "request_id").agg(F.first("user_id").alias("user_id"), F.first("wants_history").alias(
            "wants_history"), F.flatten(F.collect_list("_f")).alias("_f"))
    # Blank topics stand alone; others keep the active, newest version of the request.
    kept = X.lambda_call("transform", _one_per_topic(col("_f")), lambda x, i: X.struct(
        x["nth"].alias("nth"), x["tier"].alias("tier"), Expr(f"int({i} + 1) AS `_rank`")), arity=2)
    return rows.selectExpr("request_id", "user_id", str(kept.alias("_sought")))


def _met(requests: DataFrame, items: DataFrame, carried: tuple[str, ...],
         columns: list[str]) -> DataFrame:
    """Choices by parts, with ``_held``, the columns of the items by their numbers."""
    sought = _choice(requests, items)
    if carried:
        sought = sought.join(requests.select("request_id", *carried), "request_id")
    newest = Window.partitionBy("user_id").orderBy(F.col("updated_seq").desc(), "item_id")
    held = _in_parts(items.select(
        "user_id", *columns, F.row_number().over(newest).alias("nth")), "_held", *columns)
    return _by_parts(sought, "_sought").join(held, ["user_id", "_part"])


def memories_for_requests(requests: DataFrame, items: DataFrame,
                          carried: tuple[str, ...] = ()) -> DataFrame:
    """Tiers, one-hop links (superseded ones only when history is asked for) and one item
    per topic.  At most 100 fetched and 20 linked items per request.

    Columns of the items, request_id, tier, ``_rank`` (a request's items by tier, newest first)
    and the ``carried`` columns of the requests.  Items are chosen by their numbers and meet
    the requests at the end, a part of a user's items in a row."""
    met = _met(requests, items, carried, [c for c in items.columns if c != "user_id"])
    return met.select(
        "request_id", "user_id", *carried, F.explode(F.transform("_sought", lambda s: F.struct(
            s["tier"].alias("tier"), s["_rank"].alias("_rank"),
            F.element_at("_held", s["nth"]).alias("_item")))).alias("_s")).select(
        "request_id", "user_id", *carried, "_s.tier", "_s._rank", "_s._item.*")


def memory_lists(requests: DataFrame, items: DataFrame, carried: tuple[str, ...],
                 columns: list[str], entry) -> DataFrame:
    """What memories_for_requests() gives as one row per request, without those that have none:
    request_id and ``_known``, an array in order of rank of the structs that ``entry`` makes of
    a rank and an item with the ``columns``."""
    met = _met(requests, items, carried, columns)
    looked_up = X.transform(col("_sought"), lambda s: X.struct(
        s["_rank"].alias("rank"), X.element_at(col("_held"), s["nth"]).alias("item")))
    entries = X.transform(looked_up, lambda s: entry(s["rank"], s["item"]))
    return met.selectExpr("request_id", str(entries.alias("_e"))).repartition(
        "request_id").groupBy("request_id").agg(F.array_sort(F.flatten(
            F.collect_list("_e"))).alias("_known"))
