"""A wiki export as events: revisions, deletions and probes, short links, other wikis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clip, extract_urls, no_strings, parse_timestamp, resource_key
from ..plans.frame import canonical
from . import tables

#: Proxies that count as tools, the wikis' hosts, text that new pages start with, link patterns.
PROXIES = ("jqp.vercel.app", "r.jina.ai", "allorigins.hexlet.app", "api.allorigins.win", "md.succ.ai", "markdown.new", "pure.md", "jsonhero.io", "cors.bwa.workers.dev", "corsproxy.io")
HOSTS = ("wikiservice.at", "prowiki.org")
PLACEHOLDERS = ("Beschreibe hier die neue Seite.",)
WIKI_WORD = r"\b([A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*)\b"
BRACKET = r"\[\[([^\]|#]+)"
#: Fixed patterns of URLs that hold another one: as a parameter, as a path with its scheme, as a path without.
GIVEN = r"[?&](?:url|u|target|src)=([^&#]+)"
WITH_SCHEME = r"/(https?):/+(.+)$"
WITHOUT_SCHEME = r"^/((?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)+/.*)$"

REVISIONS = "rev_id string, page_key string, wiki string, name string, seq int, body string, hunks array<struct<op:string,a0:int,a1:int,b0:int,b1:int>>, label string, ip16 string, time string, diff_base_reason string, relation_type string, related_event_id string, time_grade string, change_summary string"
EVENTS = "event_id string, event_type string, page string, page_key string, time string, actor_label string, ip16 string, change_summary string, param_family string, related_event_id string, source_refs string"
PAGES = "page_key string, name string, wiki string"
LABELS = "label string, is_human_handle boolean"
SHORTENER = "sites array<struct<site:string,links:array<struct<keyword:string,url:string,title:string,time:string,ip16:string,clicks:bigint>>>>"
OTHER = "pages array<struct<wiki:string,page_key:string,name:string,revisions:array<struct<seq:int,time:string,ip16:string,added:array<string>>>>>"
MANIFEST = "generated_at string, cut string, checks array<struct<ok:boolean>>"


def added_lines(body: Column, hunks: Column) -> Column:
    """The lines a revision added or replaced (all, without hunks), without placeholders."""
    lines = F.split(body, "\n")
    own = F.flatten(F.transform(F.filter(hunks, lambda h: h["op"].isin("insert", "replace")), lambda h: F.slice(lines, F.coalesce(h["b0"], F.lit(0)) + 1, F.greatest(F.coalesce(h["b1"], F.lit(0)) - F.coalesce(h["b0"], F.lit(0)), F.lit(0)))))
    chosen = F.when(F.coalesce(body, F.lit("")) == "", no_strings()).when(F.coalesce(F.size(hunks), F.lit(0)) <= 0, lines).otherwise(own)
    return F.trim(F.array_join(F.filter(chosen, lambda x: ~F.trim(x).isin(*PLACEHOLDERS)), "\n"))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/@?#]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def wiki_page(url: Column) -> Column:
    """``wiki~Page`` of a wiki's URL; null for any other."""
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    wiki = F.lower(F.regexp_extract(path, r"([^/]+)/[^/]*wiki\.cgi$", 1))
    query = F.try_url_decode(F.regexp_extract(url, r"\?([^#]*)", 1))
    named = F.regexp_extract(query, r"(?:^|[&;])(?:id|page)=([^&;]+)", 1)
    bare = F.regexp_extract(query, r"^([^=&;]+)(?:[&;]|$)", 1)
    name = F.when(named != "", named).otherwise(bare)
    return F.when(host_of(url).isin(*HOSTS) & path.endswith("wiki.cgi") & (wiki != "") & (name != ""), F.concat_ws("~", wiki, name))


def proxied(url: Column) -> Column:
    """The URL that a proxy's URL asks for; null if it holds none."""
    given = F.try_url_decode(F.regexp_extract(url, GIVEN, 1))
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    scheme, rest = F.regexp_extract(path, WITH_SCHEME, 1), F.regexp_extract(path, WITH_SCHEME, 2)
    plain = F.regexp_extract(path, WITHOUT_SCHEME, 1)
    return (
        F.when(given.startswith("http"), given).when(given != "", F.concat(F.lit("https://"), given))
        .when(rest != "", F.concat(scheme, F.lit("://"), rest)).when(plain != "", F.concat(F.lit("https://"), plain))
    )


def unwrapped(urls: Column) -> Column:
    """Follow up to three proxies in each URL; null where one names no target. (A step a transform: nested, the expression would explode.)"""
    for _ in range(3):
        urls = F.transform(urls, lambda u: F.when(host_of(u).isin(*PROXIES), proxied(u)).otherwise(u))
    return urls


def references(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows (id, text, wiki, page_key) with ``resources`` (linked pages), ``tool``, ``urls`` and ``external_refs``.

    Channels are pages that agents write and others read; public sources they only fetch are external references.
    Names are resolved by joins: to the page of the same wiki, else to the only page of that name. Pages that words
    name come in alphabetical order, then those of URLs in the text's.
    """
    urls = extract_urls(F.col("text"), 25)
    found = rows.withColumn("urls", urls)
    names = F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(WIKI_WORD), F.lit(1)), F.transform(F.regexp_extract_all("text", F.lit(BRACKET), F.lit(1)), lambda x: F.trim(x))))
    asked = found.select("id", "wiki", F.col("page_key").alias("own"), F.explode(names).alias("name"))
    known = pages.select("page_key", F.substring_index("page_key", "~", 1).alias("wiki"), F.expr("substring(page_key, instr(page_key, '~') + 1)").alias("name")).distinct()
    same = known.select("wiki", "name", F.col("page_key").alias("same"))
    only = known.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("page_key").alias("only")).where("n = 1").drop("n")
    linked = asked.join(same, ["wiki", "name"], "left").join(only, "name", "left").withColumn("page", F.coalesce("same", "only"))
    linked = linked.where(F.col("page").isNotNull() & (F.col("page") != F.coalesce("own", F.lit("")))).groupBy("id").agg(F.array_sort(F.collect_set("page")).alias("named"))
    joined = found.join(linked, "id", "left")
    by_url = F.filter(F.transform("urls", wiki_page), lambda p: p.isNotNull() & (p != F.coalesce(F.col("page_key"), F.lit(""))))
    pages_ = F.array_distinct(F.concat(F.coalesce("named", no_strings()), by_url))
    plain = F.filter("urls", lambda u: wiki_page(u).isNull())
    proxy = F.filter(plain, lambda u: host_of(u).isin(*PROXIES))
    external = F.array_distinct(F.filter(F.transform(unwrapped(plain), lambda u: resource_key(u)), lambda k: k.isNotNull()))
    tool = F.when(F.size(proxy) > 0, F.concat(F.lit("proxy:"), host_of(F.get(proxy, F.lit(0)))))
    return joined.select("id", F.transform(pages_, lambda p: F.concat(F.lit("wiki:"), p)).alias("resources"), tool.alias("tool"), F.slice("urls", 1, 10).alias("urls"), external.alias("external_refs"))


def _anonymous(ip16: Column) -> Column:
    return F.concat(F.lit("anon@"), F.coalesce(F.nullif(ip16, F.lit("")), F.lit("?")))


def _actors(df: DataFrame, label: str, humans: DataFrame) -> DataFrame:
    """With actor_id and actor_type: the label, else the address; humans by the label table."""
    named = df.withColumn("actor_id", F.coalesce(F.nullif(F.col(label), F.lit("")), _anonymous(F.col("ip16"))))
    marked = named.join(humans.select(F.col("label").alias(label), F.lit(True).alias("__human")), label, "left") if humans is not None else named.withColumn("__human", F.lit(None).cast("boolean"))
    return marked.withColumn("actor_type", F.when(F.col("__human"), "human").otherwise("agent")).drop("__human")


def event(df: DataFrame, **columns) -> DataFrame:
    """The columns of an event; what isn't given is empty."""
    none, empty = F.lit(None).cast("string"), no_strings()
    default = {"target_id": none, "target_type": none, "content": F.lit(""), "tool": none, "mentions": empty, "resources": empty, "urls": empty, "external_refs": empty, "reply_to": none, "origin": none, "goal_key": none, "actor_name": none, "room_name": none, "target_label": none, "recreation_of": none, "raw_id": none}
    return df.select(*[(columns.get(k, default.get(k))).alias(k) for k in ("event_id", "timestamp", "actor_id", "actor_type", "action_type", *list(default)[:3], "source", *list(default)[3:])])


def load(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None, max_events: int | None = None, include_probes: bool = True) -> DataFrame:
    """The canonical frame of an export: start <= time < end, of equal ids the first, at most ``max_events`` from the start."""
    c = F.col
    at = {s: tables.find(spark, folder, s) for s in ("revisions", "events", "pages", "labels")}
    if at["revisions"] is None:
        raise FileNotFoundError(f"no revisions in {folder}")
    pages = tables.json_lines(spark, at["pages"], PAGES) if at["pages"] else spark.createDataFrame([], PAGES)
    humans = tables.json_lines(spark, at["labels"], LABELS).where("is_human_handle").select("label").distinct() if at["labels"] else spark.createDataFrame([], "label string")
    parts = []

    def with_refs(df: DataFrame) -> DataFrame:
        return df.join(references(df.select("id", "text", "wiki", "page_key"), pages), "id")

    r = tables.json_lines(spark, at["revisions"], REVISIONS).withColumn("id", F.concat(F.lit("rev:"), "rev_id")).withColumn("text", added_lines(c("body"), c("hunks")))
    r = _actors(with_refs(r.drop("urls")), "label", humans)
    again = F.coalesce(c("relation_type") == "first_recreation_of", F.lit(False))
    created = F.coalesce(c("seq") == 1, F.lit(False)) | F.coalesce(c("diff_base_reason") == "page_created", F.lit(False)) | again
    parts.append(event(
        r, event_id=c("id"), timestamp=parse_timestamp(c("time")), actor_id=c("actor_id"), actor_type=c("actor_type"), action_type=F.when(created, "create").otherwise("edit"),
        target_id=F.concat(F.lit("wiki:"), "page_key"), target_type=F.lit("resource"), content=clip(c("text"), 1500), source=F.concat(F.lit("german_wiki:revisions:"), "wiki"), tool=c("tool"), resources=c("resources"),
        urls=c("urls"), external_refs=c("external_refs"), origin=c("ip16"), actor_name=c("actor_id"), target_label=c("name"), recreation_of=F.when(again, c("related_event_id")), raw_id=c("rev_id")))
    if at["events"]:
        e = tables.json_lines(spark, at["events"], EVENTS).where("event_type <> 'save'")
        e = _actors(e if include_probes else e.where("event_type <> 'probe'"), "actor_label", humans)
        kind, note = c("event_type"), F.coalesce("change_summary", F.lit(""))
        content = F.when(kind == "delete", F.trim(F.concat(F.lit("[deleted page "), F.coalesce("page", F.lit("")), F.lit("] "), note))).when(kind == "revert", F.trim(F.concat(F.lit("[recreated after deletion] "), note))).otherwise("")
        parts.append(event(
            e, event_id=F.concat(F.lit("ev:"), "event_id"), timestamp=parse_timestamp(c("time")), actor_id=c("actor_id"), actor_type=c("actor_type"), action_type=F.when(kind == "delete", "delete").when(kind == "revert", "create").otherwise("visit"),
            target_id=F.concat(F.lit("wiki:"), "page_key"), target_type=F.when(c("page_key").isNotNull(), "resource"), content=content, source=F.concat(F.lit("german_wiki:events:"), kind),
            tool=F.when(kind == "probe", "script_probe"), origin=c("ip16"), actor_name=c("actor_id"), recreation_of=F.when(kind == "revert", c("related_event_id")), raw_id=c("event_id")))
    short = f"{folder}/shortener-logs.json.gz"
    if tables.exists(spark, short):
        s = tables.json_document(spark, short, SHORTENER).select(F.explode("sites").alias("s")).select("s.site", F.posexplode("s.links").alias("k", "l")).select("site", "k", "l.*")
        s = s.withColumn("id", F.concat_ws(":", F.lit("short"), "site", "keyword", c("k").cast("string"))).withColumn("text", F.coalesce("url", F.lit(""))).withColumn("wiki", F.lit("dse")).withColumn("page_key", F.lit(""))
        s = with_refs(s)
        parts.append(event(
            s, event_id=c("id"), timestamp=parse_timestamp(c("time")), actor_id=_anonymous(c("ip16")), actor_type=F.lit("agent"), action_type=F.lit("create"), target_id=F.concat_ws("/", "site", "keyword"), target_type=F.lit("resource"),
            content=clip(F.concat(F.lit("short link → "), "text", F.lit(" "), F.coalesce("title", F.lit(""))), 600), source=F.lit("german_wiki:shortener"), tool=F.coalesce("tool", F.lit("url_shortener")), resources=c("resources"), origin=c("ip16"), actor_name=_anonymous(c("ip16")), raw_id=c("keyword")))
    other = f"{folder}/other-wikis.json.gz"
    if tables.exists(spark, other):
        o = tables.json_document(spark, other, OTHER).select(F.explode("pages").alias("p")).select("p.wiki", "p.page_key", "p.name", F.explode("p.revisions").alias("r")).select("wiki", "page_key", "name", "r.*")
        o = o.withColumn("raw", F.concat_ws("@", "page_key", c("seq").cast("string"))).withColumn("id", F.concat(F.lit("ow:"), "raw")).withColumn("text", F.array_join(F.coalesce("added", no_strings()), "\n"))
        o = with_refs(o)
        parts.append(event(
            o, event_id=c("id"), timestamp=parse_timestamp(c("time")), actor_id=_anonymous(c("ip16")), actor_type=F.lit("agent"), action_type=F.lit("edit"), target_id=F.concat(F.lit("wiki:"), "page_key"), target_type=F.lit("resource"),
            content=clip(c("text"), 1500), source=F.concat(F.lit("german_wiki:other_wikis:"), "wiki"), tool=c("tool"), resources=c("resources"), urls=c("urls"), external_refs=c("external_refs"), origin=c("ip16"), actor_name=_anonymous(c("ip16")), target_label=c("name"), raw_id=c("raw")))
    every = reduce(DataFrame.unionByName, parts)
    for bound, test in ((start, lambda b: c("timestamp") >= b), (end, lambda b: c("timestamp") < b)):
        if bound is not None:
            every = every.where(test(F.lit(bound).cast("timestamp")))
    if max_events is not None:
        every = every.where(c("timestamp").isNotNull()).orderBy("timestamp", "event_id").limit(max_events)
    return canonical(every)


def context(ev: DataFrame) -> DataFrame:
    """One row: window, number of events, and how many of each kind of source."""
    kinds = ev.groupBy(F.split("source", ":")[1].alias("kind")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("event_counts"))
    return ev.agg(F.min("timestamp").alias("window_start"), F.max("timestamp").alias("window_end"), F.count(F.lit(1)).alias("events")).crossJoin(kinds)


def slice_context(spark: SparkSession, folder: str, ev: DataFrame) -> DataFrame:
    """:func:`context` with the export's own facts: pages, labels, human handles, and its gaps where it lists some.

    Missing files count as empty tables.
    """
    table = lambda stem, schema: tables.json_lines(spark, at, schema) if (at := tables.find(spark, folder, stem)) else spark.createDataFrame([], schema)
    pages = table("pages", PAGES).agg(F.count(F.lit(1)).alias("n_pages"))
    human = F.array_sort(F.collect_set(F.when(F.col("is_human_handle"), F.col("label")))).alias("human_handles")
    out = context(ev).crossJoin(pages).crossJoin(table("labels", LABELS).agg(F.count(F.lit(1)).alias("n_labels"), human))  # one row each
    sites, gaps = f"{folder}/site-coverage.csv", f"{folder}/coverage-gaps.csv"
    if tables.exists(spark, sites):
        out = out.crossJoin(tables.csv_rows(spark, sites).agg(F.count(F.lit(1)).alias("coverage_sites")))
    if tables.exists(spark, gaps):
        listed = tables.csv_rows(spark, gaps).select(F.concat("site", F.lit(" ("), "compilation_status", F.lit(")")).alias("gap"))
        first = listed.limit(5).agg(F.collect_list("gap").alias("coverage_gap_examples"))
        out = out.crossJoin(listed.agg(F.count(F.lit(1)).alias("coverage_gap_sites"))).crossJoin(first)
    return out


def manifest_checks(spark: SparkSession, path: str) -> DataFrame:
    """(generated_at, cut, checks_ok, checks_total)."""
    m = tables.json_document(spark, path, MANIFEST)
    return m.select("generated_at", "cut", F.size(F.filter("checks", lambda x: x["ok"])).alias("checks_ok"), F.size("checks").alias("checks_total"))

