"""Page facts and classes: meta data, links, JSON-LD types, challenge pages, access classes, lanes, pattern search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.core import all_groups, contains_any, group, let, rx
from ..functions.sites import path_of, registrable_domain
from ..functions.text import squeeze, unescape, visible_text
from ..functions.values import resolve_url
from ..sources.pages import is_object, jsonld, next_state, nuxt_state, records_of, window_state


def _attribute(tag: Column, name: str) -> Column:
    return group(tag, rf"(?is)(?<![\w:\-]){name}\s*=\s*([\"'])(.*?)\1", 2)


def page_meta(html: Column, closed: bool = False) -> Column:
    """MAP of meta property or name -> content (the first one counts), with title and lang.  `closed`: see `unescape`."""
    tags = all_groups(html, r"(?is)<meta\b([^>]+)>", 1)
    entries = F.filter(F.transform(tags, lambda t: F.struct(
        F.lower(F.coalesce(_attribute(t, "property"), _attribute(t, "name"))).alias("k"),
        unescape(F.regexp_extract(t, r"(?is)(?<![\w:\-])content\s*=\s*([\"'])(.*?)\1", 2), closed).alias("v"),
        t.rlike(r"(?is)(?<![\w:\-])content\s*=\s*[\"']").alias("has"))), lambda e: e["k"].isNotNull() & e["has"])
    title = F.struct(F.lit("title").alias("k"), unescape(squeeze(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), closed).alias("v"),
                     html.rlike(r"(?is)<title[^>]*>.*?</title>").alias("has"))
    lang = F.struct(F.lit("lang").alias("k"), F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([\w\-]+)", 1).alias("v"),
                    html.rlike(r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?[\w\-]+").alias("has"))
    everything = F.concat(entries, F.filter(F.array(title, lang), lambda e: e["has"]))
    return let(everything, lambda es: F.map_from_entries(F.transform(
        F.filter(es, lambda e, i: F.array_position(F.transform(es, lambda x: x["k"]), e["k"]) == i + 1),
        lambda e: F.struct(e["k"], e["v"]))))


def page_links(html: Column, base: Column | None = None, pattern: str | None = None, closed: bool = False) -> Column:
    """Distinct links of a page in order, absolute when a base is given, optionally only those matching a pattern."""
    found = F.transform(all_groups(html, r"(?i)<a\b[^>]*?href\s*=\s*[\"']([^\"'#]+)", 1), lambda h: unescape(F.trim(h), closed))
    if base is not None:
        found = F.transform(found, lambda h: resolve_url(h, base))
    if pattern:
        found = F.filter(found, lambda h: h.rlike(rx(pattern, "")))
    return F.array_distinct(found)


def link_table(pages: DataFrame, pattern: str | None = None, closed: bool = False) -> DataFrame:
    return pages.select("page_id", F.posexplode(page_links(F.col("html"), F.col("url"), pattern, closed)).alias("pos", "link"))


def feed_links(html: Column, base: Column) -> Column:
    """Addresses of the alternate feeds a page announces."""
    tags = all_groups(html, r"(?is)<link\b([^>]+)>", 1)
    alternate = F.filter(tags, lambda t: t.rlike(r"(?i)rel\s*=\s*[\"']?alternate") & contains_any(F.lower(t), K.FEED_TYPES))
    found = F.transform(alternate, lambda t: group(t, r"(?i)href\s*=\s*[\"']([^\"']+)", 1))
    return F.transform(F.filter(found, lambda h: h.isNotNull()), lambda h: resolve_url(h, base))


def _types_of(item: Column) -> Column:
    value = F.variant_get(item, '$["@type"]', "variant")
    many = F.try_variant_get(value, "$", "array<string>")
    return F.filter(F.coalesce(many, F.array(F.try_variant_get(value, "$", "string"))), lambda t: t.isNotNull())


def _list_elements(item: Column) -> Column:
    empty = F.array().cast("array<variant>")
    return F.coalesce(F.try_variant_get(item, "$.itemListElement", "array<variant>"), empty)


def jsonld_types(html: Column) -> Column:
    """Types of a page's JSON-LD objects, with the item types of its lists."""
    objects = jsonld(html)
    inner = F.flatten(F.transform(F.filter(objects, lambda o: F.array_contains(_types_of(o), "ItemList")), lambda o: F.flatten(
        F.transform(_list_elements(o), lambda e: _types_of(F.variant_get(e, "$.item", "variant"))))))
    return F.array_distinct(F.concat(F.flatten(F.transform(objects, _types_of)), inner))


def business_listings(html: Column, url: Column) -> Column:
    """Number of named businesses in a page's JSON-LD that are not the site itself; 0 below two."""
    def members(o: Column) -> Column:
        inner = F.transform(F.filter(_list_elements(o), is_object), lambda e: F.coalesce(
            F.filter(F.array(F.variant_get(e, "$.item", "variant")), is_object)[0], e))
        return F.concat(F.array(o), inner)

    own = registrable_domain(url)
    kinds = F.array(*[F.lit(t) for t in K.BUSINESS_TYPES])

    def counts(o: Column) -> Column:
        stated = F.coalesce(F.nullif(F.try_variant_get(o, "$.url", "string"), F.lit("")),
                            F.nullif(F.try_variant_get(o, '$["@id"]', "string"), F.lit("")))
        link = resolve_url(stated, url)
        is_site = F.coalesce((registrable_domain(link) == own) & (path_of(link) == "/"), F.lit(False))
        named = F.coalesce(F.try_variant_get(o, "$.name", "string"), F.try_variant_get(o, "$.url", "string")).isNotNull()
        return F.arrays_overlap(_types_of(o), kinds) & ~is_site & named

    n = F.size(F.filter(F.flatten(F.transform(jsonld(html), members)), counts))
    return F.when(n >= K.MIN_BUSINESS_LISTINGS, n).otherwise(F.lit(0))


@dataclass(frozen=True)
class PageLimits:
    """How much of a page the rules look at, in characters; None looks at all of it, or has no bound.  `head`: where a challenge phrase counts.
    `small`: a larger page is no challenge, and is open when it was served without an error.  `body`: where login, payment and
    challenge marks count.  `stub`: a page with less visible text is one with nothing but its scripts."""

    head: int | None = K.CHALLENGE_HEAD_CHARS
    small: int | None = K.CHALLENGE_MAX_CHARS
    body: int | None = K.ACCESS_BODY_CHARS
    stub: int = K.STUB_MAX_TEXT


WHOLE_PAGES = PageLimits(head=None, small=None, body=None)


def _start(text: Column, chars: int | None) -> Column:
    return F.lower(text if chars is None else F.left(text, F.lit(chars)))


def is_challenge(html: Column, visible: Column | None = None, limits: PageLimits = PageLimits()) -> Column:
    """A bot challenge: a challenge phrase near the top of a small page, or a bot-wall script on a page without text."""
    text = F.coalesce(html, F.lit(""))
    shown = visible_text(text) if visible is None else visible
    stub = contains_any(F.lower(text), K.STUB_MARKERS) & (F.length(shown) < limits.stub)
    found = contains_any(_start(text, limits.head), K.CHALLENGE_MARKERS) | stub
    return found if limits.small is None else (F.length(text) < limits.small) & found


# what a match can start with; the look-ahead only makes the search cheaper
_LOGIN, _PAYWALL = (rx(f"(?=[{starts}])(?:{pattern})") for starts, pattern in (("tlspвaiy", K.LOGIN_BODY), ("sp", K.PAYWALL_BODY)))


def access_class(status: Column, headers: Column, html: Column, limits: PageLimits = PageLimits()) -> Column:
    """What stands between the reader and the page: challenge, auth, login, paywall, ip_block, rate_limited, other or ok.
    headers is a MAP with lower-case names."""
    body = _start(F.coalesce(html, F.lit("")), limits.body)
    names = F.array(*[F.lit(h) for h in K.ACCESS_CHALLENGE_HEADERS])
    walled = F.coalesce(F.arrays_overlap(F.map_keys(headers), names), F.lit(False))
    guarded = F.contains(F.lower(F.coalesce(F.try_element_at(headers, F.lit("server")), F.lit(""))), F.lit("ddos-guard"))
    large = F.lit(False) if limits.small is None else (status < 400) & (F.length(html) >= limits.small) & ~walled
    return (F.when(F.coalesce(large, F.lit(False)), "ok")
            .when(walled | guarded | contains_any(body, K.ACCESS_CHALLENGE_BODY), "challenge")
            .when((status == 401) & F.try_element_at(headers, F.lit("www-authenticate")).isNotNull(), "auth")
            .when(body.rlike(_LOGIN), "login")
            .when((status == 402) | body.rlike(_PAYWALL), "paywall")
            .when(status.isin(401, 403), "ip_block")
            .when(status == 429, "rate_limited")
            .when(status.isNull() | (status >= 400), "other").otherwise("ok"))


def feed_relates(feed_url: Column, item_links: Column, page_url: Column, page_link_paths: Column) -> Column:
    """A feed carries a page's inventory when it is the feed of the page's own path, or at least 30 % of its items are
    linked from the page (paths compared)."""
    page_path = path_of(page_url)
    feed_path = F.regexp_replace(path_of(feed_url), r"\.(atom|rss|xml|json)$", "")
    same = (page_path != "/") & ((feed_path == page_path) | F.startswith(feed_path, F.concat(page_path, F.lit("/"))))
    paths = F.transform(F.filter(item_links, lambda x: x.isNotNull() & (x != "")), lambda x: path_of(resolve_url(x, page_url)))
    hits = F.size(F.filter(paths, lambda p: F.array_contains(page_link_paths, p)))
    share = F.try_divide(hits.cast("double"), F.size(paths).cast("double"))
    return same | F.coalesce(share >= K.FEED_RELATED_SHARE, F.lit(False))


def classify_lane(pages: DataFrame, documents: DataFrame | None = None, record_type: str | None = None, closed: bool = False) -> DataFrame:
    """page_id, lane, reason: how a page can be collected, from landed documents only.

    documents(page_id, kind, url, item_links ARRAY, n INT) describes what was landed beside a page: `feed` (with its item
    links), `sitemap` (n page addresses), `openapi`.  The rules are tried in order."""
    html, url = F.col("html"), F.col("url")
    wanted = K.ITEM_TYPES + (K.BUSINESS_TYPES if record_type == "businesses" else [])
    plain = [t for t in wanted if t not in K.BUSINESS_TYPES]
    beside = pages
    if documents is not None:
        per_page = documents.groupBy("page_id").agg(
            F.min_by(F.when(F.col("kind") == "feed", F.struct("url", "item_links")), F.when(F.col("kind") == "feed", F.col("url"))).alias("feed"),
            F.sum(F.when(F.col("kind") == "sitemap", F.col("n")).otherwise(0)).alias("sitemap_pages"),
            F.max(F.col("kind") == "openapi").alias("openapi"))
        beside = pages.join(per_page, "page_id", "left")
    else:
        beside = pages.withColumns({"feed": F.lit(None).cast("struct<url:string,item_links:array<string>>"),
                                    "sitemap_pages": F.lit(0), "openapi": F.lit(False)})
    # the name of the root element, whatever comes before it; a document may also start with JSON
    root = F.lower(F.regexp_extract(html, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*(<(?:[\w.\-]+:)?[\w.\-]+|[{\[])", 1))
    is_feed = root.rlike(r"^<(?:[\w.\-]+:)?(?:rss|feed|rdf|channel)$")
    own_items = F.size(all_groups(html, r"(?i)<(?:[\w.\-]+:)?(?:item|entry)[\s>]"))
    facts = beside.withColumns({
        "visible": visible_text(html, closed),
        "links": page_links(html, url, closed=closed),
        "types": jsonld_types(html),
        "doc": F.when(root.isin("{", "["), F.try_parse_json(html)),
        "own_feed": F.when(is_feed, own_items).otherwise(0),
        "business": business_listings(html, url) if record_type == "businesses" else F.lit(0),
    }).withColumns({
        "chars": F.length("visible"),
        "json_feed": F.coalesce(F.startswith(F.try_variant_get("doc", "$.version", "string"), F.lit("https://jsonfeed.org")), F.lit(False)),
        "is_api_doc": F.coalesce(F.variant_get("doc", "$.openapi", "variant"), F.variant_get("doc", "$.swagger", "variant")).isNotNull(),
        "records": F.size(records_of(F.col("doc"))),
        "related": F.coalesce(feed_relates(F.col("feed.url"), F.col("feed.item_links"), url,
                                           F.transform("links", path_of)), F.lit(False)),
    })
    ld = F.arrays_overlap("types", F.array(*[F.lit(t) for t in plain])) | (F.col("business") > 0)
    states = [window_state(html, v).isNotNull() for v in K.STATE_VARIABLES]
    embedded = next_state(html).isNotNull() | nuxt_state(html).isNotNull() | ld
    for state in states:
        embedded = embedded | state
    n = F.col("records")
    feed_size = F.size("feed.item_links")
    rules = [
        (is_challenge(html, F.col("visible")), "none", "challenge page"),
        (html.rlike(rx(K.LANE_LOGIN)) & (F.col("chars") < K.LANE_LOGIN_CHARS), "none", "content is behind a login"),
        (html.rlike(rx(K.LANE_PAYWALL)) & (F.col("chars") < K.LANE_PAYWALL_CHARS), "none", "content is behind a paywall"),
        ((F.col("own_feed") >= K.MIN_FEED_ITEMS) | (F.col("json_feed") & (n >= K.MIN_FEED_ITEMS)), "feed", "the page is a feed"),
        (F.col("doc").isNotNull() & ~F.col("is_api_doc") & ~F.col("json_feed") & (n >= 1), "json_api", "the page is a JSON document"),
        (F.coalesce("openapi", F.lit(False)), "openapi", "OpenAPI document"),
        ((feed_size >= K.MIN_FEED_ITEMS) & F.col("related"), "feed", "feed of this page's items"),
        (embedded, "embedded_json", "embedded JSON"),
        (F.coalesce("sitemap_pages", F.lit(0)) > 0, "sitemap", "sitemap with pages"),
        ((F.col("chars") >= K.LANE_HTML_CHARS) & (F.size("links") >= K.LANE_HTML_LINKS), "html", "HTML with content"),
        (html.rlike("(?i)" + K.LANE_SHELL) | ((F.col("chars") < K.LANE_HTML_CHARS) & html.rlike(r"(?i)<script\b")), "browser", "JavaScript shell"),
    ]
    chain = F.when(F.lit(False), F.struct(F.lit("").alias("lane"), F.lit("").alias("reason")))
    for condition, lane, reason in rules:
        chain = chain.when(condition, F.struct(F.lit(lane).alias("lane"), F.lit(reason).alias("reason")))
    verdict = chain.otherwise(F.struct(F.lit("html").alias("lane"), F.lit("HTML").alias("reason")))
    return facts.select("page_id", F.inline(F.array(verdict)))


BLOCK = 1024  # characters, and matches, that are looked at together


def _starts(sizes: Column) -> Column:
    """Where each match of array<struct<gap, hit>> starts: running sums inside blocks of matches, and over the blocks."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(sizes) - 1, F.lit(0)) / BLOCK).cast("int")), lambda k: F.slice(sizes, k * BLOCK + 1, F.lit(BLOCK)))
    none = F.array().cast("array<int>")

    def one(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x["gap"] + x["hit"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["gap"])).alias("starts"))

    def whole(acc: Column, block: Column) -> Column:
        inside = F.aggregate(block, F.struct(acc["at"].alias("at"), none.alias("starts")), one)
        return let(inside, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["starts"], F.array(r["starts"])).alias("starts")))

    return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("starts")), whole)["starts"])


def grep_pages(pages: DataFrame, pattern: str, context: int = 80, snippets: int | None = None) -> DataFrame:
    """page_id, number of matches, and snippets of all of them (or the first `snippets`) with their position (from 0).  A page is searched
    once, its matches are placed by running sums, and snippets are cut from blocks of the page, so the work is linear in page and matches."""
    context = max(0, int(context))
    regex, html = rx(pattern, "iu"), F.coalesce("html", F.lit(""))
    found = all_groups(html, regex)
    found = found if snippets is None else F.slice(found, 1, snippets)

    def placed(f: Column) -> Column:
        between = F.split(html, regex, -1 if snippets is None else snippets + 1)
        sizes = F.zip_with(F.slice(between, F.lit(1), F.size(f)), f, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")))
        return F.struct(f.alias("found"), let(sizes, _starts).alias("starts"), all_groups(html, f"(?s).{{1,{BLOCK}}}").alias("blocks"))

    def cut(p: Column) -> Column:
        def snippet(hit: Column, at: Column) -> Column:
            start, end = F.greatest(F.lit(0), at - context), at + F.length(hit) + context
            first = F.floor(start / BLOCK).cast("int")
            near = F.array_join(F.slice(p["blocks"], first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
            return F.struct(at.alias("at"), F.substring(near, start - first * BLOCK + 1, end - start).alias("text"))

        return F.zip_with(p["found"], p["starts"], snippet)

    matches = F.regexp_count(html, F.lit(regex)).alias("matches")
    return pages.select("page_id", matches, let(let(found, placed), cut).alias("snippets")).filter("matches > 0")
