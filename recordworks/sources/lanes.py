"""Raw rows from landed documents, one adapter per collection lane.

Every adapter returns raw_rows(page_id, page_url, pos, raw JSON), ready for `plans.normalise`.  New lanes are registered with
`register`; an adapter is a function DataFrame -> DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pages as P

Adapter = Callable[[DataFrame, dict], DataFrame]
ADAPTERS: dict[str, Adapter] = {}

# feed element names per field, in order of preference
FEED_FIELDS = {
    "source_id": ["guid", "id", "link"],
    "url": ["link", "url"],
    "title": ["title"],
    "posted_at": ["pubdate", "published", "updated", "date_published"],
    "description": ["description", "summary", "content_text"],
}


def register(lane: str) -> Callable[[Adapter], Adapter]:
    def add(adapter: Adapter) -> Adapter:
        ADAPTERS[lane] = adapter
        return adapter
    return add


def adapt(lane: str, pages: DataFrame, mapping: dict | None = None) -> DataFrame:
    if lane not in ADAPTERS:
        raise ValueError(f"no adapter for lane {lane!r}; known: {sorted(ADAPTERS)}")
    return ADAPTERS[lane](pages, mapping or {})


def _row(fields: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _addressed(pages: DataFrame) -> DataFrame:
    """The address of a page goes along with what is read from it, under the name that rows have for it."""
    return pages.withColumn("page_url", F.col("url"))


@register("feed")
def feed(pages: DataFrame, mapping: dict) -> DataFrame:
    items = P.feed_items(_addressed(pages), carry=("page_url",)).filter("error IS NULL")
    names = {**FEED_FIELDS, **{k: v if isinstance(v, list) else [v] for k, v in mapping.items()}}
    fields = {field: F.coalesce(*[F.nullif(F.try_element_at("fields", F.lit(n)), F.lit("")) for n in options])
              for field, options in names.items()}
    return items.select("page_id", "page_url", "pos", _row(fields).alias("raw"))


@register("jsonld")
def linked_data(pages: DataFrame, mapping: dict) -> DataFrame:
    """Items of JSON-LD objects (members of an ItemList included) with their first offer."""
    def members(o: Column) -> Column:
        is_list = F.try_variant_get(o, '$["@type"]', "string") == "ItemList"
        return F.when(is_list, F.coalesce(F.try_variant_get(o, "$.itemListElement", "array<variant>"), F.array(o))).otherwise(F.array(o))

    found = F.flatten(F.transform(P.jsonld(F.col("html")), members))
    items = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(found).alias("pos", "e"))
    items = items.withColumn("i", F.coalesce(F.variant_get("e", "$.item", "variant"), F.col("e"))).filter(P.is_object(F.col("i")))
    offer = F.coalesce(F.try_variant_get("i", "$.offers[0]", "variant"), F.try_variant_get("i", "$.offers", "variant"))
    items = items.withColumn("offer", offer)

    def text(column: str, *paths: str) -> Column:
        return F.coalesce(*[F.try_variant_get(column, p, "string") for p in paths])

    image = F.variant_get("i", "$.image", "variant")
    fields = {"source_id": text("i", "$.sku", '$["@id"]', "$.url"), "url": text("i", "$.url"), "title": text("i", "$.name", "$.title"),
              "price": text("offer", "$.price"), "currency": text("offer", "$.priceCurrency"),
              "image": F.when(F.schema_of_variant(image) == "STRING", F.try_variant_get(image, "$", "string"))}
    fields |= {name: text("i", f"$.{path}") for name, path in mapping.items()}
    return items.select("page_id", "page_url", "pos", _row(fields).alias("raw"))


@register("json_api")
def json_api(pages: DataFrame, mapping: dict) -> DataFrame:
    """Records of a JSON answer as they are; field names are mapped later by the normalisation's field map."""
    return P.json_items(_addressed(pages), carry=("page_url",)).select("page_id", "page_url", "pos", F.to_json("item").alias("raw"))


@register("embedded_json")
def embedded(pages: DataFrame, mapping: dict) -> DataFrame:
    """Objects of the page state that carry the given keys (mapping['keys']); a page whose state has none, or that has no state, gives the
    items of its JSON-LD."""
    state = F.coalesce(P.next_state(F.col("html")), P.nuxt_state(F.col("html")))
    docs = pages.select("page_id", F.col("url").alias("page_url"), "html", state.alias("state"))
    found = P.objects_with(F.col("state"), list(mapping.get("keys", ["id"])), F.lit(P.MOST_LEVELS))
    docs = docs.withColumn("found", F.when(F.col("state").isNotNull(), F.transform(found, lambda x: x["item"])))
    items = docs.select("page_id", "page_url", F.posexplode("found").alias("pos", "raw"))
    bare = docs.filter("found IS NULL OR size(found) = 0").select("page_id", F.col("page_url").alias("url"), "html")
    rest = {k: v for k, v in mapping.items() if k != "keys"}
    return items.unionByName(linked_data(bare, rest))


@register("sitemap")
def sitemap(pages: DataFrame, mapping: dict) -> DataFrame:
    """Detail pages found through a sitemap: their link preview data."""
    from ..operators.classify import page_meta

    meta = page_meta(F.col("html"))
    found = pages.withColumn("meta", meta)
    fields = {"source_id": F.col("url"), "url": F.col("url"),
              "title": F.coalesce(F.try_element_at("meta", F.lit("og:title")), F.try_element_at("meta", F.lit("title"))),
              "image": F.try_element_at("meta", F.lit("og:image")), "description": F.try_element_at("meta", F.lit("og:description"))}
    return found.select("page_id", F.col("url").alias("page_url"), F.lit(0).alias("pos"), _row(fields).alias("raw"))


@register("html")
def cards(pages: DataFrame, mapping: dict) -> DataFrame:
    """Listing cards: elements chosen by mapping['tag'] (default article) and mapping['cls'], with their first link and
    heading.  Cards and their parts are read from the page in one pass; a part belongs to the last card in front of it, which
    a running maximum over the page's own elements gives without joining elements to cards."""
    tag, cls = mapping.get("tag", "article"), mapping.get("cls")
    elements = P.page_elements(_addressed(pages), sorted({tag, "a", "h1", "h2", "h3"}), carry=("page_url",))
    is_card = F.col("tag") == tag
    for name in (cls or "").split():
        is_card = is_card & F.array_contains("classes", name)
    in_page = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    parts = (elements.withColumn("card", F.when(is_card, F.col("pos")))
             .filter(F.col("card").isNotNull() | F.col("tag").isin("a", "h1", "h2", "h3"))
             .withColumn("card", F.max("card").over(in_page)).filter("card IS NOT NULL"))

    def first(condition: Column, value: Column) -> Column:
        return F.min_by(F.when(condition, value), F.when(condition, F.col("pos")))

    own, href = F.col("pos") == F.col("card"), F.try_element_at("attrs", F.lit("href"))
    rows = parts.groupBy("page_id", "page_url", "card").agg(
        first(own, F.col("text")).alias("text"), first(own, F.try_element_at("attrs", F.lit("data-id"))).alias("data_id"),
        first(F.col("tag") == "a", href).alias("href"), first(F.col("tag").isin("h1", "h2", "h3"), F.col("text")).alias("heading"))
    fields = {"source_id": F.coalesce("data_id", "href"), "url": F.col("href"), "title": F.coalesce("heading", "text")}
    return rows.select("page_id", "page_url", F.col("card").alias("pos"), _row(fields).alias("raw"))
