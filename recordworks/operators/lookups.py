"""Lookups against dimensions: exchange rates, cities, regions, source status.

Exchange rates are broadcast by a hint: they are made one row per three-letter code first.  So is what the gazetteer knows of a table's different
places, once it is counted (FOUND).  Other joins with the gazetteer are left to AQE, which broadcasts what turned out small and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.core import look_up, rx
from ..functions.text import city_key
from ..session import settled
from ..sources.dims import country_code, region_tokens


# -------------------------------------------------------------------------------------------------------- exchange rates
def unique_rates(fx: DataFrame, *codes: str) -> DataFrame:
    """fx(currency, rate) made one row per three-letter code, so at most 26^3 rows, which is what may be broadcast.  Of several rates of a code
    the highest counts.  `codes` keeps only those currencies."""
    fine = fx.select(F.upper("currency").alias("currency"), "rate").filter(F.col("currency").rlike("^[A-Z]{3}$") & F.col("rate").isNotNull())
    return (fine.filter(F.col("currency").isin(*codes)) if codes else fine).groupBy("currency").agg(F.max("rate").alias("rate"))


def convert_fx(df: DataFrame, amount: str, source: str, target: str, fx: DataFrame, out: str) -> DataFrame:
    """Amounts in another currency, 2 decimals.  The same currency stays as it is even when it is unknown; a missing rate
    gives NULL."""
    table = unique_rates(fx).agg(F.map_from_entries(F.collect_list(F.struct("currency", "rate"))).alias("__rates"))  # one row of at most 26^3 entries
    joined = df.join(F.broadcast(table), how="left")
    rate = lambda c: F.try_element_at("__rates", F.upper(F.col(c)))
    same = F.upper(F.col(source)) == F.upper(F.col(target))
    value = F.when(same, F.col(amount)).otherwise(F.col(amount) / rate(source) * rate(target))
    return joined.withColumn(out, F.round(value, 2)).select(*[c for c in df.columns if c != out], out)


# ----------------------------------------------------------------------------------------------------------------- cities
def city_dim(gazetteer: DataFrame) -> DataFrame:
    """places(key, by_country MAP<country, canonical>): one row per name; the map has at most one entry per country."""
    return gazetteer.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("country", "canonical"))).alias("by_country"))


def cleaned_city(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def city_variants(name: Column) -> list[Column]:
    """The name as given, without a parenthesis or postcode, and its first part."""
    cleaned = cleaned_city(name)
    bare = F.trim(F.regexp_replace(cleaned, rx(K.CITY_PARENTHESIS, ""), " "))
    bare = F.regexp_replace(F.regexp_replace(bare, rx(K.CITY_POSTCODE, ""), ""), r"^[ .,]+|[ .,]+$", "")
    first = F.regexp_replace(F.get(F.split(bare, rx(K.CITY_FIRST_PART, ""), 2), F.lit(0)), r"^[ .]+|[ .]+$", "")
    return [cleaned, bare, first]


FOUND = 100_000  # known different questions that may be broadcast


def place_hits(df: DataFrame, texts: list[str], places: DataFrame, parts: tuple[str, ...] = (), out: str = "hits") -> DataFrame:
    """`df` with what the gazetteer knows of its place texts: array<struct<i, p, v, by_country>>, the place of the text in `texts`, its part (0 is the
    whole text; the parts of an address follow for the texts named in `parts`), and the variant of the name.

    All texts of a row are one question.  Different questions are looked up once through an inverted index of their name keys: one join against
    the gazetteer, one join back.  What was found is written and counted first: up to FOUND questions are broadcast, so that the rows of a very common
    place stay where they are instead of meeting in one task.  Rows without any text meet nothing and are spread over all partitions."""
    question = F.array(*[F.coalesce(F.col(t), F.lit("")) for t in texts])
    blank = F.forall("__q", lambda t: F.trim(t) == "")
    asked = df.withColumn("__q", question)
    asked = asked.withColumn("__q", F.when(blank, F.array(F.concat(F.lit("\x01"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string")))).otherwise(F.col("__q")))

    def pieces(text: Column, name: str) -> Column:
        return F.concat(F.array(text), F.filter(F.transform(F.split(text, rx(K.ADDRESS_SPLIT, "")), F.trim), lambda x: x != "")) if name in parts else F.array(text)

    def keyed(i: int, name: str) -> Column:
        return F.flatten(F.transform(pieces(F.get("__q", F.lit(i)), name), lambda x, p: F.array(*[
            F.struct(F.lit(i).alias("i"), p.alias("p"), F.lit(v).alias("v"), city_key(variant).alias("key")) for v, variant in enumerate(city_variants(x))])))

    questions = asked.select("__q").filter(F.size("__q") == len(texts)).filter(~F.startswith(F.get("__q", F.lit(0)), F.lit("\x01"))).distinct()
    keys = questions.select("__q", F.inline(F.concat(*[keyed(i, name) for i, name in enumerate(texts)]))).filter("key <> ''")
    known = keys.join(places, "key").groupBy("__q").agg(F.array_sort(F.collect_list(F.struct("i", "p", "v", F.map_entries("by_country").alias("e")))).alias("found"))
    found = settled(known.select("__q", F.transform("found", lambda h: F.struct(h["i"].alias("i"), h["p"].alias("p"), h["v"].alias("v"), F.map_from_entries(h["e"]).alias("by_country"))).alias(out)))
    few = found.limit(FOUND + 1).count() <= FOUND
    return asked.join(F.broadcast(found) if few else found, "__q", "left").drop("__q")


def _maps(hits: Column, i: int) -> Column:
    """The maps of the whole text `i`, in the order of its variants."""
    return F.transform(F.filter(F.coalesce(hits, F.array().cast("array<struct<i:int,p:int,v:int,by_country:map<string,string>>>")),
                                lambda h: (h["i"] == i) & (h["p"] == 0)), lambda h: h["by_country"])


def canonical_of(hits: Column, i: int, city: Column, country: Column) -> Column:
    """The canonical name of text `i` of the hits, `city`, in its country: the first variant the gazetteer knows there.  Without a country, only
    when all countries agree on one name.  Unknown names stay cleaned."""
    stated = F.coalesce(country, F.lit("")) != ""

    def name(by_country: Column) -> Column:
        names = F.array_distinct(F.map_values(by_country))
        return F.when(stated, F.try_element_at(by_country, F.upper(country))).when(F.size(names) == 1, names[0])

    first = F.get(F.array_compact(F.transform(_maps(hits, i), name)), F.lit(0))
    return F.when(F.coalesce(F.trim(city), F.lit("")) == "", city).otherwise(F.coalesce(first, cleaned_city(city)))


def homes_of(hits: Column, i: int) -> Column:
    """The countries that know text `i` of the hits by its first known variant; NULL when none does."""
    return F.map_keys(F.get(_maps(hits, i), F.lit(0)))


def region_of(hits: Column, texts: list[int], regions: Column) -> Column:
    """The one of `regions` that knows a text or a part of it; texts are tried in order."""
    every = F.coalesce(hits, F.array().cast("array<struct<i:int,p:int,v:int,by_country:map<string,string>>>"))

    def of(i: int) -> Column:
        known = F.flatten(F.transform(F.filter(every, lambda h: h["i"] == i), lambda h: F.map_keys(h["by_country"])))
        both = F.array_intersect(F.coalesce(regions, F.array().cast("array<string>")), known)
        return F.when(F.size(both) == 1, F.get(both, F.lit(0)))

    return F.coalesce(*map(of, texts))


def canonical_city(df: DataFrame, city: str, country: str, places: DataFrame, out: str = "canonical", homes: str | None = None) -> DataFrame:
    """`canonical_of` for a table that has no hits yet.  `homes` adds the countries that know the city."""
    looked = place_hits(df, [city], places, out="__hits")
    added = {out: canonical_of(F.col("__hits"), 0, F.col(city), F.col(country))}
    if homes:
        added[homes] = homes_of(F.col("__hits"), 0)
    return looked.withColumns(added).drop("__hits")


def city_conflict(df: DataFrame, city: str, country: str, places: DataFrame, out: str = "conflict") -> DataFrame:
    """True when the countries that know the city do not include the stated one."""
    homes = homes_of(F.col("__hits"), 0)
    clash = F.coalesce((F.size(homes) > 0) & ~F.array_contains(homes, F.upper(F.col(country))), F.lit(False))
    return place_hits(df, [city], places, out="__hits").withColumn(out, clash).drop("__hits")


def resolve_region(df: DataFrame, texts: list[str], regions: str, places: DataFrame, out: str = "region") -> DataFrame:
    """The one region of a source that knows a row's city, location or address part.  Texts are tried in order; all of them are looked up at once."""
    looked = place_hits(df, texts, places, parts=tuple(texts), out="__hits")
    return looked.withColumn(out, region_of(F.col("__hits"), list(range(len(texts))), F.col(regions))).drop("__hits")


# ---------------------------------------------------------------------------------------------------------------- regions
def expand_regions(df: DataFrame, tokens: str, out: str = "regions") -> DataFrame:
    """An array of region tokens (codes, aliases, names, groups) as ordered distinct codes; unknown ones in `<out>_unknown`."""
    known = region_tokens(df.sparkSession)
    joined = {t: " ".join(codes) for t, codes in known.items()}

    def codes(token: Column) -> Column:
        trimmed = F.trim(token)
        return F.coalesce(look_up(joined, F.translate(F.upper(trimmed), "- ", "__")), look_up(joined, F.lower(trimmed)))

    given = F.filter(F.col(tokens), lambda t: F.trim(t) != "")
    found = F.array_compact(F.transform(given, codes))
    return df.withColumns({out: F.array_distinct(F.flatten(F.transform(found, lambda c: F.split(c, " ")))),
                           out + "_unknown": F.filter(given, lambda t: codes(t).isNull())})


def outside_regions(df: DataFrame, country: str, project_regions: list[str]) -> DataFrame:
    """Rows whose country lies outside the project; none when the project is global or names no region."""
    if not project_regions or K.GLOBAL in project_regions:
        return df.filter(F.lit(False))
    return df.filter(F.col(country).isNotNull() & ~F.col(country).isin(*project_regions))


def countries_of(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.withColumn(out, country_code(F.col(column), SparkSession.getActiveSession()))


# ----------------------------------------------------------------------------------------------------------- source status
def source_view(sources: DataFrame, last_runs: DataFrame, reviews: DataFrame, record_counts: DataFrame, usage_today: DataFrame) -> DataFrame:
    """Registry rows with last finished run, latest review, record count and today's usage; every side is one row per
    source."""
    run = last_runs.select("source", F.col("status").alias("last_status"), F.col("started_at").alias("last_started_at"),
                           F.col("rows_stored").alias("last_rows_stored"))
    review = reviews.select("source", F.col("verdict").alias("review_verdict"))
    out = sources
    for side in (run, review, record_counts, usage_today):
        out = out.join(side, "source", "left")
    return out.withColumn("records", F.coalesce("records", F.lit(0)))


