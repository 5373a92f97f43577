"""Small dimensions: countries, regions, gazetteer, public suffixes, exchange rates."""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.core import look_up
from ..functions.text import city_key

MAX_RATES = 26 ** 3


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A few constant rows as a DataFrame that stays inside the JVM (no Python worker)."""
    names = [part.split()[0] for part in schema.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows], ensure_ascii=False)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


# ---------------------------------------------------------------------------------------------------------- countries
@lru_cache(maxsize=1)
def _countries() -> tuple[tuple[str, str, str], ...]:
    known = json.loads(resources.files(__package__).joinpath("countries.json").read_text(encoding="utf-8"))
    return tuple((code, name, currency) for code, (name, currency) in sorted(known.items()))


def countries(spark: SparkSession | None = None) -> list[tuple[str, str, str]]:
    """(ISO code, English name, currency) of every country that has a currency, from the package's own table."""
    return list(_countries())


def currency_codes(spark: SparkSession) -> list[str]:
    return sorted({c for _, _, c in countries(spark)} | set(K.EXTRA_CURRENCIES))


def country_currency(spark: SparkSession) -> dict[str, str]:
    return {code: currency for code, _, currency in countries(spark)}


def region_tokens(spark: SparkSession | None = None) -> dict[str, list[str]]:
    """Every token a region can be given by (upper-case with underscores, or a lower-case name) -> its country codes."""
    known = countries(spark)
    groups = {name: list(members) for name, members in K.REGION_GROUPS.items()}
    euro = {code for code, _, currency in known if currency == "EUR"}
    groups["EUROZONE"] = [c for c in groups["EU"] if c in euro]
    tokens = {name.lower(): [code] for code, name, _ in known}
    tokens |= {name: [code] for name, code in K.REGION_NAMES.items()}
    tokens |= groups
    tokens |= {alias: [code] for alias, code in K.REGION_ALIASES.items()}
    tokens |= {code: [code] for code, _, _ in known}
    tokens[K.GLOBAL] = [K.GLOBAL]
    return tokens


def region_dims(spark: SparkSession) -> dict[str, DataFrame]:
    """The region dimensions as DataFrames: country, token (token, position, code)."""
    country = small_table(spark, countries(spark), "code string, name string, currency string")
    rows = [(t, i, c) for t, codes in region_tokens(spark).items() for i, c in enumerate(codes)]
    return {"country": country, "token": small_table(spark, rows, "token string, position int, code string")}


def country_code(text: Column, spark: SparkSession) -> Column:
    """A stated country (code, alias, name, or a group of one) as its ISO code, else NULL."""
    single = {t: codes[0] for t, codes in region_tokens(spark).items() if len(codes) == 1}
    trimmed = F.trim(text)
    return F.coalesce(look_up(single, F.translate(F.upper(trimmed), "- ", "__")), look_up(single, F.lower(trimmed)))


def currency_of(country: Column, spark: SparkSession) -> Column:
    return look_up(country_currency(spark), country)


# ---------------------------------------------------------------------------------------------------------- gazetteer
@lru_cache(maxsize=1)
def built_in_cities() -> dict[str, dict[str, list[str]]]:
    """country -> canonical name -> other names, from the package's own file; real runs add a GeoNames dump or a JSON file."""
    return json.loads(resources.files(__package__).joinpath("cities.json").read_text(encoding="utf-8"))


def _seed_rows() -> list[tuple[str, str, str, int]]:
    return [(country, name, canonical, 0) for country, cities in built_in_cities().items() for canonical, aliases in cities.items()
            for name in [canonical, *aliases]]


def read_gazetteer(spark: SparkSession, json_path: str | None = None, geonames_path: str | None = None,
                   seed: bool = True) -> DataFrame:
    """gazetteer(country, key, canonical).  JSON files hold {country: {canonical: [aliases]}}; a GeoNames dump counts
    populated places and administrative areas only.  Earlier sources win per (country, key)."""
    names = small_table(spark, _seed_rows() if seed else [], "country string, name string, canonical string, load int")
    if json_path:
        by_country = (spark.read.text(json_path, wholetext=True)
                      .select(F.explode(F.from_json("value", "map<string,map<string,array<string>>>")).alias("country", "cities"))
                      .select("country", F.explode("cities").alias("canonical", "aliases")))
        names = names.unionByName(by_country.select(
            "country", F.explode(F.array_union(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"),
            "canonical", F.lit(1).alias("load")))
    if geonames_path:
        raw = spark.read.csv(geonames_path, sep="\t", quote="", inferSchema=False)
        places = raw.filter(F.col("_c6").isin(*K.FEATURE_CLASSES))
        aliases = F.concat(F.array("_c1", "_c2"), F.split(F.coalesce("_c3", F.lit("")), ","))
        names = names.unionByName(places.select(
            F.upper("_c8").alias("country"), F.explode(aliases).alias("name"), F.col("_c1").alias("canonical"), F.lit(2).alias("load")))
    keyed = names.select(F.upper("country").alias("country"), city_key(F.col("name")).alias("key"), "canonical", "load").filter("key <> ''")
    first = keyed.groupBy("country", "key").agg(F.min_by("canonical", F.struct("load", "canonical")).alias("canonical"))
    return first


# ----------------------------------------------------------------------------------------------------- public suffixes
def read_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """suffixes(suffix, kind) of a public-suffix list file: rule, wildcard or exception."""
    bare = F.lower(F.trim(F.regexp_replace("value", r"//.*$", "")))
    rows = spark.read.text(path).select(F.explode(F.split(bare, r"\s+")).alias("token")).filter("token <> ''")
    return rows.select(
        F.regexp_replace("token", r"^(\*\.|!)", "").alias("suffix"),
        F.when(F.startswith("token", F.lit("!")), "exception").when(F.startswith("token", F.lit("*.")), "wildcard")
        .otherwise("rule").alias("kind")).distinct()


# ------------------------------------------------------------------------------------------------------ exchange rates
def check_rates(rates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows of rates(currency, rate): three-letter codes with a finite rate above zero."""
    named = rates.select(F.upper("currency").alias("currency"), F.col("rate").try_cast("double").alias("rate"))
    fine = (named["currency"].rlike("^[A-Z]{3}$") & named["rate"].isNotNull() & ~F.isnan("rate")
            & (named["rate"] > 0) & (named["rate"] < math.inf))
    flagged = named.withColumn("fine", F.coalesce(fine, F.lit(False)))
    return flagged.filter("fine").drop("fine"), flagged.filter("NOT fine").drop("fine")


def fx_dim(rates: DataFrame, base: str = "USD") -> DataFrame:
    """fx(currency, rate): units per one unit of `base`, one row per code (at most 26^3), the base itself at 1.0."""
    if not re.fullmatch(r"[A-Za-z]{3}", base):
        raise ValueError("base must be an ISO-4217 code")
    valid, _ = check_rates(rates)
    one = valid.sparkSession.range(1).select(F.lit(base.upper()).alias("currency"), F.lit(1.0).alias("rate"))
    return (valid.filter(F.col("currency") != base.upper()).groupBy("currency").agg(F.max("rate").alias("rate"))
            .unionByName(one))


def read_fx(spark: SparkSession, path: str) -> DataFrame:
    """fx dimension from a JSON file {"base": .., "rates": {code: rate}}."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "base string, rates map<string,double>").alias("d"))
    base = (doc.select(F.coalesce("d.base", F.lit("USD"))).first() or ["USD"])[0]
    return fx_dim(doc.select(F.explode("d.rates").alias("currency", "rate")), base)


__all__ = ["countries", "currency_codes", "country_currency", "region_tokens", "region_dims", "country_code",
           "currency_of", "small_table", "read_gazetteer", "read_suffixes", "check_rates", "fx_dim", "read_fx"]
