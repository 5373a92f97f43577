"""Queries over the column normalisers.  Most are round trips: a typed column is rendered as listing text in several
notations, the normaliser reads it back, and the SQL states the typed value."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from recordworks.functions import dates, identity, money, numbers, periods, units, values
from recordworks.functions.core import moment
from recordworks.operators import lookups
from recordworks.plans.normalise import Context, capture_extra, map_fields, normalise_records
from recordworks.sources import dims
from recordworks.templates import template

from . import tables as T


def pick(index, options):
    """One of several notations per row."""
    return F.element_at(F.array(*[o if hasattr(o, "alias") else F.lit(o) for o in options]), (index + 1).cast("int"))


def pick_sql(index, options):
    return "[" + ", ".join(f"'{o}'" if o is not None else "NULL" for o in options) + f"][CAST({index} + 1 AS INT)]"


def _orders(spark, sf):
    return T.table(spark, sf, "orders")


def _grouped(amount, group, decimal):
    """1234567.8 as 1.234.567,80 and the like."""
    return F.translate(F.format_number(amount, 2), ",.", group + decimal)


def number_roundtrip(spark, sf):
    p = F.col("o_totalprice")
    shown = pick(F.col("o_orderkey") % 5, [_grouped(p, ".", ","), _grouped(p, " ", ","), F.format_number(p, 2), _grouped(p, "'", "."),
                                           F.concat(F.lit("from "), _grouped(p, " ", "."), F.lit(" net"))])
    return _orders(spark, sf).select("o_orderkey", numbers.number(shown).alias("value"))


def number_words(spark, sf):
    n = (F.col("o_totalprice") / 1000).cast("bigint")
    shown = pick(F.col("o_orderkey") % 6, [F.concat(n, F.lit(w)) for w in ["k", " тыс.", " million", " lakh", " crore", " mrd"]])
    return _orders(spark, sf).select("o_orderkey", numbers.number(shown).alias("value"))


def number_cjk(spark, sf):
    n = F.col("o_custkey") + 1
    shown = pick(F.col("o_orderkey") % 4, [F.concat(n, F.lit("万円 2LDK")), F.concat(n, F.lit("億"), n, F.lit("万円")), F.concat(n, F.lit("천만원")), F.concat(n, F.lit("만원"))])
    return _orders(spark, sf).select("o_orderkey", numbers.number(shown).alias("value"))


def integer_rounding(spark, sf):
    halves = F.concat((F.col("l_partkey") % 1000).cast("string"), F.lit("."), pick(F.col("l_orderkey") % 3, ["5", "49", "51"]))
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", numbers.integer_of(numbers.number(halves)).alias("value"))


SIGNS = [("€ ", "", "EUR"), ("", " ₸", "KZT"), ("RM", "", "MYR"), ("USD", "", "USD"), ("", " zł", "PLN"), ("kr ", "", "SEK"), ("$ ", "", "MXN"), ("", " CHF", "CHF")]


def _priced():
    return pick(F.col("o_orderkey") % 8, [F.concat(F.lit(a), F.format_number("o_totalprice", 2), F.lit(b)) for a, b, _ in SIGNS])


def money_roundtrip(spark, sf):
    parsed = money.money(_priced(), F.lit("MXN"), dims.currency_codes(spark))
    return _orders(spark, sf).select("o_orderkey", parsed.alias("m")).select("o_orderkey", "m.amount", "m.currency")


def currency_detection(spark, sf):
    return _orders(spark, sf).select("o_orderkey", money.detect_currency(_priced(), F.lit("KZT"), dims.currency_codes(spark)).alias("currency"))


def price_range(spark, sf):
    low, high = F.floor(F.col("o_totalprice")), F.floor(F.col("o_totalprice") * 2)
    shown = pick(F.col("o_orderkey") % 4, [F.concat(low, F.lit(s), high, F.lit(" €")) for s in [" – ", " - ", " to ", " bis "]])
    return _orders(spark, sf).select("o_orderkey", numbers.price_range(shown).alias("r")).select("o_orderkey", "r.low", "r.high")


AREA = [(" m²", 1.0, "sqm"), (" sqft", 0.09290304, "sqft"), ("坪", 3.305785, "tsubo"), (" ha", 10000.0, "hectare"), (" соток", 100.0, "sotka"), (" marla", None, "marla")]
DISTANCE = [(" km", 1.0, "km"), (" miles", 1.609344, "mi"), (" тыс. км", 1000.0, "km")]
WEIGHT = [(" kg", 1.0, "kg"), (" lbs", 0.45359237, "lb"), (" g", 0.001, "g")]


def _measured(kind, options):
    def build(spark, sf):
        shown = pick(F.col("l_orderkey") % len(options), [F.concat(F.lit("ca. "), F.col("l_quantity").cast("int"), F.lit(s)) for s, _, _ in options])
        parsed = units.measure(kind, shown)
        rows = T.spread(T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_linenumber")
        return rows.select("l_orderkey", "l_linenumber", parsed.alias("m")).select("l_orderkey", "l_linenumber", "m.value", "m.unit")
    return build


def _measured_sql(options, digits):
    cases = " ".join(f"WHEN {i} THEN {'NULL' if f is None else f'round(l_quantity * CAST({f!r} AS DOUBLE), {digits})'}" for i, (_, f, _) in enumerate(options))
    return (f"SELECT l_orderkey, l_linenumber, CAST(CASE l_orderkey % {len(options)} {cases} END AS DOUBLE) AS value, "
            + pick_sql(f"l_orderkey % {len(options)}", [u for _, _, u in options]) + " AS unit FROM lineitem")


PER = [("/mo", "month"), (" per week", "week"), (" за сутки", "day"), (" zł/h netto", "hour"), (" brutto jährlich", "year"), (" /m²", None), ("/ bulan", "month"), (" p.a.", "year")]


def period_lookup(spark, sf):
    shown = pick(F.col("o_orderkey") % 8, [F.concat(F.col("o_custkey").cast("string"), F.lit(t)) for t, _ in PER])
    return _orders(spark, sf).select("o_orderkey", periods.period(shown).alias("period"))


def period_conversion(spark, sf):
    source = pick(F.col("l_orderkey") % 5, ["hour", "day", "week", "month", "year"])
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", periods.convert_period(F.col("l_extendedprice"), source, "month").alias("value"))


def price_basis(spark, sf):
    shown = F.concat(F.col("o_custkey").cast("string"), pick(F.col("o_orderkey") % 5, [" / seat / month", " PSF", " €/m²", " per month", "/pax/mo"]))
    return _orders(spark, sf).select("o_orderkey", money.price_basis(shown).alias("basis"))


FUEL = ["Бензин", "Gasolina", "Diesel", "Plug-in hybrid", "steam", "plugin-hybrid", "дизель турбо"]


def enum_lookup(spark, sf):
    shown = pick(F.col("o_orderkey") % 7, FUEL)
    return _orders(spark, sf).select("o_orderkey", values.enum(shown, template("vehicles").fields["fuel_type"]).alias("fuel"))


def boolean_words(spark, sf):
    return _orders(spark, sf).select("o_orderkey", values.boolean(pick(F.col("o_orderkey") % 5, ["Yes", "нет", " JA ", "off", "maybe"])).alias("flag"))


def list_split(spark, sf):
    shown = F.concat_ws(", ", "o_orderpriority", F.lit(""), "o_orderstatus", F.lit("  "))
    return _orders(spark, sf).select("o_orderkey", F.array_join(values.text_list(shown), "|").alias("parts"))


def pattern_check(spark, sf):
    code = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    code = F.when(F.col("p_size") % 2 == 0, F.concat(code, F.lit("12"))).otherwise(code)
    fits = values.matches(code, template("products").fields["gtin"].pattern)
    return T.table(spark, sf, "part").select("p_partkey", F.when(fits, code).alias("gtin"), (~fits).alias("warned"))


def _dates():
    d = F.col("o_orderdate")
    word = pick(F.month(d) - 1, ["January", "february", "märz", "avril", "mayo", "czerwca", "July", "août", "setembro", "Okt", "Nov", "Disember"])
    return pick(F.col("o_orderkey") % 7, [
        F.date_format(d, "dd.MM.yyyy"), F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "d/M/yyyy"), F.concat_ws(" ", F.dayofmonth(d), word, F.year(d)),
        F.concat(F.lit("Listed "), word, F.lit(" "), F.dayofmonth(d), F.lit(", "), F.year(d)), F.date_format(d, "yyyy年M月d日"), F.date_format(d, "yyyy/M/d")])


def date_roundtrip(spark, sf):
    return _orders(spark, sf).select("o_orderkey", dates.datetime_text(_dates(), date_only=True, now=moment(T.NOW)).alias("day"))


def datetime_zones(spark, sf):
    # winter and summer times of zones with and without daylight saving
    ts = F.col("ts").cast("timestamp")
    shown = pick(F.col("event_id") % 3, [F.date_format(ts, "dd.MM.yyyy HH:mm"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")])
    country = pick(F.col("event_id") % 4, ["DE", "GB", "SG", "BR"])
    return T.table(spark, sf, "events").select("event_id", dates.datetime_text(shown, country, moment(T.NOW)).alias("at"))


ZONES_SQL = """
WITH e AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN '+01:00' WHEN 1 THEN '+00:00' WHEN 2 THEN '+08:00' ELSE '+00:00' END AS z FROM events)
SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:00') || z WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || z
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS at FROM e"""


def relative_dates(spark, sf):
    n = (F.col("event_id") % 50 + 2).cast("string")
    shown = pick(F.col("event_id") % 5, [F.concat(n, F.lit(" days ago")), F.concat(F.lit("hace "), n, F.lit(" horas")), "вчера", "today", F.concat(n, F.lit(" недель назад"))])
    return T.table(spark, sf, "events").select("event_id", dates.datetime_text(shown, now=moment(T.NOW)).alias("at"))


RELATIVE_SQL = f"""SELECT event_id, strftime(CASE event_id % 5 WHEN 0 THEN {T.NOW_SQL} - to_days(CAST(event_id % 50 + 2 AS INT))
  WHEN 1 THEN {T.NOW_SQL} - to_hours(event_id % 50 + 2) WHEN 2 THEN {T.NOW_SQL} - INTERVAL 1 DAY WHEN 3 THEN {T.NOW_SQL}
  ELSE {T.NOW_SQL} - to_days(CAST(7 * (event_id % 50 + 2) AS INT)) END, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM events"""


def record_uids(spark, sf):
    docs = T.table(spark, sf, "documents")
    item = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise("")
    return docs.select("doc_id", identity.record_uid(F.col("source"), item, F.concat(F.lit("u/"), F.col("doc_id"))).alias("uid"))


def fingerprints(spark, sf):
    orders = _orders(spark, sf).select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("VIN"), F.col("o_orderkey"))).alias("vin"),
                                       F.col("o_orderpriority").alias("make"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("model"),
                                       F.year("o_orderdate").cast("bigint").alias("year"), F.col("o_custkey").cast("double").alias("mileage"),
                                       (F.floor(F.col("o_totalprice") * 10) * 100).cast("double").alias("price"))
    return orders.select("o_orderkey", identity.fingerprint(template("vehicles")).alias("fingerprint"))


FINGERPRINT_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN substr(sha1('vin:vin' || o_orderkey), 1, 20)
  WHEN o_orderstatus <> 'P' THEN substr(sha1('make/model/year/mileage/price:' || lower(o_orderpriority) || '|' || lower(o_orderstatus) || '|' || year(o_orderdate)
    || '|' || o_custkey || '.0|' || CAST(floor(o_totalprice * 10) AS BIGINT) * 100 || '.0'), 1, 20) END AS fingerprint FROM orders"""


def business_fingerprints(spark, sf):
    base = T.table(spark, sf, "customer").select(
        "c_custkey", F.lit(None).cast("string").alias("registration_id"), F.lit("AE").alias("country"), F.lit(None).cast("string").alias("website"),
        F.concat(F.lit("Firm No. "), F.col("c_custkey") % 500, pick(F.col("c_custkey") % 3, [" L.L.C.", " LLC OPC", " Trading Co."])).alias("name"), F.lit("Dubai").alias("city"))
    return base.groupBy(identity.fingerprint(template("businesses")).alias("fingerprint")).agg(F.count("*").alias("n"))


# ----------------------------------------------------------------------------------------------------------------- lookups
def fx_conversion(spark, sf):
    rates = T.table(spark, sf, "nation").select(F.concat(F.lit("C"), F.lpad(F.col("n_nationkey").cast("string"), 2, "A")).alias("currency"),
                                                (F.col("n_nationkey") + 1).cast("double").alias("rate"))
    named = rates.withColumn("currency", F.translate("currency", "0123456789", "ABCDEFGHIJ"))
    fx = dims.fx_dim(named, "USD")
    customers = T.table(spark, sf, "customer").withColumns({
        "src": F.translate(F.concat(F.lit("C"), F.lpad(F.col("c_nationkey").cast("string"), 2, "A")), "0123456789", "ABCDEFGHIJ"),
        "dst": pick(F.col("c_custkey") % 3, ["USD", "CAB", "ZZZ"])})
    return lookups.convert_fx(customers, "c_acctbal", "src", "dst", fx, "value").select("c_custkey", "value")


FX_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL WHEN c_custkey % 3 = 1 AND c_nationkey = 1 THEN round(c_acctbal, 2)
  WHEN c_custkey % 3 = 0 THEN CAST(round(CAST(CAST(c_acctbal / (c_nationkey + 1) AS VARCHAR) AS DECIMAL(38, 14)), 2) AS DOUBLE)
  ELSE CAST(round(CAST(CAST(c_acctbal / (c_nationkey + 1) * 2 AS VARCHAR) AS DECIMAL(38, 14)), 2) AS DOUBLE) END AS value FROM customer"""


def fx_rates(spark, sf):
    rates = T.table(spark, sf, "nation").select(pick(F.col("n_nationkey") % 3, ["eur", "EU1", "GEL"]).alias("currency"), (F.col("n_nationkey") - 3).cast("double").alias("rate"))
    valid, rejected = dims.check_rates(rates)
    return valid.withColumn("fine", F.lit(True)).unionByName(rejected.withColumn("fine", F.lit(False)))


REGION_WORDS = ["UK", "Portugal", "caucasus", "global", "Atlantis", "de", "IBERIA"]


def region_expansion(spark, sf):
    nations = T.table(spark, sf, "supplier").select("s_suppkey", F.array(pick(F.col("s_suppkey") % 7, REGION_WORDS), F.lit("PT")).alias("tokens"))
    return lookups.expand_regions(nations, "tokens").select("s_suppkey", F.array_join("regions", ",").alias("regions"), F.array_join("regions_unknown", ",").alias("unknown"))


def outside_regions(spark, sf):
    customers = T.table(spark, sf, "customer").withColumn("country", F.when(F.col("c_nationkey") != 3, F.concat(F.lit("N"), F.col("c_nationkey"))))
    return lookups.outside_regions(customers, "country", ["N1", "N2", "N7"]).select("c_custkey", "country")


def region_dim(spark, sf):
    """Every region token of the dimension with the number of its countries, beside the customers that use it."""
    known = dims.region_dims(spark)["token"]
    used = T.table(spark, sf, "customer").select(pick(F.col("c_custkey") % 5, ["DACH", "BENELUX", "ANZ", "IBERIA", "UK"]).alias("token")).groupBy("token").agg(F.count("*").alias("customers"))
    return known.groupBy("token").agg(F.count("*").alias("codes"), F.md5(F.array_join(F.sort_array(F.collect_list("code")), ",")).alias("digest")).join(
        used, "token", "left").select("token", "codes", "digest", F.coalesce("customers", F.lit(0)).alias("customers"))


REGION_SQL = f"""WITH t AS (SELECT * FROM (VALUES {", ".join(f"({t!r}, {codes!r})" if "'" not in t else f'($${t}$$, {codes!r})' for t, codes in dims.region_tokens().items())}) v(token, codes)),
  u AS (SELECT ['DACH', 'BENELUX', 'ANZ', 'IBERIA', 'UK'][CAST(c_custkey % 5 + 1 AS INT)] AS token, count(*) AS customers FROM customer GROUP BY ALL)
SELECT t.token, len(codes) AS codes, md5(array_to_string(list_sort(codes), ',')) AS digest, coalesce(customers, 0) AS customers FROM t LEFT JOIN u ON u.token = t.token"""

CITIES = ["Lisboa", "München", "г. Тбилиси", "Unknownville", "London EC2A 4NE", "Den Haag (Zuid-Holland)", "Berlin; Munich; Remote"]
CITY_COUNTRY = ["PT", "DE", "GE", "PT", "GB", "NL", "DE"]
CITY_NAMES = ["Lisbon", "Munich", "Tbilisi", "Unknownville", "London", "The Hague", "Berlin"]


def city_names(spark, sf):
    rows = T.table(spark, sf, "customer").select("c_custkey", pick(F.col("c_custkey") % 7, CITIES).alias("city"), pick(F.col("c_custkey") % 7, CITY_COUNTRY).alias("country"))
    places = lookups.city_dim(dims.read_gazetteer(spark))
    return lookups.canonical_city(rows, "city", "country", places, "name").select("c_custkey", "name")


def city_conflicts(spark, sf):
    rows = T.table(spark, sf, "customer").select("c_custkey", pick(F.col("c_custkey") % 7, CITIES).alias("city"), F.lit("DE").alias("country"))
    return lookups.city_conflict(rows, "city", "country", lookups.city_dim(dims.read_gazetteer(spark))).select("c_custkey", "conflict")


def row_regions(spark, sf):
    rows = T.table(spark, sf, "customer").select(
        "c_custkey", pick(F.col("c_custkey") % 4, ["Shoreditch, London", "Dublin", "Online", "Main St, Berlin"]).alias("location"), F.array(F.lit("GB"), F.lit("IE")).alias("regions"))
    return lookups.resolve_region(rows, ["location"], "regions", lookups.city_dim(dims.read_gazetteer(spark))).select("c_custkey", "region")


PLACES = [("Lisboa", "Rua A", "x"), ("", "Shoreditch, London", "Dublin"), ("Nowhere", "Online", "Main St - Dublin"), ("", "", "Friedrichstr. 1 | Berlin"), ("Porto", "", ""), ("", "", "")]


def event_places(spark, sf):
    """City, location and address of each event looked up at once for sources of several regions: the region, the city's name and a conflict."""
    k = F.col("event_id") % 6
    rows = T.table(spark, sf, "events").select("event_id", *[pick(k, [p[i] for p in PLACES]).alias(n) for i, n in enumerate(("city", "location", "address"))],
                                               F.when(F.col("event_id") % 2 == 0, F.array(F.lit("GB"), F.lit("IE"), F.lit("PT"))).otherwise(F.array(F.lit("IE"), F.lit("DE"))).alias("regions"))
    looked = lookups.place_hits(rows, ["city", "location", "address"], lookups.city_dim(dims.read_gazetteer(spark)), ("city", "location", "address"))
    hits = F.col("hits")
    return looked.select("event_id", lookups.region_of(hits, [0, 1, 2], F.col("regions")).alias("region"), lookups.canonical_of(hits, 0, F.col("city"), F.lit("PT")).alias("name"),
                         F.array_join(F.array_sort(lookups.homes_of(hits, 0)), ",").alias("homes"))


EVENT_PLACES_SQL = f"""SELECT event_id, {pick_sql('event_id % 6', ['PT', 'IE', 'IE', 'DE', 'PT', None])} AS region,
  {pick_sql('event_id % 6', ['Lisbon', '', 'Nowhere', '', 'Porto', ''])} AS name, {pick_sql('event_id % 6', ['PT', None, None, None, 'PT', None])} AS homes FROM events"""


# -------------------------------------------------------------------------------------------------------- nested raw rows
def mapped_fields(spark, sf):
    raw = T.table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(
        F.struct(F.col("p_brand").alias("brand"), F.array("p_type", "p_name").alias("tags")).alias("specs"))).alias("raw"))
    return map_fields(raw, {"make": "specs.brand", "kind": "specs.tags.0", "title": "specs.tags.-1", "currency": "=GEL"}).drop("raw")


def extra_keys(spark, sf):
    raw = T.table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("shelf"), F.lit(1).alias("_hidden"),
                                                                            F.lit("kg").alias("weight_unit"))).alias("raw"))
    return capture_extra(raw, template("products")).select("p_partkey", "extra")


def _raw_vehicles(spark, sf):
    p = F.col("o_totalprice")
    body = F.struct(
        F.col("o_orderkey").cast("string").alias("source_id"), F.concat(F.lit("/cars/"), F.col("o_orderkey")).alias("url"),
        F.concat(F.lit("<b>Car</b> "), "o_orderpriority").alias("title"), F.when(F.col("o_custkey") % 10 != 0, pick(F.col("o_orderkey") % 3, ["BMW", "Lada", "Toyota"])).alias("make"),
        F.concat(_grouped(p, " ", ","), F.lit(" ₸")).alias("price"), F.concat(F.lit("Year "), F.year("o_orderdate")).alias("year"),
        F.concat(F.col("o_custkey") % 300, F.lit(" тыс. км")).alias("mileage"), pick(F.col("o_orderkey") % 7, FUEL).alias("fuel_type"),
        F.lit("Алматы").alias("city"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("posted_at"))
    return T.spread(_orders(spark, sf), "o_orderkey").select(F.concat(F.lit("src"), F.col("o_custkey") % 20).alias("source"), F.to_json(body).alias("raw"))


def normalised(spark, sf):
    rates = dims.fx_dim(dims.small_table(spark, [("KZT", 500.0)], "currency string, rate double"))
    ctx = Context(regions=["KZ"], base_url="https://cars.example.kz/list", now=dt.datetime(2026, 10, 1))
    return normalise_records(_raw_vehicles(spark, sf), template("vehicles", year=2026), ctx, dims.read_gazetteer(spark), rates)


def normalise_vehicles(spark, sf):
    return normalised(spark, sf).select("source_id", "url", "title", "make", "price", "currency", "price_report", "year", "mileage", "fuel_type", "city", "country",
                                        "posted_at", F.array_join("reasons", "; ").alias("reasons"))


NORMALISE_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS source_id, 'https://cars.example.kz/cars/' || o_orderkey AS url, 'Car ' || o_orderpriority AS title,
  CASE WHEN o_custkey % 10 <> 0 THEN ['BMW', 'Lada', 'Toyota'][CAST(o_orderkey % 3 + 1 AS INT)] END AS make, o_totalprice AS price, 'KZT' AS currency,
  CAST(round(CAST(CAST(o_totalprice / 500 AS VARCHAR) AS DECIMAL(38, 14)), 2) AS DOUBLE) AS price_report, year(o_orderdate) AS year, CAST((o_custkey % 300) * 1000 AS DOUBLE) AS mileage,
  ['petrol', 'petrol', 'diesel', 'plugin_hybrid', 'other', 'plugin_hybrid', 'diesel'][CAST(o_orderkey % 7 + 1 AS INT)] AS fuel_type,
  'Almaty' AS city, 'KZ' AS country, strftime(o_orderdate, '%Y-%m-%dT00:00:00+00:00') AS posted_at,
  concat_ws('; ', CASE WHEN o_custkey % 10 = 0 THEN 'missing required field make' END,
    CASE WHEN o_totalprice / 500 < 100 THEN 'price=' || CAST(o_totalprice AS VARCHAR) || ' KZT is below 100 USD' END) AS reasons
FROM orders"""

def _offers(spark, sf, source, **fields):
    """Raw rows of other record types, one for each order."""
    n = F.col("o_orderkey")
    body = F.struct(n.cast("string").alias("source_id"), F.concat(F.lit("https://x.test/"), n).alias("url"), *[c.alias(k) for k, c in fields.items()])
    return T.spread(_orders(spark, sf), "o_orderkey").select(F.lit(source).alias("source"), F.to_json(body).alias("raw"), F.array(F.lit("FR"), F.lit("IT")).alias("regions"))


def normalise_rents(spark, sf):
    """Rents quoted per month, per week in a field of its own, or without a period."""
    n, k = F.col("o_custkey") % 1000 + 1500, F.col("o_orderkey") % 3
    raw = _offers(spark, sf, "rents", title=F.lit("Mieszkanie"), price=F.when(k == 0, F.concat(n, F.lit(" zł / miesiąc"))).otherwise(n.cast("string")), rent_period=F.when(k == 1, "weekly"),
                  area=F.concat(F.col("o_custkey") % 90 + 20, F.lit(" m²")), property_type=F.lit("wohnung"), city=F.lit("Kraków"))
    rates = dims.fx_dim(dims.small_table(spark, [("PLN", 4.0)], "currency string, rate double"))
    out = normalise_records(raw, template("real_estate_rent"), Context(regions=["PL"], now=dt.datetime(2026, 10, 1)), dims.read_gazetteer(spark), rates)
    return out.select("source_id", "rent_period", "price_per_month", "currency", "area", "property_type", "city", F.array_join("reasons", "; ").alias("reasons"))


RENTS_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS source_id, CASE WHEN o_orderkey % 3 = 1 THEN 'week' ELSE 'month' END AS rent_period,
  CASE WHEN o_orderkey % 3 = 1 THEN round((o_custkey % 1000 + 1500) * 52 / 12, 2) ELSE CAST(o_custkey % 1000 + 1500 AS DOUBLE) END AS price_per_month, 'PLN' AS currency,
  CAST(o_custkey % 90 + 20 AS DOUBLE) AS area, 'apartment' AS property_type, 'Krakow' AS city, '' AS reasons FROM orders"""


def normalise_jobs(spark, sf):
    """Salaries of sources of several regions: the city or the location tells the country; the currency is the one that all regions share."""
    n, k = F.col("o_custkey") % 50 + 20, F.col("o_orderkey") % 4
    raw = _offers(spark, sf, "jobs", title=F.lit("Nurse"), salary_min=F.when(k < 2, F.concat(n, F.lit(" 00 € pro Monat"))).when(k == 2, F.concat(n, F.lit("000"))),
                  city=F.when(k == 0, "Milano").when(k == 1, "Nowhere"), location=F.when(k == 2, "Rue X, Paris"))
    out = normalise_records(raw, template("jobs"), Context(now=dt.datetime(2026, 10, 1)), dims.read_gazetteer(spark), None)
    return out.select("source_id", "salary_period", "salary_min_annual", "currency", "country", "city")


JOBS_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS source_id, ['month', 'month', 'year', NULL][CAST(o_orderkey % 4 + 1 AS INT)] AS salary_period,
  CASE WHEN o_orderkey % 4 < 2 THEN (o_custkey % 50 + 20) * 1200.0 WHEN o_orderkey % 4 = 2 THEN (o_custkey % 50 + 20) * 1000.0 END::DOUBLE AS salary_min_annual, CASE WHEN o_orderkey % 4 < 3 THEN 'EUR' END AS currency,
  ['IT', NULL, 'FR', NULL][CAST(o_orderkey % 4 + 1 AS INT)] AS country, ['Milan', 'Nowhere', NULL, NULL][CAST(o_orderkey % 4 + 1 AS INT)] AS city FROM orders"""


def normalise_events(spark, sf):
    """Events with dates in words, some ended, in a project of two countries."""
    k = F.col("o_orderkey") % 3
    raw = _offers(spark, sf, "events", title=F.concat(F.lit("Fair "), "o_custkey"), starts_at=F.when(k == 0, "3 March 2033 20:00").when(k == 1, "2033-03-04").otherwise("2020-01-05"),
                  country=F.when(k == 1, "Portugal").otherwise("Austria"), price_min=F.lit("12 €"))
    out = normalise_records(raw, template("events"), Context(regions=["AT"], project_regions=["AT", "CZ"], now=dt.datetime(2026, 10, 1)), dims.read_gazetteer(spark), None)
    return out.select("source_id", "title", F.substring("starts_at", 1, 10).alias("day"), "country", "price_min", "currency", F.array_join("reasons", "; ").alias("reasons"))


EVENTS_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS source_id, 'Fair ' || o_custkey AS title, ['2033-03-03', '2033-03-04', '2020-01-05'][CAST(o_orderkey % 3 + 1 AS INT)] AS day,
  CASE WHEN o_orderkey % 3 = 1 THEN 'PT' ELSE 'AT' END AS country, 12.0::DOUBLE AS price_min, 'EUR' AS currency,
  ['', 'country PT is outside the project''s regions (AT, CZ)', 'event already ended (2020-01-05)'][CAST(o_orderkey % 3 + 1 AS INT)] AS reasons FROM orders"""

_M = "o_orderkey % 8"
QUERIES = {
    "number_roundtrip": (number_roundtrip, "SELECT o_orderkey, o_totalprice AS value FROM orders"),
    "number_words": (number_words, """SELECT o_orderkey, CAST(trunc(o_totalprice / 1000) AS DOUBLE) * [1e3, 1e3, 1e6, 1e5, 1e7, 1e9][CAST(o_orderkey % 6 + 1 AS INT)] AS value FROM orders"""),
    "number_cjk": (number_cjk, """SELECT o_orderkey, CAST((o_custkey + 1) AS DOUBLE) * [1e4, 100010000, 1e7, 1e4][CAST(o_orderkey % 4 + 1 AS INT)] AS value FROM orders"""),
    "integer_rounding": (integer_rounding, """SELECT l_orderkey, l_linenumber, CAST(CASE l_orderkey % 3 WHEN 0 THEN l_partkey % 1000 + l_partkey % 2
        WHEN 1 THEN l_partkey % 1000 ELSE l_partkey % 1000 + 1 END AS BIGINT) AS value FROM lineitem"""),
    "money_roundtrip": (money_roundtrip, f"SELECT o_orderkey, o_totalprice AS amount, {pick_sql(_M, [c for _, _, c in SIGNS])} AS currency FROM orders"),
    "currency_detection": (currency_detection, f"SELECT o_orderkey, {pick_sql(_M, ['EUR', 'KZT', 'MYR', 'KZT', 'PLN', 'SEK', 'USD', 'CHF'])} AS currency FROM orders"),
    "price_range": (price_range, "SELECT o_orderkey, floor(o_totalprice) AS low, floor(o_totalprice * 2) AS high FROM orders"),
    "area_units": (_measured("area", AREA), _measured_sql(AREA, 2)),
    "distance_units": (_measured("distance", DISTANCE), _measured_sql(DISTANCE, 1)),
    "weight_units": (_measured("weight", WEIGHT), _measured_sql(WEIGHT, 4)),
    "period_lookup": (period_lookup, f"SELECT o_orderkey, {pick_sql('o_orderkey % 8', [p for _, p in PER])} AS period FROM orders"),
    "period_conversion": (period_conversion, """SELECT l_orderkey, l_linenumber,
        CAST(round(CAST(CAST(l_extendedprice * [2080.0, 365.0, 52.0, 12.0, 1.0][CAST(l_orderkey % 5 + 1 AS INT)]::DOUBLE / 12 AS VARCHAR) AS DECIMAL(38, 14)), 2) AS DOUBLE) AS value FROM lineitem"""),
    "price_basis": (price_basis, f"SELECT o_orderkey, {pick_sql('o_orderkey % 5', ['per_person', 'per_area', 'per_area', None, 'per_person'])} AS basis FROM orders"),
    "enum_lookup": (enum_lookup, f"SELECT o_orderkey, {pick_sql('o_orderkey % 7', ['petrol', 'petrol', 'diesel', 'plugin_hybrid', 'other', 'plugin_hybrid', 'diesel'])} AS fuel FROM orders"),
    "boolean_words": (boolean_words, "SELECT o_orderkey, [true, false, true, false, NULL][CAST(o_orderkey % 5 + 1 AS INT)] AS flag FROM orders"),
    "list_split": (list_split, "SELECT o_orderkey, o_orderpriority || '|' || o_orderstatus AS parts FROM orders"),
    "pattern_check": (pattern_check, """SELECT p_partkey, CASE WHEN length(c) >= 8 THEN c END AS gtin, length(c) < 8 AS warned FROM
        (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 6, '0') || CASE WHEN p_size % 2 = 0 THEN '12' ELSE '' END AS c FROM part)"""),
    "date_roundtrip": (date_roundtrip, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"),
    "datetime_zones": (datetime_zones, ZONES_SQL),
    "relative_dates": (relative_dates, RELATIVE_SQL),
    "record_uids": (record_uids, """SELECT doc_id, sha1(source || chr(0) || CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'u/' || doc_id END) AS uid FROM documents"""),
    "fingerprints": (fingerprints, FINGERPRINT_SQL),
    "business_fingerprints": (business_fingerprints, """SELECT substr(sha1('name/city:firm no ' || (c_custkey % 500) || '|dubai'), 1, 20) AS fingerprint, count(*) AS n
        FROM customer GROUP BY 1"""),
    "fx_conversion": (fx_conversion, FX_SQL),
    "fx_rates": (fx_rates, """SELECT upper(c) AS currency, rate, c <> 'EU1' AND rate > 0 AS fine FROM
        (SELECT ['eur', 'EU1', 'GEL'][CAST(n_nationkey % 3 + 1 AS INT)] AS c, CAST(n_nationkey - 3 AS DOUBLE) AS rate FROM nation)"""),
    "region_expansion": (region_expansion, f"""SELECT s_suppkey, {pick_sql('s_suppkey % 7', ['GB,PT', 'PT', 'AM,AZ,GE,PT', 'GLOBAL,PT', 'PT', 'DE,PT', 'ES,PT'])} AS regions,
        CASE WHEN s_suppkey % 7 = 4 THEN 'Atlantis' ELSE '' END AS unknown FROM supplier"""),
    "outside_regions": (outside_regions, "SELECT c_custkey, 'N' || c_nationkey AS country FROM customer WHERE c_nationkey NOT IN (1, 2, 3, 7)"),
    "region_dim": (region_dim, REGION_SQL),
    "city_names": (city_names, f"SELECT c_custkey, {pick_sql('c_custkey % 7', CITY_NAMES)} AS name FROM customer"),
    "city_conflicts": (city_conflicts, "SELECT c_custkey, c_custkey % 7 IN (0, 2, 4, 5) AS conflict FROM customer"),
    "event_places": (event_places, EVENT_PLACES_SQL),
    "row_regions": (row_regions, "SELECT c_custkey, ['GB', 'IE', NULL, NULL][CAST(c_custkey % 4 + 1 AS INT)] AS region FROM customer"),
    "mapped_fields": (mapped_fields, "SELECT p_partkey, p_brand AS make, p_type AS kind, p_name AS title, 'GEL' AS currency FROM part"),
    "extra_keys": (extra_keys, """SELECT p_partkey, '{"shelf":"' || p_brand || '"}' AS extra FROM part"""),
    "normalise_vehicles": (normalise_vehicles, NORMALISE_SQL),
    "normalise_rents": (normalise_rents, RENTS_SQL),
    "normalise_jobs": (normalise_jobs, JOBS_SQL),
    "normalise_events": (normalise_events, EVENTS_SQL),
}
