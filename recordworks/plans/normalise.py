"""Raw rows -> typed records with quarantine reasons and parse warnings.

The template generates the columns.  All fields move through the same few projections together, so the plan is as deep for
forty fields as for one; the only joins are against the gazetteer and the exchange rates.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.core import each, let, moment, one_of
from ..functions.dates import datetime_text
from ..functions.identity import fingerprint, record_uid
from ..functions.money import detect_currency, money, price_basis
from ..functions.numbers import integer_of, number
from ..functions.periods import convert_period, period
from ..functions.text import clean_text
from ..functions.units import measure
from ..functions.values import absolute_url, boolean, enum_of, matches, text_list
from ..operators import quality
from ..operators.lookups import canonical_of, city_dim, homes_of, place_hits, region_of, unique_rates
from ..sources.dims import country_code, country_currency, currency_codes, currency_of
from ..templates import Field, Template

PLACE_FIELDS = ("city", "location", "address")


@dataclass(frozen=True)
class Context:
    """What a job knows beside the rows.  `regions` is the regions of all rows' sources; None reads them from the column
    `regions` of the raw rows, as `base_url` is read from the column of that name when it is None here."""

    regions: list[str] | None = None
    base_url: str | None = None
    default_currency: str | None = None
    report_currency: str = "USD"
    project_regions: list[str] = field(default_factory=list)
    field_map: dict[str, str] = field(default_factory=dict)
    now: Column | dt.datetime | None = None


def _json_path(path: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f'["{p}"]' for p in path.split("."))


def mapped_value(raw: Column, path: str) -> Column:
    """A dotted path into a VARIANT ('offers.price', 'images.0.url', negative list indexes count from the end)."""
    if not re.search(r"(^|\.)-\d+(\.|$)", path):
        return F.try_variant_get(raw, _json_path(path), "variant")
    value = raw
    for part in path.split("."):
        if re.fullmatch(r"-?\d+", part):
            index = int(part)
            value = F.try_element_at(F.try_variant_get(value, "$", "array<variant>"), F.lit(index if index < 0 else index + 1))
        else:
            value = F.try_variant_get(value, f'$["{part}"]', "variant")
    return value


def _value(raw: Column, name: str, field_map: dict[str, str]) -> Column:
    source = field_map.get(name)
    if source and source.startswith("="):
        return F.lit(source[1:]).cast("variant")
    return mapped_value(raw, source) if source else F.try_variant_get(raw, f'$["{name}"]', "variant")


def map_fields(df: DataFrame, field_map: dict[str, str], raw: str = "raw") -> DataFrame:
    """The mapped template fields of a JSON text column as strings."""
    doc = F.try_parse_json(raw)
    return df.withColumns({name: F.try_variant_get(_value(doc, name, field_map), "$", "string") for name in field_map})


def _raw(name: str) -> Column:
    return F.col(f"__raw_{name}")


def _num(name: str) -> Column:
    return F.col(f"__num_{name}")


def _is_text(name: str) -> Column:
    return _raw(name).isNotNull() & _num(name).isNull()


_WITH_NUMBERS = {"integer", "number", "money", "area", "distance", "weight", "date", "datetime"}


def _is_number(value: Column) -> Column:
    return F.schema_of_variant(value).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")


def _first_key(value: Column, *keys: str) -> Column:
    return F.coalesce(*[F.try_variant_get(value, f"$.{k}", "variant") for k in keys])


def _offer_text(value: Column) -> Column:
    """An offer object (price / amount / value, priceCurrency / currency) as the text 'amount CURRENCY'.  A number keeps four decimals, so that
    its point can't be read as a thousands mark."""
    amount = _first_key(value, *K.OFFER_AMOUNT_KEYS)
    number = F.format_string("%.4f", F.try_variant_get(amount, "$", "double"))
    text = F.when(_is_number(amount), number).otherwise(F.try_variant_get(amount, "$", "string"))
    return F.when(text.isNotNull(), F.concat_ws(" ", text, F.upper(F.try_variant_get(_first_key(value, *K.OFFER_CURRENCY_KEYS), "$", "string"))))


def _extract(raw: DataFrame, template: Template, field_map: dict[str, str]) -> DataFrame:
    """One JSON parse per row, then text (and number, where the type cares) of every field."""
    df = raw.withColumn("__doc", F.try_parse_json("raw"))
    df = df.withColumns({f"__var_{n}": _value(F.col("__doc"), n, field_map) for n in template.fields})
    columns: dict[str, Column] = {"__is_object": F.coalesce(F.startswith(F.schema_of_variant("__doc"), F.lit("OBJECT")), F.lit(False))}
    for name, f in template.fields.items():
        value = F.col(f"__var_{name}")
        text = F.try_variant_get(value, "$", "string")
        if f.type in ("string", "text"):
            text = F.when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")),
                          F.array_join(F.try_variant_get(value, "$", "array<string>"), " ")).otherwise(text)
        elif f.type == "money":
            text = F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), _offer_text(value)).otherwise(text)
        columns[f"__raw_{name}"] = text
        if f.type in _WITH_NUMBERS:
            columns[f"__num_{name}"] = F.when(_is_number(value), F.try_variant_get(value, "$", "double"))
        elif f.type == "list":
            columns[f"__arr_{name}"] = F.try_variant_get(value, "$", "array<string>")
        elif f.type == "object":
            columns[f"__obj_{name}"] = F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), text)
        if f.type in ("area", "distance", "weight"):
            columns[f"__hint_{name}"] = F.try_variant_get(_value(F.col("__doc"), name + "_unit", field_map), "$", "string")
    return df.withColumns(columns).drop(*[f"__var_{n}" for n in template.fields])


def _regions(df: DataFrame, template: Template, ctx: Context, places: DataFrame | None) -> DataFrame:
    """Country and default currency of each row, and in `__hits` what the gazetteer knows of its places: the cleaned city, and for sources of several
    regions the texts that may tell the region.  All of it is one lookup.  A source of several regions never lends a row its first one: the row's own
    country or a city that only one of the regions knows decides."""
    spark = df.sparkSession
    if ctx.regions is not None:
        given = [r for r in dict.fromkeys(ctx.regions) if r and r != K.GLOBAL]
        df = df.withColumn("__regions", F.array(*map(F.lit, given)).cast("array<string>"))
    else:
        given = None
        df = df.withColumn("__regions", F.array_distinct(F.filter(F.coalesce("regions", F.array().cast("array<string>")),
                                                                  lambda r: r != K.GLOBAL)))
    texts = [n for n in PLACE_FIELDS if n in template.fields] if given is None or len(given) > 1 else []
    city = ["__city"] if "city" in template.fields else []
    if places is not None and (texts or city):
        if city:
            df = df.withColumn("__city", clean_text(_raw("city")))
        several = F.size("__regions") > 1
        needs = several & (country_code(_raw("country"), spark).isNull() if "country" in template.fields else F.lit(True))
        df = df.withColumns({f"__at_{n}": F.when(needs, _raw(n)) for n in texts})
        df = place_hits(df, [*city, *[f"__at_{n}" for n in texts]], places, tuple(f"__at_{n}" for n in texts), "__hits").drop(*[f"__at_{n}" for n in texts])
    explicit = F.lit(ctx.default_currency).cast("string")
    only = F.get("__regions", F.lit(0))
    if given is not None and len(given) <= 1:
        home = given[0] if given else None
        currency = ctx.default_currency or (country_currency(spark).get(home) if home else None)
        return df.withColumns({"__region": F.lit(home).cast("string"), "__dcur": F.lit(currency).cast("string"), "__several": F.lit(False)})
    several = F.size("__regions") > 1
    stated = country_code(_raw("country"), spark) if "country" in template.fields else F.lit(None).cast("string")
    df = df.withColumns({"__several": several, "__stated": F.when(several, stated)})
    found = F.lit(None).cast("string")
    if places is not None and texts:
        found = region_of(F.col("__hits"), [len(city) + i for i in range(len(texts))], F.col("__regions"))
    country = F.when(F.col("__several"), F.coalesce(F.col("__stated"), found)).otherwise(only)
    df = df.withColumn("__region", country)
    currencies = F.array_distinct(F.transform("__regions", lambda r: currency_of(r, spark)))
    shared = F.when(F.col("__several") & (F.size(currencies) == 1), currencies[0])
    return df.withColumn("__dcur", F.coalesce(explicit, currency_of(F.col("__region"), spark), F.when(F.col("__region").isNull(), shared)))


def _parse_fields(df: DataFrame, template: Template, ctx: Context, codes: list[str], now: Column, base: Column | None) -> DataFrame:
    """Every field to its type.  Fields of one kind are parsed by one expression over an array (`each`), so the plan and the
    generated code stay small however many fields the template has."""
    def of(*types: str) -> list[Field]:
        return template.of_type(*types)

    texts, moneys, dates = of("string", "text", "enum"), of("money"), of("date", "datetime")
    plain = of("integer", "number")
    inputs: dict[str, Column] = {}
    if texts:
        inputs["__texts"] = each([_raw(f.name) for f in texts], lambda t: clean_text(t))
    if plain:
        inputs["__plain"] = each([F.when(_num(f.name).isNull(), _raw(f.name)) for f in plain], lambda t: number(t))
    if moneys:
        pairs = [F.struct(F.when(_num(f.name).isNull(), _raw(f.name)).alias("t"), F.col(f"__cur_{f.currency_field}").alias("c"))
                 for f in moneys]
        inputs["__money"] = each(pairs, lambda p: money(p["t"], p["c"], codes))
    readers = {True: lambda p: datetime_text(p["t"], F.col("__region"), now, True, p["n"]),
               False: lambda p: datetime_text(p["t"], F.col("__region"), now, False, p["n"])}
    for day, reader in readers.items():
        chosen = [f for f in dates if (f.type == "date") is day]
        if chosen:
            inputs[f"__dates_{day}"] = each([F.struct(_raw(f.name).alias("t"), _num(f.name).alias("n")) for f in chosen], reader)
    if of("url"):
        inputs["__urls"] = each([F.nullif(_raw(f.name), F.lit("")) for f in of("url")], lambda u: absolute_url(u, base))
    if of("period"):
        inputs["__stated"] = each([_raw(f.name) for f in of("period")], lambda t: period(t))
    for f in of("area", "distance", "weight"):
        inputs[f"__unit_{f.name}"] = measure(f.type, _raw(f.name), F.col(f"__hint_{f.name}"), _num(f.name))
    df = df.withColumns(inputs)
    out: dict[str, Column] = {}
    for i, f in enumerate(texts):
        value = F.get("__texts", F.lit(i))
        if f.type == "enum":
            out[f.name] = enum_of(F.when(_raw(f.name).isNotNull(), F.lower(F.coalesce(value, F.lit("")))), f)
        else:
            out[f.name] = F.replace(F.upper(value), F.lit(" "), F.lit("")) if f.upper else value
    for i, f in enumerate(plain):
        value = F.coalesce(_num(f.name), F.get("__plain", F.lit(i)))
        out[f.name] = integer_of(value) if f.type == "integer" else value
    for i, f in enumerate(moneys):
        parsed = F.get("__money", F.lit(i))
        out[f.name] = F.coalesce(_num(f.name), parsed["amount"])
        out[f"cur_of_{f.name}"] = F.when(_num(f.name).isNull(), parsed["currency"]).otherwise(F.col(f"__cur_{f.currency_field}"))
    for day in readers:
        for i, f in enumerate(f for f in dates if (f.type == "date") is day):
            out[f.name] = F.get(f"__dates_{day}", F.lit(i))
    for i, f in enumerate(of("url")):
        out[f.name] = F.get("__urls", F.lit(i))
    for i, f in enumerate(of("period")):
        out[f.name] = F.get("__stated", F.lit(i))
    for f in of("area", "distance", "weight"):
        out[f.name], out[f.name + "_unit"] = F.col(f"__unit_{f.name}.value"), F.col(f"__unit_{f.name}.unit")
    for f in of("boolean"):
        out[f.name] = boolean(_raw(f.name))
    for f in of("list"):
        out[f.name] = F.coalesce(F.col(f"__arr_{f.name}"), text_list(_raw(f.name)))
    for f in of("object"):
        out[f.name] = F.col(f"__obj_{f.name}")
    return df.withColumns(out).drop(*inputs)


def _currencies(template: Template, spark_codes: list[str], ctx: Context) -> dict[str, Column]:
    out = {}
    for f in template.of_type("currency"):
        code = F.upper(F.trim(_raw(f.name)))
        none = F.lit(None).cast("string")
        out[f"__cur_{f.name}"] = F.when(one_of(code, spark_codes), code).when(
            F.coalesce(_raw(f.name), F.lit("")) != "", detect_currency(_raw(f.name), none, spark_codes))
    return out


def _warnings(template: Template) -> list[Column]:
    out = []
    for name, f in template.fields.items():
        if f.type in ("currency", "period", "country"):
            continue
        given = F.coalesce(_raw(name), F.lit("")).isin("", "[]", "{}")
        out.append(F.when(~given & F.col(name).isNull(), F.concat(F.lit(f"{name}: could not parse "), _raw(name))))
        if f.type == "area":
            out.append(F.when(_raw(name).isNotNull() & F.col(name).isNull() & F.col(name + "_unit").isNotNull(),
                              F.concat(F.lit(f"{name}: unit "), F.col(name + "_unit"), F.lit(" is not converted (regional definitions vary)"))))
        if f.type == "money":
            mine, kept = F.col(f"cur_of_{name}"), F.col(f"__cur_{f.currency_field}")
            out.append(F.when(F.col(name).isNotNull() & (mine != kept), F.concat(
                F.lit(f"{name}: currency "), mine, F.lit(f" in text differs from {f.currency_field}="), kept, F.lit("; kept "), kept)))
    return out


def _extra(template: Template, ctx: Context) -> Column:
    """Keys the template does not know, plus the wording of unmapped enums and cities, as JSON."""
    taken = [*template.fields, *{p.split(".")[0] for p in ctx.field_map.values() if not p.startswith("=")}]
    document = F.coalesce(F.try_variant_get("__doc", "$", "map<string,variant>"), F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<variant>")))
    unknown = F.map_filter(document, lambda k, _: ~one_of(k, taken) & ~F.endswith(k, F.lit("_unit")) & ~F.startswith(k, F.lit("_")))
    kept = []
    for f in template.of_type("enum"):
        raw = _raw(f.name)
        unmapped = F.coalesce(F.col(f.name), F.lit("other")).isin("other") & (raw != "") & (F.lower(F.trim(raw)) != "other")
        kept.append(F.when(unmapped, F.struct(F.lit(f.name + "_raw").alias("k"), clean_text(raw).cast("variant").alias("v"))))
    if "city" in template.fields:
        kept.append(F.when(F.col("city") != F.col("__city"), F.struct(F.lit("city_raw").alias("k"), F.col("__city").cast("variant").alias("v"))))
    def written(entries: Column) -> Column:
        return F.to_json(entries)

    both = F.map_concat(unknown, F.map_from_entries(F.array_compact(F.array(*kept)))) if kept else unknown
    return let(both, lambda entries: F.when(F.size(entries) > 0, written(entries)))


def capture_extra(df: DataFrame, template: Template, raw: str = "raw", field_map: dict[str, str] | None = None) -> DataFrame:
    """Only the unknown keys of a JSON text column as JSON."""
    fields = {n: Field(n, "string") for n in template.fields if n != "city"}
    known_city = "city" in template.fields
    document = df.withColumn("__doc", F.try_parse_json(raw))
    extra = _extra(Template(template.record_type, fields), Context(field_map={**(field_map or {}), **({"city": "city"} if known_city else {})}))
    return document.withColumn("extra", extra).drop("__doc")


def normalise_records(raw: DataFrame, template: Template, ctx: Context | None = None, gazetteer: DataFrame | None = None,
                      fx: DataFrame | None = None) -> DataFrame:
    """raw(source, raw JSON, ..) -> the record columns with `extra`, `fingerprint`, `uid`, `reasons` and `warnings`.  Rows without
    reasons are accepted.  Other columns of `raw` pass through."""
    ctx = ctx or Context()
    spark = raw.sparkSession
    codes = currency_codes(spark)
    now = moment(ctx.now)
    places = city_dim(gazetteer) if gazetteer is not None else None
    passing = [c for c in raw.columns if c not in ("base_url", "regions")]
    base = F.lit(ctx.base_url) if ctx.base_url else F.col("base_url") if "base_url" in raw.columns else None
    df = _regions(_extract(raw, template, ctx.field_map), template, ctx, places)
    df = df.withColumns(_currencies(template, codes, ctx))
    df = df.withColumns({f"__pass_{c}": F.col(c) for c in passing if c in template.fields})
    df = _parse_fields(df, template, ctx, codes, now, base)
    stated = country_code(_raw("country"), spark) if "country" in template.fields else F.lit(None).cast("string")
    late: dict[str, Column] = {"country": F.coalesce(stated, F.when(_raw("country").isNull(), F.col("__region")))} \
        if "country" in template.fields else {}
    for f in template.of_type("currency"):
        amounts = [m for m in template.of_type("money") if m.currency_field == f.name]
        seen = [F.when(F.col(m.name).isNotNull(), F.coalesce(f"cur_of_{m.name}", "__dcur")) for m in amounts]
        late[f.name] = F.coalesce(f"__cur_{f.name}", *seen)
    if "price_basis" in template.fields:
        late["price_basis"] = F.coalesce("price_basis", F.when(_is_text("price"), price_basis(_raw("price"))))
    if {"source_id", "url"} <= set(template.fields):
        late["source_id"] = F.coalesce(F.nullif("source_id", F.lit("")), F.col("url"))
    df = df.withColumns(late)
    if "city" in template.fields:
        df = df.withColumn("__city", F.col("city"))
        if places is not None:
            where = F.coalesce("country", "__region")
            df = df.withColumns({"city": canonical_of(F.col("__hits"), 0, F.col("__city"), where), "__homes": homes_of(F.col("__hits"), 0)})
    patterned = [f for f in template.fields.values() if f.pattern]
    bad = {f.name: F.col(f.name).isNotNull() & ~matches(F.col(f.name), f.pattern) for f in patterned}
    notes = [F.when(bad[n], F.concat(F.lit(f"{n}: '"), F.col(n), F.lit("' does not match the expected pattern; dropped"))) for n in bad]
    df = df.withColumn("__notes", F.array(*_warnings(template), *notes))
    df = df.withColumns({n: F.when(~condition, F.col(n)) for n, condition in bad.items()})
    df = _periods(df, template)
    df, usd_rate, currency = _reports(df, template, ctx, fx)
    checks = [*quality.check_required(template), *quality.check_bounds(template, usd_rate, currency)]
    if places is not None and "city" in template.fields and "country" in template.fields:
        clash = (F.size("__homes") > 0) & ~F.array_contains("__homes", F.col("country"))
        checks.append(F.when(clash, F.concat(F.lit("city "), F.col("city"), F.lit(" is in "),
                                             F.array_join(F.sort_array("__homes"), "/"), F.lit(", not "), F.col("country"))))
    if ctx.project_regions and K.GLOBAL not in ctx.project_regions and "country" in template.fields:
        inside = ", ".join(sorted(ctx.project_regions))
        checks.append(F.when(~F.col("country").isin(*ctx.project_regions),
                             F.concat(F.lit("country "), F.col("country"), F.lit(f" is outside the project's regions ({inside})"))))
    if template.expires:
        checks.append(quality.check_expiry(template.expires, now))
    checks += quality.find_conflicts(template.conflicts)
    is_row = F.col("__is_object")
    reasons = F.when(is_row, quality.reasons(checks)).otherwise(F.array(F.lit("row is not an object")))
    filled = F.coalesce("country", "__region")
    lost = F.when(F.col("__several") & filled.isNull(), F.concat(
        F.lit("country: not stated and the city does not place the row in one of "), F.array_join("__regions", "/"), F.lit("; left empty")))
    df = df.withColumns({"reasons": reasons, "warnings": F.when(is_row, F.array_compact(F.array_append("__notes", lost))).otherwise(
        F.array().cast("array<string>")), "extra": _extra(template, ctx)})
    df = df.withColumn("country", filled)
    df = df.withColumns({"fingerprint": fingerprint(template),
                         "uid": record_uid(F.col("source"), F.col("source_id"), F.col("url"), F.coalesce(F.to_json("__doc"), F.col("raw")))})
    columns = [c for c in template.output_columns() if c in df.columns]
    return df.select(*columns, "extra", "fingerprint", "uid", "reasons", "warnings",
                     *[F.col(f"__pass_{c}").alias(c) if c in template.fields else F.col(c) for c in passing if c not in columns])


def _periods(df: DataFrame, template: Template) -> DataFrame:
    """Period from its field, else from an amount's text, else the default; no amount, no period."""
    for p in template.periods:
        df = df.withColumn("__per", each([F.when(_is_text(a), _raw(a)) for a in p.amounts], lambda t: period(t)))
        stated = F.coalesce(p.field, F.get(F.array_compact("__per"), F.lit(0)))
        some = F.coalesce(*[F.col(a) for a in p.amounts]).isNotNull()
        df = df.withColumn(p.field, F.when(stated.isNotNull(), stated).when(some, F.lit(p.default)))
        df = df.withColumns({a + p.suffix: convert_period(F.col(a), F.col(p.field), p.canonical) for a in p.amounts})
        df = df.drop("__per")
    return df


def _reports(df: DataFrame, template: Template, ctx: Context, fx: DataFrame | None) -> tuple[DataFrame, Column | None, Column]:
    """`<money>_report` in the report currency.  All money of a row shares one currency, so one broadcast lookup of its rate is
    enough; the rates of the report currency and of the dollar are read once on the driver."""
    amounts = template.of_type("money")
    if not amounts:
        return df, None, F.lit(None).cast("string")
    currency = F.coalesce(amounts[0].currency_field, "__dcur")
    report = ctx.report_currency.upper()
    if fx is None:
        same = {f.name + "_report": F.when(currency == report, F.round(F.col(f.name), 2)) for f in amounts}
        return df.withColumns(same), F.when(currency == "USD", F.lit(1.0)), currency
    known = {r["currency"]: r["rate"] for r in unique_rates(fx, report, "USD").collect()}  # two rows at most
    rates = F.broadcast(unique_rates(fx).select(F.col("currency").alias("__fx"), F.col("rate").alias("__rate")))
    df = df.withColumn("__money", currency).join(rates, F.upper("__money") == F.col("__fx"), "left")
    target, dollar = (F.lit(known.get(c)).cast("double") for c in (report, "USD"))
    values = {f.name + "_report": F.round(F.when(F.col("__money") == report, F.col(f.name)).otherwise(
        F.col(f.name) / F.col("__rate") * target), 2) for f in amounts}
    usd_rate = F.when(F.col("__money") == "USD", F.lit(1.0)).otherwise(F.col("__rate") / dollar)
    return df.withColumns(values), usd_rate, F.col("__money")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") == 0).drop("reasons", "warnings")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") > 0)
