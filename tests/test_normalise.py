"""Whole rows through the normalisation plan."""

import datetime as dt
import json

import pytest

from recordworks.plans.normalise import Context, normalise_records
from recordworks.sources.dims import fx_dim, read_gazetteer
from recordworks.templates import template

NOW = dt.datetime(2026, 6, 15, 9)


def run(spark, record_type, rows, ctx, **rates):
    named = [{"source_id": f"n{i}", "url": f"https://shop.example/{i}", **r} if isinstance(r, dict) else r for i, r in enumerate(rows)]
    raw = spark.createDataFrame([(i, "feed", r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) for i, r in enumerate(named)], "n int, source string, raw string")
    fx = fx_dim(spark.createDataFrame([(k, float(v)) for k, v in (rates or {"USD": 1}).items()], "currency string, rate double"))
    return [r.asDict() for r in sorted(normalise_records(raw, template(record_type), ctx, read_gazetteer(spark), fx).collect(), key=lambda r: r["n"])]


OFFERS = [
    ({"price": 18500.5, "priceCurrency": "EUR"}, 18500.5, "EUR"), ({"amount": "7 300", "currency": "chf"}, 7300, "CHF"), ({"value": "41.250,00"}, 41250, "PLN"),
    ({"highPrice": "9", "price": "62 000", "priceCurrency": "CZK"}, 62000, "CZK"), ({"price": 1.234, "currency": "EUR"}, 1.234, "EUR"), ({"currency": "EUR"}, None, None),
]


def test_offer_objects(spark):
    got = run(spark, "products", [{"title": f"item {i}", "price": offer} for i, (offer, _, _) in enumerate(OFFERS)], Context(regions=["PL"], now=NOW))
    for row, (_, amount, currency) in zip(got, OFFERS):
        assert row["price"] == amount
        if amount is not None:
            assert row["currency"] == currency and row["reasons"] == []
        else:
            assert row["reasons"] != []


def test_long_values_are_kept_whole(spark):
    long_title, long_note = "wide " * 900 + "end", "note " * 2000 + "end"
    row = run(spark, "products", [{"title": long_title, "price": "5 EUR", "description": "d " * 15000 + "end", "remark": long_note}], Context(regions=["DE"], now=NOW))[0]
    assert row["title"].endswith("end") and row["description"].endswith("end") and json.loads(row["extra"]) == {"remark": long_note}


@pytest.mark.parametrize("change, reason", [
    ({"make": None}, "missing required field make"), ({"price": "0 zł"}, "price=0.0 below the sanity bound 0"), ({"year": 1875}, "year=1875 below the sanity bound 1900"),
    ({"price": "60 zł"}, "below 100 USD"), ({"mileage": "9 000 000 km"}, "above the sanity bound 2000000"),
])
def test_vehicle_bounds(spark, change, reason):
    row = {"make": "Skoda", "model": "Fabia", "year": "rok 2015", "price": "31 900 zł", "mileage": "112 tys. km", **change}
    assert any(reason in e for e in run(spark, "vehicles", [row], Context(regions=["PL"], now=NOW), PLN=4)[0]["reasons"])


def test_vehicle_values(spark):
    row = {"url": "oferta/77", "make": "  Skoda", "year": 2015, "price": "31 900 zł", "mileage": "60,000 miles", "fuel_type": "дизель", "transmission": "manuell",
           "vin": "tmbea15j5f3012345", "condition": "gebraucht", "warranty": "2 years"}
    got = run(spark, "vehicles", [row, "[1, 2]", {**row, "vin": "TOO-SHORT", "fuel_type": "steam"}], Context(regions=["PL"], base_url="https://auta.example.pl/lista/", now=NOW), PLN=4)
    assert got[0]["reasons"] == [] and got[0]["url"] == "https://auta.example.pl/lista/oferta/77"
    assert {k: got[0][k] for k in ("make", "price", "currency", "price_report", "fuel_type", "transmission", "vin", "condition", "country")} == {
        "make": "Skoda", "price": 31900, "currency": "PLN", "price_report": 7975, "fuel_type": "diesel", "transmission": "manual", "vin": "TMBEA15J5F3012345",
        "condition": "used", "country": "PL"}
    assert got[0]["mileage"] == pytest.approx(96560.64, abs=0.1) and json.loads(got[0]["extra"]) == {"warranty": "2 years"}
    assert got[1]["reasons"] == ["row is not an object"]
    assert got[2]["vin"] is None and got[2]["fuel_type"] == "other" and json.loads(got[2]["extra"])["fuel_type_raw"] == "steam"


def test_rents(spark):
    rows = [{"title": "Mieszkanie na Starym Mieście", "price": "2 400 zł / miesiąc", "area": "48 m²", "property_type": "wohnung", "city": "Kraków"},
            {"title": "Loft", "price": "550", "rent_period": "weekly"}, {"title": "Casa se vende", "price": "190000"}, {"title": "rent to own cottage", "price": "900"},
            {"title": "Tiny flat", "price": "800", "property_type": "apartment", "area": "2400 m²"}]
    got = run(spark, "real_estate_rent", rows, Context(regions=["PL"], now=NOW), PLN=4)
    assert {k: got[0][k] for k in ("rent_period", "price_per_month", "area", "property_type", "city")} == {
        "rent_period": "month", "price_per_month": 2400, "area": 48, "property_type": "apartment", "city": "Krakow"}
    assert got[1]["price_per_month"] == pytest.approx(550 * 52 / 12, abs=0.01) and got[1]["currency"] == "PLN"
    assert "sale listing in a rent category" in got[2]["reasons"] and any("rent-to-own" in e for e in got[3]["reasons"])
    assert "area=2400.0 above the sanity bound 2000" in got[4]["reasons"]


def test_mapped_fields(spark):
    ctx = Context(regions=["DE"], now=NOW, field_map={"title": "names.0", "price": "offers.-1.price", "currency": "=EUR"})
    row = run(spark, "products", [{"names": ["Lamp", "Lampe"], "offers": [{"price": "99"}, {"price": "45,50"}]}], ctx)[0]
    assert (row["title"], row["price"], row["currency"], row["reasons"]) == ("Lamp", 45.5, "EUR", [])


def test_regions_of_rows(spark):
    rows = [{"title": "Choir", "starts_at": "3 March 2033 20:00", "city": "Praha", "price_min": "250"}, {"title": "Film", "starts_at": "2033-03-03", "location": "Prater, Wien", "price_min": "12"},
            {"title": "Stream", "starts_at": "2033-03-03", "price_min": "4"}, {"title": "Talk", "starts_at": "2033-03-03", "country": "Austria"}]
    got = run(spark, "events", rows, Context(regions=["CZ", "AT"], now=NOW), CZK=23, EUR=0.9)
    assert [(r["country"], r["currency"]) for r in got[:3]] == [("CZ", "CZK"), ("AT", "EUR"), (None, None)] and got[3]["country"] == "AT"
    assert got[0]["starts_at"] == "2033-03-03T20:00:00+01:00" and any(w.startswith("country") for w in got[2]["warnings"])
    shared = run(spark, "jobs", [{"title": "Baker", "salary_min": "31000"}], Context(regions=["FR", "IT"], now=NOW))
    assert shared[0]["currency"] == "EUR" and shared[0]["country"] is None


def test_salaries(spark):
    rows = [{"title": "Nurse"}, {"title": "Nurse", "salary_min": "3 200 € pro Monat"}, {"title": "Nurse", "salary_min": "42000", "salary_max": "51000"}]
    got = run(spark, "jobs", rows, Context(regions=["DE"], now=NOW))
    assert [(r["salary_period"], r["salary_min_annual"]) for r in got] == [(None, None), ("month", 38400), ("year", 42000)] and got[2]["salary_max_annual"] == 51000


def test_places_outside(spark):
    ctx = Context(regions=["IT"], project_regions=["IT", "AT"], now=NOW)
    got = run(spark, "events", [{"title": "Opera", "starts_at": "2026-07-01", "country": "PT"}, {"title": "Opera", "starts_at": "2026-07-01", "country": "AT", "city": "Wien"},
                                {"title": "Opera", "starts_at": "2026-07-01", "country": "IT", "city": "Paris"}], ctx)
    assert got[0]["reasons"] == ["country PT is outside the project's regions (AT, IT)"] and got[1]["reasons"] == [] and got[1]["city"] == "Vienna"


def test_ended_events(spark):
    day = lambda n: (NOW + dt.timedelta(days=n)).date().isoformat()
    rows = [{"title": "Fair", "starts_at": day(-400)}, {"title": "Fair", "starts_at": day(-9), "ends_at": day(2)}, {"title": "Fair", "starts_at": day(-9), "ends_at": day(-9)},
            {"title": "Jazz night", "starts_at": day(12), "city": "Wien"}, {"title": " Jazz night", "starts_at": day(12), "city": "Vienna"}]
    got = run(spark, "events", rows, Context(regions=["AT"], now=NOW))
    assert [r["reasons"] for r in got[:3]] == [[f"event already ended ({day(-400)})"], [], [f"event already ended ({day(-9)})"]]
    assert got[3]["fingerprint"] == got[4]["fingerprint"] is not None
