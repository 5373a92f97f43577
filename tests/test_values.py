"""Golden values of the column normalisers."""

import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from recordworks.functions import dates, identity, money, numbers, periods, sites, text, units, values
from recordworks.sources import dims
from recordworks.templates import template


def table(spark, rows, schema="raw string"):
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def outputs(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


NUMBERS = [
    # groups of three, whatever separates them; the last separator with other than three digits behind it is the point
    ("7 040 318", 7040318), ("7 040 318 руб", 7040318), ("6.204.017", 6204017), ("8,015,622", 8015622), ("3,04,51,906", 30451906), ("9'311'005", 9311005),
    ("47,6", 47.6), ("0.25", 0.25), ("9.417", 9417), ("6,318.75", 6318.75), ("6.318,75", 6318.75), ("-42", -42), ("-0,5", -0.5),
    # words and letters of magnitude
    ("27k", 27000), ("4.75 million", 4750000), ("6 bn", 6e9), ("2,25 млн", 2250000), ("640 тыс.", 640000), ("88 mil", 88000), ("3,4 millones", 3400000), ("₹ 62 Lakh", 6200000),
    ("3.75 crore", 37500000), ("9 cr", 90000000), ("Rp 7,25 jt", 7250000), ("Rp 415rb", 415000), ("6,8 juta", 6800000), ("935 ribu", 935000),
    # ten thousands
    ("7.25万", 72500), ("2460万円", 24600000), ("4億2000万円", 420000000), ("3억 6천만원", 360000000), ("8억", 800000000), ("7천만", 70000000),
    # other digits and entities
    ("٦٬٢٠٤", 6204), ("٣٤٫٧", 34.7), ("۴۵۰۰", 4500), ("8&nbsp;640", 8640),
    # digits that belong to a name, a unit or a count of years
    ("Pixel9", None), ("9m²", 9), ("B12", None), ("築23年", None), ("nothing", None), (" ", None), (None, None),
]


def test_numbers(spark):
    df = table(spark, [n for n, _ in NUMBERS]).withColumn("value", numbers.number(F.col("raw")))
    got = dict(outputs(df, "raw", "value"))
    assert got == dict(NUMBERS)


def test_integer_and_range(spark):
    df = table(spark, ["2 350 – 4 100 €", "from 12 to 19", "none"]).select("raw", numbers.price_range(F.col("raw")).alias("r")).select(
        "raw", "r.low", "r.high")
    assert outputs(df, "low", "high") == [(2350, 4100), (12, 19), (None, None)]
    half = spark.range(1).select(numbers.integer_of(F.lit(2.5)).alias("a"), numbers.integer_of(F.lit(3.5)).alias("b"))
    assert outputs(half, "a", "b") == [(2, 4)]


CURRENCIES = [
    ("7 310 000 ₸", None, "KZT"), ("64 900 ₾", None, "GEL"), ("$ 8,140", "CAD", "CAD"), ("$ 8,140", "GEL", "USD"), ("¥ 640,000", "CNY", "CNY"), ("¥ 640,000", None, "JPY"),
    ("4 250 kr", "SEK", "SEK"), ("4250kr", "DKK", "DKK"), ("R$ 18.700", None, "BRL"), ("Rs 91,300", "PKR", "PKR"), ("8 640 CHF", None, "CHF"), ("Opel 1.6 price 7300", "GEL", "GEL"),
    ("2,300 sq. ft. warehouse", "AUD", "AUD"), ("24900 Ft", None, "HUF"), ("24900Ft", None, "HUF"), ("٦٬٢٠٤ ريال", "OMR", "OMR"), ("US$ 31", None, "USD"),
]
MONEY = [
    ("€ 1.340 / mês", None, 1340, "EUR"), ("Free", "CAD", 0, "CAD"), ("RM415", None, 415, "MYR"), ("Rp7.250.000", None, 7250000, "IDR"), ("CHF640", None, 640, "CHF"),
    ("Rs.915", None, 915, "INR"), ("From RM415 / Desk / Month", None, 415, "MYR"), ("Pixel9 Rp 8 jt", None, 8000000, "IDR"), ("RM 4.15 per sq ft", None, 4.15, "MYR"),
    ("٦٬٢٠٤ ريال", None, 6204, "SAR"), ("31,400 درهم", None, 31400, "AED"), ("Dhs 31,400", None, 31400, "AED"), (None, "CHF", None, "CHF"),
]


def test_currency_and_money(spark):
    codes = dims.currency_codes(spark)
    df = table(spark, [c[:2] for c in CURRENCIES], "raw string, d string").select(
        money.detect_currency(F.col("raw"), F.col("d"), codes).alias("c"))
    assert outputs(df, "c") == [c[2] for c in CURRENCIES]
    df = table(spark, [m[:2] for m in MONEY], "raw string, d string").select(money.money(F.col("raw"), F.col("d"), codes).alias("m")).select("m.*")
    assert outputs(df, "amount", "currency") == [m[2:] for m in MONEY]


AREAS = [
    ("47,60 m²", 47.6, "sqm"), ("2-Zimmer | 58,4 m²", 58.4, "sqm"), ("900 sqft", 83.61, "sqft"), ("12坪", 39.67, "tsubo"), ("40평", 132.23, "pyeong"), ("9 соток", 900, "sotka"),
    ("3.5 ha", 35000, "hectare"), ("61 кв.м", 61, "sqm"), ("8 marla", None, "marla"), ("115", 115, "sqm"), (None, None, None),
]


def test_units(spark):
    def measured(kind, rows):
        return table(spark, rows).select(units.measure(kind, F.col("raw")).alias("m")).select("m.*")

    assert outputs(measured("area", [a[0] for a in AREAS]), "value", "unit") == [a[1:] for a in AREAS]
    assert outputs(measured("distance", ["84 тыс. км", "7.2万公里", "1,000 miles"]), "value") == [84000, 72000, 1609.3]
    assert outputs(measured("weight", ["10 lbs", "750 g"]), "value") == [4.5359, 0.75]
    df = spark.createDataFrame([(1000.0, "sqft")], "n double, u string").select(
        units.measure("area", F.lit(None).cast("string"), F.col("u"), F.col("n"))["value"].alias("v"))
    assert outputs(df, "v") == [92.9]


PERIODS = [
    ("/yr", "year"), ("per day", "day"), ("1.340 €/mês", "month"), ("за месяц", "month"), ("전세", None), (None, None), ("€ 3.100 - € 3.900 per maand", "month"),
    ("9 500 - 12 000 zł / mies. brutto", "month"), ("38 zł/h", "hour"), ("RM 2,750 sebulan", "month"), ("Rp 8 jt/bulan", "month"), ("45k - 52k GBP p.a.", "year"), ("61.000 € jährlich", "year"),
    ("€ 14/m²", None), ("€ 14/m2", None), ("S$ 2,900 /mo", "month"),
]


def test_periods(spark):
    df = table(spark, [p for p, _ in PERIODS]).withColumn("p", periods.period(F.col("raw")))
    assert outputs(df, "raw", "p") == PERIODS
    got = spark.range(1).select(periods.convert_period(F.lit(100.0), F.lit("week"), "month").alias("a"),
                                periods.convert_period(F.lit(50.0), F.lit("hour"), "year").alias("b"))
    assert outputs(got, "a", "b") == [(433.33, 104000)]


DATES = [
    ("07.03.2027", None, "2027-03-07T00:00:00+00:00"), ("03/27/2027", "US", "2027-03-27T00:00:00+00:00"), ("07/03/2027", "GB", "2027-03-07T00:00:00+00:00"),
    ("вчера", None, "2026-09-30T12:00:00+00:00"), ("5 days ago", None, "2026-09-26T12:00:00+00:00"), ("hace 4 días", None, "2026-09-27T12:00:00+00:00"),
    ("2027年3月7日", None, "2027-03-07T00:00:00+00:00"), ("some day", None, None), ("Fri, 20 Nov 2026, 21:15", "GB", "2026-11-20T21:15:00+00:00"),
    ("Sun, Dec 6 · 7:45 PM", "IE", "2026-12-06T19:45:00+00:00"), ("Tuesday 3rd November 2026 8am", "GB", "2026-11-03T08:00:00+00:00"), ("20 November 2026", "GB", "2026-11-20T00:00:00+00:00"),
    ("20.11.2026 21:15", "DE", "2026-11-20T21:15:00+01:00"), ("20 listopada 2026, 21:15", "PL", "2026-11-20T21:15:00+01:00"), ("9 maart 2027", "NL", "2027-03-09T00:00:00+00:00"),
    ("4 Disember 2026 7.20 pagi", "MY", "2026-12-04T07:20:00+08:00"), ("Fri 20 Nov", "GB", "2026-11-20T00:00:00+00:00"), ("14 Feb", "GB", "2027-02-14T00:00:00+00:00"),
    ("2026-11-20T21:15:00", "PT", "2026-11-20T21:15:00+00:00"), ("2026-11-20 06:30", "SG", "2026-11-20T06:30:00+08:00"), ("2026-11-20T21:15:00Z", "DE", "2026-11-20T21:15:00+00:00"),
    ("Friday", "GB", None), ("order 2026-11-20", "GB", "2026-11-20T00:00:00+00:00"), ("30.02.2027", None, None), ("Nov 20, 2026", "IE", "2026-11-20T00:00:00+00:00"),
    ("2026-11-20T21:15:00.125+0330", None, "2026-11-20T21:15:00.125000+03:30"),
]


def test_dates(spark):
    now = F.lit(dt.datetime(2026, 10, 1, 12, 0)).cast("timestamp")
    df = table(spark, [d[:2] for d in DATES], "raw string, c string").withColumns({
        "v": dates.datetime_text(F.col("raw"), F.col("c"), now), "day": dates.datetime_text(F.col("raw"), F.col("c"), now, date_only=True)})
    assert outputs(df, "raw", "v") == [(d[0], d[2]) for d in DATES]
    assert dict(outputs(df, "raw", "day"))["Fri, 20 Nov 2026, 21:15"] == "2026-11-20"
    epoch = spark.createDataFrame([(1800000000.0,), (1800000000000.0,)], "n double").withColumn(
        "v", dates.datetime_text(F.lit(None).cast("string"), given=F.col("n")))
    assert outputs(epoch, "v") == ["2027-01-15T08:00:00+00:00"] * 2


def test_enums_and_booleans(spark):
    fuel = template("vehicles").fields["fuel_type"]
    cases = [("Benzin", "petrol"), ("бензин", "petrol"), ("DIESEL", "diesel"), ("Plug-in Hybrid", "plugin_hybrid"), ("coal", "other"), (None, None), ("diesel 2.0", "diesel")]
    df = table(spark, [c for c, _ in cases]).withColumn("v", values.enum(F.col("raw"), fuel))
    assert outputs(df, "raw", "v") == cases
    df = table(spark, ["Yes", "нет", "maybe"]).select(values.boolean(F.col("raw")).alias("b"))
    assert outputs(df, "b") == [True, False, None]
    df = table(spark, ["a, b,,c "]).select(values.text_list(F.col("raw")).alias("l"))
    assert outputs(df, "l") == [["a", "b", "c"]]


def test_price_basis(spark):
    cases = [("RM415 / Seat", "per_person"), ("RM90/pax/day", "per_person"), ("S$12.40 PSF", "per_area"), ("RM 4.15 per sq ft", "per_area"), ("€ 14/m²", "per_area"), ("S$ 2,900 /mo", None), ("31 400 zł", None)]
    df = table(spark, [c for c, _ in cases]).select("raw", money.price_basis(F.col("raw")).alias("b"))
    assert outputs(df, "raw", "b") == cases


def test_clean_text(spark):
    cases = [("<script>window.x=1</script>Hi <b>there</b><style>p{}</style>", "Hi there"),
             ("a <SCRIPT type=x>never closed", "a"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("<!-- c -->x<br/>y", "x y"),
             ("&lt;img src=x onerror=alert(1)&gt; ok", "<img src=x onerror=alert(1)> ok"), ("&amp;lt; &#8364;&#x41; &eacute;&amp", "&lt; €A é&"),
             ("  ", None)]
    df = table(spark, [c for c, _ in cases]).select("raw", text.clean_text(F.col("raw")).alias("v"))
    assert outputs(df, "raw", "v") == cases


def test_links(spark):
    base = "https://cars.example.kz/list/a?x=1"
    cases = [("/cars/a1", "https://cars.example.kz/cars/a1"), ("//x.y/z", "https://x.y/z"), ("b", "https://cars.example.kz/list/b"),
             ("../b/./c", "https://cars.example.kz/b/c"), ("?p=2", "https://cars.example.kz/list/a?p=2"), ("mailto:x@y", None),
             ("http://o.test/q", "http://o.test/q"), ("", None), (None, None)]
    df = table(spark, [c for c, _ in cases]).select("raw", values.absolute_url(F.col("raw"), F.lit(base)).alias("v"))
    assert outputs(df, "raw", "v") == cases


DOMAINS = [
    ("https://m.sahibi.kz/list/", "sahibi.kz"), ("https://www.boats.co.uk/y", "boats.co.uk"), ("loja.acme.com.br", "acme.com.br"), ("https://p.q.homes.ge", "homes.ge"),
    ("https://someone.github.io/blog", "someone.github.io"), ("https://a.b.ck", "a.b.ck"), ("https://www.ck", "www.ck"), ("http://casas.es:8443/es", "casas.es"), ("https://toko.acme.co.id", "acme.co.id"),
    ("https://münchen.example", "xn--mnchen-3ya.example"), ("10.0.0.9", "10.0.0.9"), ("ftp://user:pw@x.y.net/z", "y.net"), ("", ""),
]
SITES = [
    ("https://raw.githubusercontent.com/Some-Org/files/main/y.csv", "raw.githubusercontent.com/some-org/files"), ("https://github.com/orga/repo/tree/main", "github.com/orga"),
    ("https://api.github.com/users", "github.com"), ("https://sahibi.kz/", "sahibi.kz"), ("https://porto.substack.com/p/y", "porto.substack.com"), ("https://substack.com/home", "substack.com"),
    ("http://10.0.0.9:9000/q", "10.0.0.9:9000"), ("http://localhost:3000/", "localhost:3000"), ("https://gitlab.com/team/app", "gitlab.com/team"),
]


def test_domains_and_sites(spark, tmp_path):
    df = table(spark, [d for d, _ in DOMAINS]).select("raw", sites.registrable_domain(F.col("raw")).alias("d"))
    assert outputs(df, "raw", "d") == DOMAINS
    df = table(spark, [s for s, _ in SITES]).select("raw", sites.site_key(F.col("raw")).alias("s"))
    assert outputs(df, "raw", "s") == SITES
    path = tmp_path / "suffixes.dat"
    path.write_text("// own rules\nnet\npages.net\n*.ward.example\n!town.ward.example\n", encoding="utf-8")
    index = sites.suffix_index(dims.read_suffixes(spark, str(path)))
    cases = [("p.q.pages.net", "q.pages.net"), ("x.east.ward.example", "x.east.ward.example"), ("w.town.ward.example", "town.ward.example")]
    df = sites.with_suffix_sizes(table(spark, [c for c, _ in cases]), "raw", index).select("raw", sites.registrable_domain(F.col("raw"), F.col("suffix_size")).alias("d"))
    assert sorted(outputs(df, "raw", "d")) == sorted(cases)
    df = table(spark, ["Raw.x/Y", "___"]).select(sites.slug(F.col("raw")).alias("s"))
    assert outputs(df, "s") == ["raw_x_y", "source"]


def test_long_suffix_lists(spark):
    """A list of 200,000 rules is a table like any other; a third of all rows have one host."""
    listed = spark.range(200_000).select(F.concat(F.lit("s"), "id", F.lit(".org")).alias("suffix"), F.lit("rule").alias("kind"))
    index = sites.suffix_index(listed.unionByName(spark.createDataFrame([("org", "rule"), ("s7.org", "wildcard"), ("x.s7.org", "exception"), ("", "rule")], "suffix string, kind string")))
    urls = [f"http://a.b.s{i}.org/" for i in range(0, 200_000, 400)] + ["a.c.s7.org", "a.x.s7.org", "s7.org", "q.s7.org", "t.unknown", "", None] + ["www.hot.org"] * 300
    df = sites.with_suffix_sizes(spark.createDataFrame([(u,) for u in urls], "url string"), "url", index)
    got = Counter((r.url, r.d) for r in df.select("url", sites.registrable_domain(F.col("url"), F.col("suffix_size")).alias("d")).collect())
    want = {"a.c.s7.org": "a.c.s7.org", "a.x.s7.org": "x.s7.org", "s7.org": "s7.org", "q.s7.org": "q.s7.org", "t.unknown": "t.unknown", "": "", None: "", "www.hot.org": "hot.org"}
    assert got == Counter((u, want[u] if u in want else "b." + u[11:-1]) for u in urls)


def test_fingerprint_text(spark):
    import hashlib
    df = spark.createDataFrame([(None, "BMW", "X5", 2018, 85000.0, 12500000.0), ("V1", "a", "b", 1, 1.0, 1.0), (None, None, "b", 1, 1.0, 1.0)],
                               "vin string, make string, model string, year long, mileage double, price double")
    got = outputs(df.select(identity.fingerprint(template("vehicles")).alias("f")), "f")
    want = hashlib.sha1(b"make/model/year/mileage/price:bmw|x5|2018|85000.0|12500000.0").hexdigest()[:20]
    assert got == [want, hashlib.sha1(b"vin:v1").hexdigest()[:20], None]
    df = spark.createDataFrame([("Palmview Catering Services LLC", None, "Sharjah"), ("Palmview Catering Services L.L.C.", None, "Sharjah"),
                                ("m", "https://palmview.ae", "n"), ("o", "http://www.palmview.ae/", "p")],
                               "name string, website string, city string").withColumns(
        {"registration_id": F.lit(None).cast("string"), "country": F.lit("AE")})
    a, b, c, d = outputs(df.select(identity.fingerprint(template("businesses")).alias("f")), "f")
    assert a == b and c == d and a != c
