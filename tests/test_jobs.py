"""Lanes, files, exports, alerts and streams on small fixtures."""

import csv
import datetime as dt
import json
import random

import pandas as pd
from pyspark.sql import functions as F

from recordworks.operators import classify, coverage, health, query, sinks, walk
from recordworks.operators import records as R
from recordworks.sources import dims, pages
from recordworks.operators.lookups import canonical_city, city_dim
from recordworks.plans import cycle
from recordworks.plans.normalise import Context
from recordworks.streaming import jobs
from recordworks.templates import template

FILLER = "<section>" + "Bicycles, boats and barns on offer. " * 70 + "</section>" + "".join(f"<a href='/l/{i}'>offer {i}</a>" for i in range(18))


def html(body, head=""):
    return f"<html><head>{head}</head><body>{body}</body></html>"


def test_lanes(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom">' + "".join(f"<entry><title>offer {i}</title><id>{i}</id></entry>" for i in range(5)) + "</feed>"
    state, linked = '<script id="__NEXT_DATA__" type="application/json">{"page":{"offers":[]}}</script>', '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"item":{"@type":"Product"}}]}</script>'
    cases = {
        1: (html(FILLER), "html"), 2: (html(FILLER, state), "embedded_json"), 3: (html(FILLER, linked), "embedded_json"),
        4: (json.dumps({"result": {"boats": [{"ref": n, "length": n / 2} for n in range(6)]}}), "json_api"), 5: (atom, "feed"),
        6: (html("<main></main><div id=\"app\"> </div><script src='/bundle.js'></script>"), "browser"),
        7: (html("<h2>Members</h2><form action='/in'><label>PIN<input name=pin type='password'></label></form>"), "none"),
        8: (html("<article>The harbour was full that day. This is premium content.</article>"), "none"), 9: (html("<p>Verify you are human to go on</p>"), "none"),
        10: (html("<script src='https://x.test/kpsdk.js'></script>"), "none"), 11: (html("<p>short</p>"), "sitemap"), 12: (html(FILLER), "openapi"),
        13: (html(FILLER), "feed"), 14: (html(FILLER), "html"),
    }
    landed = spark.createDataFrame([(11, "sitemap", "u", None, 1), (12, "openapi", "u", None, 1), (13, "feed", "https://s/feed.xml", ["/l/0", "/l/1", "/l/2"], 3),
                                    (14, "feed", "https://s/feed.xml", [f"/blog/{i}" for i in range(10)], 10)], "page_id int, kind string, url string, item_links array<string>, n int")
    df = spark.createDataFrame([(k, "https://s/list", v[0]) for k, v in cases.items()], "page_id int, url string, html string")
    got = {r["page_id"]: r["lane"] for r in classify.classify_lane(df, landed).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_broken_feeds_are_errors(spark):
    rss = "<rss><channel><item><title>A</title><link>https://x/a</link></item></channel></rss>"
    rows = [(1, rss), (2, ""), (3, "  "), (4, "garbage"), (5, rss[: len(rss) // 2]), (6, '{"items": [{"id": 1')]
    got = {r["page_id"]: r["error"] is not None for r in pages.feed_items(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    assert got == {1: False, 4: True, 5: True, 6: True}


def test_feeds_with_opaque_parts(spark):
    """Markup inside CDATA, comments and instructions is text or nothing; namespace declarations are no attributes."""
    body = ('<?xml version="1.0"?><!-- <item><title>no</title></item> --><rss xmlns:m="http://m"><channel><?pi <item> ?>'
            '<item xmlns:x="u"><title><![CDATA[a </item> b <!-- c --> d]]> &amp; <![CDATA[&amp;]]></title><link>x</link><m:thumb xmlns:q="v" url="a&amp;b" w=\'1\'/></item>'
            '<item><title>one<!-- </title> --> two</title><link><![CDATA[ y ]]></link></item></channel></rss>')
    odd = "<rss><item><title>\ue000\ue001 0\ue0010</title></item></rss>"
    got = {(r["page_id"], r["pos"]): r for r in pages.feed_items(spark.createDataFrame([(1, body), (2, odd)], "page_id int, html string")).collect()}
    assert got[1, 0]["fields"] == {"title": "a </item> b <!-- c --> d & &amp;", "link": "x", "thumb": ""} and got[1, 0]["attributes"] == {"thumb_attrs": {"url": "a&b", "w": "1"}}
    assert got[1, 1]["fields"] == {"title": "one two", "link": "y"} and got[2, 0]["fields"] == {"title": "\ue000\ue001 0\ue0010"} and len(got) == 3


def test_tree_search(spark):
    doc = json.dumps({"b": [{"id": 1, "price": 2, "in": {"price": None, "id": {"id": 3, "price": "x"}}}, 7, "{\"id\": 1, \"price\": 2}"], "a": {"id": 9}, "id": 0, "price": []})
    deep = lambda n: "[" * n + '{"id":1,"price":2}' + "]" * n
    rows = [(1, doc), (2, deep(900)), (3, deep(3000)), (4, "{"), (5, None), (6, "[]"), (7, deep(13)), (8, '{"k":' * 300 + '{"id":1,"price":2}' + "}" * 300)]
    found = pages.find_items(spark.createDataFrame(rows, "page_id int, json string"), ["id", "price"]).collect()
    items = lambda k: [json.loads(r["item"]) for r in sorted(found, key=lambda r: r["pos"] or 0) if r["page_id"] == k and r["error"] is None]
    inner = {"id": 3, "price": "x"}
    assert [x["id"] for x in items(1)] == [0, 1, {"id": 3, "price": "x"}, 3] and items(1)[3] == inner
    assert items(2) == items(7) == items(8) == [{"id": 1, "price": 2}] and items(6) == []
    assert {r["page_id"] for r in found if r["error"]} == {3, 4}
    assert pages.find_items(spark.createDataFrame(rows, "page_id int, json string"), ["id", "price"], limit=1).filter("page_id = 1").count() == 1


def test_page_elements(spark):
    doc = '<div class="card big" data-id="7"><a href="/i">Seven <b>bold</b></a><br></div></span><p>Hello<script>var x=1</script> world</p><p>2<div>3'
    df = spark.createDataFrame([(1, doc, "u")], "page_id int, html string, url string")
    rows = {(r["tag"], r["text"]): r for r in pages.page_elements(df).collect()}
    assert set(rows) == {("div", "Seven bold"), ("a", "Seven bold"), ("b", "bold"), ("br", ""), ("p", "Hello world"), ("script", "var x=1"), ("p", "23"), ("div", "3")}
    assert (rows["div", "Seven bold"]["pos"], rows["div", "Seven bold"]["last"]) == (0, 3) and rows["p", "23"]["depth"] == 0 and rows["div", "3"]["parent_pos"] == rows["p", "23"]["pos"]
    own = {r["tag"]: r["text"] for r in pages.page_elements(df, ["a", "b"], text="own", carry=("url",)).collect()}
    assert own == {"a": "Seven", "b": "bold"} and "text" not in pages.page_elements(df, text=None).columns
    assert pages.page_elements(df, tag="div", cls="big card", attrs={"data-id": True}).count() == 1
    nested = "<noscript>a<style>b</style><i>c</i></noscript>"
    assert {r["tag"]: r["text"] for r in pages.page_elements(spark.createDataFrame([(1, nested)], "page_id int, html string")).collect()} == {"noscript": "ac", "style": "b", "i": "c"}


def test_page_trees_are_linear(spark):
    """A page of n nested elements with a piece of text each gives n elements and n pieces, not n * n characters."""
    n = 3000
    df = spark.createDataFrame([(1, "<div>x" * n)], "page_id int, html string")
    tree = pages.page_trees(df).first()
    assert len(tree["elements"]) == len(tree["pieces"]) == n and tree["elements"][0]["last"] == n - 1
    assert pages.page_elements(df, text=None).count() == n


def test_gazetteer_files(spark, tmp_path):
    extra, names = tmp_path / "extra.json", tmp_path / "cities.txt"
    extra.write_text(json.dumps({"FI": {"Nauvo": ["Nagu"]}, "PL": {"Gdansk": ["Danzig"]}}), encoding="utf-8")
    names.write_text("1\tTurku\tTurku\tÅbo,Aboa\t60\t22\tP\tPPLA\tFI\n2\tLake\tLake\tLake Y\t0\t0\tH\tLK\tFI\n", encoding="utf-8")
    places = city_dim(dims.read_gazetteer(spark, str(extra), str(names)))
    cases = [("NAGU", "FI", "Nauvo"), ("Danzig", "PL", "Gdansk"), ("åbo", "FI", "Turku"), ("Lake Y", "FI", "Lake Y"), ("  Turku ", None, "Turku"),
             ("Turku (harbour)", "FI", "Turku"), ("Warszawa, Mazowsze, Polska", "PL", "Warsaw"), ("Leith. EH6 6AA", "GB", "Leith. EH6 6AA"), ("", "FI", "")]
    df = spark.createDataFrame([c[:2] for c in cases], "city string, country string")
    got = {(r["city"], r["country"]): r["canonical"] for r in canonical_city(df, "city", "country", places).collect()}
    assert got == {c[:2]: c[2] for c in cases}


def test_built_in_cities(spark):
    places = city_dim(dims.read_gazetteer(spark))
    cases = [("Sevilla", "ES", "Seville"), ("京都", "JP", "Kyoto"), ("Torino", "IT", "Turin"), ("Екатеринбург", "RU", "Yekaterinburg"), ("Köln", "DE", "Cologne"),
             ("Basel", "CH", "Basel"), ("Nowhere upon Sea", "PT", "Nowhere upon Sea")]
    df = spark.createDataFrame([c[:2] for c in cases], "city string, country string")
    got = {r["city"]: r["canonical"] for r in canonical_city(df, "city", "country", places).collect()}
    assert got == {c[0]: c[2] for c in cases}
    assert sum(len(cities) for cities in dims.built_in_cities().values()) >= 339
    known = {(r["country"], r["canonical"]) for r in dims.read_gazetteer(spark).collect()}
    assert known == {(country, name) for country, cities in dims.built_in_cities().items() for name in cities}


def test_exports(spark, tmp_path):
    rows = [("=HYPERLINK(1)", -500.0, ["a"]), ("+1+1", 1.0, []), ("@SUM(A1)", 2.0, None), ("\tx", 3.0, None), ("plain, \"quoted\"", 4.0, None)]
    df = spark.createDataFrame(rows, "make string, price double, tags array<string>").coalesce(1)
    sinks.export(df, "csv", str(tmp_path / "c"))
    with open(next((tmp_path / "c").glob("part*.csv")), encoding="utf-8", newline="") as f:
        cells = list(csv.reader(f))
    assert [c[0] for c in cells[1:]] == ["'=HYPERLINK(1)", "'+1+1", "'@SUM(A1)", "'\tx", 'plain, "quoted"'] and cells[1][1:] == ["-500.0", '["a"]']
    sinks.export(df, "jsonl", str(tmp_path / "j"))
    sinks.export(df, "parquet", str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "p")).count() == 5


def test_query_checks_names(spark):
    df = spark.range(1)
    for bad in ({"nope": 1}, {"id": {"like": 1}}):
        try:
            query.query(df, columns=["id"], filters=bad)
            raise AssertionError("no error")
        except ValueError:
            pass


def test_walk_cases(spark):
    def verdict(pages_, max_pages=10, max_rows=100):
        rows = [("r", i + 1, *p) for i, p in enumerate(pages_)]
        df = spark.createDataFrame(rows, "run_id string, page int, raw_count int, fresh_count int, error string, http_failed boolean, done boolean")
        r = walk.walk_verdict(df, max_pages, max_rows).first()
        return r["stopped"], r["complete"], r["pages"], r["rows"]

    full, dry, empty, bad = (10, 10, None, False, False), (10, 0, None, False, False), (0, 0, None, False, False), (0, 0, "boom", False, False)
    assert verdict([full, dry, dry, full]) == ("repeating", True, 3, 10) and verdict([full, empty]) == ("empty_page", True, 2, 10)
    assert verdict([full, bad, full, bad]) == ("errors", False, 4, 20) and verdict([full, (10, 10, None, False, True)]) == ("done", True, 2, 20)
    assert verdict([full] * 5, max_rows=25) == ("max_rows", False, 3, 25) and verdict([full] * 5, max_pages=3) == ("max_pages", False, 3, 30)
    assert verdict([full, (0, 0, None, True, False)]) == ("fetch_failed", False, 2, 10) and verdict([dry, bad, dry]) == ("repeating", False, 3, 0)


def test_dedup_cap_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(f"r{rng.choice('aab')}", rng.randint(1, 4), pos * 4001, f"k{rng.randint(0, 60)}") for pos in range(300)]
    df = spark.createDataFrame(rows, "run_id string, page int, pos long, key string")
    seen, want, taken = set(), set(), {}
    for run, page, pos, key in sorted(rows):
        if (run, key) not in seen:
            seen.add((run, key))
            if taken.get(run, 0) < 25:
                taken[run] = taken.get(run, 0) + 1
                want.add((run, page, pos, key))
    assert {tuple(r) for r in walk.dedup_walk(df, 25).collect()} == want


def test_overlapping_replace_spares_refreshed_rows(spark):
    at = lambda m: dt.datetime(2026, 1, 1, 10, m)
    rows = [("s", f"u{i}", "old" if i < 5 else "other", at(0) if i == 0 else at(30)) for i in range(10)]
    records = spark.createDataFrame(rows, "source string, uid string, run_id string, last_seen timestamp")
    runs = spark.createDataFrame([("s", "new", at(20), True, 9, None)], "source string, run_id string, started_at timestamp, complete boolean, stored long, baseline long")
    done = R.finalize(records, runs, F.lit(at(40)).cast("timestamp"), 30)
    assert done.records.count() == 9 and done.summary.first()["write_mode"] == "replace" and done.summary.first()["pruned"] == 1


def test_delivery_keeps_channels_apart(spark, tmp_path):
    """A channel that took an alert never gets it again, whatever happens to the others and however often a batch is repeated."""
    alerts, ledger = spark.createDataFrame([("a1",), ("a2",), ("a3",)], "alert_id string"), str(tmp_path / "ledger")
    seen = {"file": [], "hook": []}

    def send(name, fails):
        def run(df):
            seen[name].append(sorted(r[0] for r in df.collect()))
            if fails and fails.pop():
                raise OSError("disk full")
        return run

    channels = {"file": send("file", [False, True]), "hook": send("hook", [])}
    sinks.deliver_alerts(alerts.filter("alert_id <> 'a3'"), 0, channels, ledger)
    for batch in (1, 1, 2):
        sinks.deliver_alerts(alerts, batch, channels, ledger)
    assert seen == {"file": [["a1", "a2"], ["a1", "a2", "a3"]], "hook": [["a1", "a2"], ["a3"]]}
    state = {(r.alert_id, r.channel): (r.delivered, r.attempts) for r in sinks.delivery_state(alerts, sinks.read_outcomes(spark, ledger), ["file", "hook", "mail"]).collect()}
    assert state["a1", "file"] == (True, 2) and state["a1", "hook"] == (True, 1) and state["a3", "file"] == (True, 1) and state["a3", "mail"] == (False, 0)
    dead = {"mail": send("file", [True] * 5)}
    for batch in range(5):
        sinks.deliver_alerts(alerts, batch, dead, ledger, max_attempts=3)
    assert sinks.read_outcomes(spark, ledger).filter("channel = 'mail'").count() == 9


def test_streaks(spark):
    rng = random.Random(11)
    rows = [(f"k{k}", seq, rng.choice([0, 0, 0, 1, None]) if k else 0) for k in range(6) for seq in sorted(rng.sample(range(-50, 200_000), 400))]
    want = {}
    for key, _, added in sorted(rows):
        want[key] = 0 if added else want.get(key, 0) + 1
    df = spark.createDataFrame(rows, "key string, seq long, added int").repartition(7)
    assert {r.key: r.dry_streak for r in coverage.dry_streak(df, ["key"]).collect()} == want and want["k0"] == 400
    assert coverage.dry_streak(df.filter("key = 'k3'").drop("key")).first()[0] == want["k3"]


def test_admission_cuts(spark):
    rng = random.Random(3)
    rows = [(f"s{i}", rng.choice([-(10**15), 5, 5, 5, 7, 8, 10**15, rng.randint(0, 10**6)]), rng.random() < 0.3) for i in range(3000)]
    df = spark.createDataFrame(rows, "site string, arrival long, blocked boolean")
    for budget in (0, 1, 400, 1111, 10**6):
        got = {r.site: r.decision for r in coverage.admit(df, 0, budget).collect()}
        open_, shut = (sorted(r[1] for r in rows if r[2] is kind) for kind in (False, True))
        taken = sorted(r[1] for r in rows if got[r[0]] == "added")
        assert taken == open_[:budget] and sorted(r[1] for r in rows if got[r[0]] == "blocked") == shut[: 3 * budget]
    assert coverage.admit(df.limit(0), 0, 5).count() == 0


def test_evidence_times_and_places(spark):
    schema = "arrival int, url string, regions array<string>, angles array<string>, evidence array<struct<url: string, observation: string, seen_at: string>>, blocked boolean, mirror_of string"
    proof = [("https://a.example.de/x", "seen", None), ("https://b.test/", None, "2026-01-01"), (None, "x", None), ("", "x", None)]
    row = coverage.candidate_reasons(spark.createDataFrame([(1, "https://example.de/", ["DE"], None, proof, None, None)], schema), ["DE"], now=dt.datetime(2026, 2, 3)).first()
    assert [tuple(e) for e in row["evidence"]] == [("https://a.example.de/x", "seen", "2026-02-03 00:00:00", True), ("https://b.test/", "", "2026-01-01", False)]


def test_record_log(spark, tmp_path):
    """Newest rows count, repeated batches and batches cut off before their ledger row change nothing, compaction changes no result."""
    schema = "project string, uid string, source string, title string, first_seen timestamp, last_seen timestamp, seq long"
    at = lambda day: dt.datetime(2026, 1, day)
    rows = lambda title, day, *ids: spark.createDataFrame([("p", i, "s", title, at(day), at(day), 0) for i in ids], schema)
    bad = spark.createDataFrame([("s", "{}")], "source string, raw string")
    log = jobs.RecordLog(str(tmp_path / "log"), buckets=3)
    log.append(rows("one", 1, "a", "b", "c"), bad, 0)
    log.append(rows("two", 2, "b"), bad.limit(0), 1)
    assert len(list((tmp_path / "log" / "delta" / "batch=1").glob("part-*"))) == 1  # a batch of one row is one small file
    log.append(rows("again", 9, "a", "b"), bad, 1)
    state = lambda: {r.uid: (r.title, r.first_seen.day, r.last_seen.day) for r in log.read(spark).collect()}
    want = {"a": ("one", 1, 1), "b": ("two", 1, 2), "c": ("one", 1, 1)}
    assert state() == want
    rows("lost", 8, "z").withColumn("bucket", F.lit(0)).write.parquet(str(tmp_path / "log" / "delta" / "batch=2"))  # no ledger row
    rows("lost", 8, "z").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "log" / "base" / "upto=7"))
    assert state() == want
    log.compact(spark)
    assert state() == want and log.ledger(spark).filter("base_upto = 1").count() == 1
    log.append(rows("three", 3, "c", "d"), bad, 2)
    assert state() == want | {"c": ("three", 1, 3), "d": ("three", 3, 3)} and log.quarantined(spark).count() == 2
    log.compact(spark)
    log.compact(spark)
    assert state() == want | {"c": ("three", 1, 3), "d": ("three", 3, 3)} and log.ledger(spark).filter("base_upto IS NOT NULL").count() == 2


def test_cadence(spark):
    df = spark.createDataFrame([("daily",), ("6h",), ("every 2 days",), ("manual",), (None,), ("3w",), ("1.5",)], "c string")
    assert [r[0] for r in df.select(health.cadence_hours(F.col("c"))).collect()] == [24, 6, 48, 0, 24, 504, 1.5]


def _files(spark, tmp_path, name, rows, schema):
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").json(str(tmp_path / name))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))


def test_incidents_alert_twice(spark, tmp_path):
    """empty, empty, empty, healthy, empty, empty -> one alert per incident, whatever the batches."""
    start = dt.datetime(2026, 1, 1)
    kinds = ["zero", "zero", "zero", "healthy", "zero", "zero"]
    rows = [("s", k, start + dt.timedelta(minutes=10 * i)) for i, k in enumerate(kinds)]
    stream = _files(spark, tmp_path, "events", rows, "source string, kind string, at timestamp")
    assert jobs.run_to_memory(jobs.stream_alerts(stream, expires=False), "incidents", str(tmp_path / "c")).count() == 2


class _CountedState:
    """A state that counts the messages it would send."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def _called(self, result=None):
        self.calls += 1
        return result

    def getValue(self, key):
        return self._called(self.held.get(key))

    def updateValue(self, key, value):
        self.held[key] = self._called(value)

    def containsKey(self, key):
        return self._called(key in self.held)

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)

    def exists(self):
        return self.containsKey(())


def test_incidents_read_their_state_once_a_batch():
    """A thousand events of a source cost a handful of state calls, and batches of any size raise the same alerts."""
    events = pd.DataFrame([("s", ["zero", "healthy", "stuck"][i % 3 if i % 90 < 45 else 0], dt.datetime(2026, 1, 1) + dt.timedelta(minutes=7 * i)) for i in range(1000)],
                          columns=["source", "kind", "at"])
    raised = []
    for size in (1000, 1):
        alerts = jobs.Incidents(False)
        alerts.last, alerts.healthy = _CountedState(), _CountedState()
        found = [out for at in range(0, 1000, size) for out in alerts.handleInputRows(("s",), iter([events.iloc[at : at + size]]), None)]
        raised.append(sorted(tuple(r) for out in found for r in out.itertuples(index=False)))
        assert size == 1 or alerts.last.calls + alerts.healthy.calls <= 6
    assert raised[0] == raised[1] and len(raised[0]) > 100


def test_ingest_deals_its_rows(spark, tmp_path, monkeypatch):
    """A batch read by one task is parsed by as many as a shuffle has partitions."""
    seen, real = [], jobs.normalise_records
    monkeypatch.setattr(jobs, "normalise_records", lambda batch, *rest: seen.append(batch.rdd.getNumPartitions()) or real(batch, *rest))
    raw = spark.createDataFrame([("s", "r", f'{{"title":"t{i}","url":"https://x.test/{i}","price":"€ 3"}}') for i in range(50)], "source string, run_id string, raw string").coalesce(1)
    log = jobs.RecordLog(str(tmp_path / "log"), buckets=2)
    jobs.ingest_batch(raw, 0, template("products"), Context(regions=["DE"], now=dt.datetime(2026, 1, 1)), log, "p")
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))] and log.read(spark).count() == 50


def test_silent_runs_fire_their_timer(spark, tmp_path):
    rows = [("r1", "s1", "running", 0, dt.datetime(2026, 1, 1)), ("r2", "s2", "ok", 0, dt.datetime(2026, 1, 1))]
    stream = _files(spark, tmp_path, "beats", rows, "run_id string, source string, status string, time_budget_s int, ts timestamp")
    query_ = (jobs.stream_stuck(stream, shortest_s=1).writeStream.format("memory").queryName("stuck").outputMode("append")
              .option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start())
    import time
    for _ in range(60):
        time.sleep(1)
        if spark.table("stuck").count():
            break
    query_.stop()
    assert [r["run_id"] for r in spark.table("stuck").collect()] == ["r1"]


def test_stopped_walks_stay_stopped(spark, tmp_path):
    """With expiring state, by the cluster's clock: a page that comes after a run has stopped starts nothing."""
    rows = [("r", 1, 5, 5, None, False, True), ("r", 2, 5, 5, None, False, True), ("q", 1, 0, 0, None, False, False)]
    stream = _files(spark, tmp_path, "pages", rows, "run_id string, page int, raw_count int, fresh_count int, error string, http_failed boolean, done boolean")
    query_ = (jobs.stream_walk_verdict(stream, 9, 99).writeStream.format("memory").queryName("walks").outputMode("append")
              .option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start())
    import time
    for _ in range(60):
        time.sleep(1)
        if spark.table("walks").count() >= 2 and (query_.lastProgress or {}).get("batchId", 0) > 3:
            break
    query_.stop()
    assert sorted((r["run_id"], r["stopped"], r["pages"]) for r in spark.table("walks").collect()) == [("q", "empty_page", 1), ("r", "done", 1)]


def test_registry_ids_stay_unique(spark):
    rows = [("foo_com", "foo.com"), ("foo_com_2", "foo2.example"), (None, "foo-com"), (None, "foo_com"), (None, "foo com 4"), (None, "пример.рф"), (None, "例え.jp")]
    got = [r["id"] for r in coverage.with_slugs(spark.createDataFrame(rows, "id string, site string")).collect()]
    assert len(set(got)) == len(rows) and {"foo_com", "foo_com_2", "foo_com_3", "foo_com_4", "foo_com_5"} <= set(got)


def test_candidates_without_region_or_angle(spark):
    schema = "arrival int, url string, regions array<string>, angles array<string>, evidence array<struct<url: string, observation: string>>, blocked boolean, mirror_of string"
    df = spark.createDataFrame([(1, "https://shop.example.de/", None, [], [("https://shop.example.de/list", "40 offers")], None, None)], schema)
    row = coverage.candidate_reasons(df, ["DE", "AT"]).first()
    assert row["reason"] is None and sorted(row["codes"]) == ["AT", "DE"] and row["angles"] == ["vertical_portals"]


def test_rows_are_told_apart_whatever_their_key_order(spark):
    events = spark.createDataFrame([("r", "s", 1, ['{"a": 1, "b": 2}', '{"b": 2, "a": 1}', '{"a": 2}'])], "run_id string, source string, page int, rows array<string>")
    assert cycle.fresh_rows(events, 100).count() == 2


def test_quarantine_keeps_whole_rows(spark):
    head = "x" * 9000
    rows = spark.createDataFrame([("p", "s", "r", ["bad"], head + "1"), ("p", "s", "r", ["bad"], head + "2")], "project string, source string, run_id string, reasons array<string>, raw string")
    out = R.quarantine_rows(rows, F.current_timestamp()).collect()
    assert len({r["qid"] for r in out}) == 2 and all(len(r["raw"]) == 9001 for r in out)
