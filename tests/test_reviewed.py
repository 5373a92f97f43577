"""What a review of the registered queries found: each case failed before it was mended."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import catalog
from catalog import tables as T
from recordworks.functions.text import visible_text
from recordworks.operators import classify, health

NOW = dt.datetime(2024, 1, 30)
RUN = "source string, run_id long, status string, rows_stored long, started_at timestamp, heartbeat_at timestamp, finished_at timestamp, stopped string, error string"


def _runs(spark, *runs):
    return spark.createDataFrame([("s", i, status, 5, at, at, at, "done", None) for i, (status, at) in enumerate(runs)], RUN)


def test_skew_and_alert_limits_are_exact(spark):
    """A heartbeat half a second beyond the skew is ahead, and an alert half a second inside the day still holds a finding back."""
    sources = spark.createDataFrame([("s", True, "enabled", 900, None, NOW - dt.timedelta(days=9))], "source string, enabled boolean, status string, time_budget_s int, cadence_hours double, updated_at timestamp")
    now = F.lit(NOW).cast("timestamp")
    runs = _runs(spark, ("ok", NOW - dt.timedelta(hours=1)), ("degraded", NOW + dt.timedelta(seconds=300.5)))
    assert [r["kind"] for r in health.health_findings(runs, sources, now).collect()] == ["clock_skew"]
    found = spark.createDataFrame([("s", "stuck", "7")], "source string, kind string, key string")
    for ago, raised in ((86399.5, 0), (86400.0, 1)):
        alerts = found.withColumn("created_at", F.lit(NOW - dt.timedelta(seconds=ago)).cast("timestamp"))
        assert health.suppress_alerts(found, alerts, runs, now).count() == raised


def _against_sql(spark, folder, name, tables):
    build, sql = catalog.ALL[name]
    got, db = build(spark, str(folder)), duckdb.connect()
    for table in tables:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_stops_on_pages_without_parts(spark, tmp_path):
    """Brand#3 has no part on its second page, which fails all the same."""
    rows = [(k, f"part {k}", f"Brand#{b}", 9.5 + k, 7 if k % 50 == 5 else 3) for b in (1, 2, 3, 4, 5) for k in range(b, 251, 5) if not (b == 3 and 50 < k <= 100)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    T.table(spark, "/root/testdata/sf0.001", "events").write.parquet(f"{tmp_path}/events.parquet")
    _against_sql(spark, tmp_path, "cycle_stops", ["part"])


@pytest.mark.parametrize("context, most", [(20, None), (3000, None), (0, 3)])
def test_snippets_of_many_matches(spark, context, most):
    """Thousands of matches on a page, beyond one block of characters and of matches; before, every match searched the page anew."""
    import re
    html = "\U0001F600 ".join(f"The cat {i} thaw" for i in range(3000)) + "é"
    got = classify.grep_pages(spark.createDataFrame([(1, html), (2, "none"), (3, None)], "page_id int, html string"), r"th[ae]\w*", context, most).collect()
    want = [(m.start(), html[max(0, m.start() - context):m.end() + context]) for m in re.finditer(r"(?i)th[ae]\w*", html)]
    assert [(r["page_id"], r["matches"]) for r in got] == [(1, 6000)] and [tuple(s) for s in got[0]["snippets"]] == want[:most]


def test_entities_that_a_page_is_cut_in(spark):
    """With `closed` what is left of an entity stays; without, it is decoded as a browser does."""
    page = "<html><title>A &amp;&lt;b&amp</title><body>x &gt; y &copy z &#65 &#66; <a href='/?a&amp;b&amp'>l</a> &amp</body></html>"
    html = F.col("html")
    row = spark.createDataFrame([(page,)], "html string").select(
        *[f(html, closed=c).alias(f"{n}{int(c)}") for c in (True, False) for n, f in (("text", visible_text), ("links", classify.page_links), ("meta", classify.page_meta))]).first()
    assert row["text1"] == "A &<b&amp x > y &copy z &#65 B l &amp" and row["links1"] == ["/?a&b&amp"] and row["meta1"]["title"] == "A &<b&amp"
    assert row["text0"] == "A &<b& x > y © z A B l &" and row["links0"] == ["/?a&b&"] and row["meta0"]["title"] == "A &<b&"


def test_rows_of_a_common_place_stay_where_they_are(spark):
    """What is known of the different places is broadcast without a static estimate, so a place of very many rows doesn't fill one task."""
    from recordworks.operators.lookups import city_dim, place_hits
    from recordworks.sources import dims

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(2000).select("id", F.when(F.col("id") % 4 > 0, "Milano").alias("city"))
        looked = place_hits(rows, ["city"], city_dim(dims.read_gazetteer(spark)))
        assert looked.filter("size(hits) > 0").count() == 1500
        plan = looked._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
