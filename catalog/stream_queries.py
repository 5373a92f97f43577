"""Queries that run the streaming jobs and the collection cycle over the driver's tables as available-now streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from recordworks.operators import sinks
from recordworks.plans.cycle import run_cycle
from recordworks.plans.normalise import Context
from recordworks.session import shared_folder
from recordworks.sources import pages as P
from recordworks.streaming import jobs
from recordworks.templates import template

from . import tables as T


def _stream(spark, sf, name):
    return spark.readStream.schema(T.table(spark, sf, name).schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/{name}*.parquet")


def drain(df, mode="append"):
    """Run a stream to its end into files and read them back; a repeated batch replaces its own files."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)

    def store(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    query = (df.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out/*")


def stream_dedup(spark, sf):
    rows = _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("run_id"),
                                               F.concat("event_type", F.lit(":"), F.floor(F.col("value") / 10)).alias("key"))
    return drain(jobs.stream_dedup(rows, expiry="60 days")).select("run_id", "key")


def stream_clock_guard(spark, sf):
    late = F.when(F.col("event_id") % 7 == 0, F.expr("INTERVAL 10 MINUTE")).otherwise(F.expr("INTERVAL 1 MINUTE"))
    ts = F.col("ts").cast("timestamp")
    events = _stream(spark, sf, "events").select("event_id", (ts + late).alias("ts"), ts.alias("received"))
    steady, ahead = jobs.clock_guard(events, F.col("received"))
    return drain(steady.select("event_id")).withColumn("ahead", F.lit(False)).unionByName(drain(ahead.select("event_id")).withColumn("ahead", F.lit(True)))


def stream_usage(spark, sf):
    requests = _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("source"), F.round(F.col("value") * 100).cast("bigint").alias("bytes"))
    latest = drain(jobs.stream_usage(requests, 4), "update").groupBy("day", "source").agg(
        F.max("requests").alias("requests"), F.max("bytes").alias("bytes"), F.max("over_budget").alias("over_budget"))
    return latest.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def stream_walk_verdict(spark, sf):
    value = F.col("value")
    pages = _stream(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").cast("int").alias("page"), F.when(value < 2, 0).otherwise(10).alias("raw_count"),
        F.when(value < 40, 0).otherwise(F.floor(value / 20).cast("int")).alias("fresh_count"),
        F.when((F.col("event_type") == "error") & (value > 60), F.lit("boom")).alias("error"), (value < 1).alias("http_failed"), (value > 190).alias("done"))
    return drain(jobs.stream_walk_verdict(pages, 2 ** 31 - 1, 60, expires=False))


def _verdict_sql():
    from .run_queries import VERDICT_SQL
    return (VERDICT_SQL.replace("row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page", "event_id AS page").replace("WHERE page <= 40", "")
            .replace("SELECT *, stopped IN", "SELECT * REPLACE (CAST(run_id AS VARCHAR) AS run_id), stopped IN") + " WHERE stopped <> 'max_pages'")


def stream_alerts(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "healthy").when(F.col("event_type") == "error", "zero").when(F.col("event_type") == "click", "stuck")
    events = _stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("source"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    return drain(jobs.stream_alerts(events.filter("kind IS NOT NULL"), expires=False)).select("source", "kind", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


#: alerts of a source and kind one after the other: the next is the first finding a day later, or of an incident the first behind a healthy run
ALERTS_SQL = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS source, CASE event_type WHEN 'purchase' THEN 'healthy' WHEN 'error' THEN 'zero' WHEN 'click' THEN 'stuck' END AS kind, ts AS "at"
    FROM events WHERE event_type IN ('purchase', 'error', 'click')),
  f AS (SELECT f.source, f.kind, f."at", max(h."at") AS healthy FROM e f LEFT JOIN e h ON h.source = f.source AND h.kind = 'healthy' AND h."at" <= f."at" WHERE f.kind <> 'healthy' GROUP BY ALL),
  a AS (SELECT source, kind, min("at") AS "at" FROM f GROUP BY ALL
    UNION ALL SELECT a.source, a.kind, min(f."at") FROM a JOIN f ON f.source = a.source AND f.kind = a.kind AND f."at" > a."at"
      AND (f."at" >= a."at" + INTERVAL 24 HOUR OR (f.kind = 'zero' AND f.healthy > a."at")) GROUP BY a.source, a.kind)
SELECT source, kind, strftime("at", '%Y-%m-%d %H:%M:%S') AS "at" FROM a"""


def stream_stuck(spark, sf):
    """Heartbeats of the users' runs by the stream's own clock: a run whose newest heartbeat is older than its silence when the stream ends is stuck,
    unless it ended.  Four in five runs beat all the time; the others stop after the fifth day."""
    ts = F.col("ts").cast("timestamp")
    beats = _stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("run_id"), F.lit("s").alias("source"), "user_id", F.when((F.col("user_id") % 5 == 1) & (F.col("event_type") == "purchase"), "ok")
                                                .otherwise("running").alias("status"), F.lit(3600).alias("time_budget_s"), ts.alias("ts"))
    quiet = (F.col("user_id") % 5 != 0) | (F.dayofmonth("ts") <= 5)
    stuck = drain(jobs.stream_stuck(beats.filter(quiet).drop("user_id"), delay="10 minutes"))
    return stuck.select("run_id", F.date_format(F.timestamp_millis("last_heartbeat_ms"), "yyyy-MM-dd HH:mm:ss").alias("at"))


STUCK_SQL = """WITH b AS (SELECT CAST(user_id AS VARCHAR) AS run_id, date_trunc('second', ts) AS shown, ts, user_id % 5 = 1 AND event_type = 'purchase' AS over FROM events WHERE user_id % 5 <> 0 OR day(ts) <= 5),
  n AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, over DESC) = 1)
SELECT run_id, strftime(shown, '%Y-%m-%d %H:%M:%S') AS at FROM n WHERE NOT over AND ts + INTERVAL 7200 SECOND < (SELECT max(ts) FROM b) - INTERVAL 10 MINUTE"""


def alert_delivery(spark, sf):
    """Alerts of the error events on two channels over two batches; one channel fails in the first batch and takes everything in the second."""
    alerts = T.table(spark, sf, "events").filter("event_type = 'error'").select(F.col("event_id").cast("string").alias("alert_id"), "user_id")
    folder, calls = shared_folder(spark), []

    def hook(batch):
        calls.append(batch.count())
        if len(calls) == 1:
            raise ConnectionError("no answer")

    channels = {"file": lambda batch: batch.write.mode("append").parquet(f"{folder}/alerts"), "hook": hook}
    for batch in (0, 1, 1):  # the second batch is repeated
        sinks.deliver_alerts(alerts.filter("user_id % 2 = 0") if batch == 0 else alerts, batch, channels, f"{folder}/ledger")
    written = spark.read.parquet(f"{folder}/alerts").groupBy("alert_id").agg(F.count("*").alias("written"))
    state = sinks.delivery_state(alerts, sinks.read_outcomes(spark, f"{folder}/ledger"), list(channels))
    return state.join(written, "alert_id").select("alert_id", "channel", "delivered", "attempts", "written")


DELIVERY_SQL = """SELECT CAST(event_id AS VARCHAR) AS alert_id, channel, true AS delivered, CASE WHEN channel = 'hook' AND user_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS attempts, 1::BIGINT AS written
  FROM events, (VALUES ('file'), ('hook')) c(channel) WHERE event_type = 'error'"""


def exported_records(spark, sf):
    """The record table written as JSON lines and as Parquet by project and source, and read back pruned to a source."""
    folder, rows = shared_folder(spark), T.records(spark, sf).select("project", "source", "uid", "lang", "text", F.array("lang", F.lit(None).cast("string")).alias("tags"))
    sinks.export(rows, "jsonl", f"{folder}/jsonl")
    sinks.export(rows, "parquet", f"{folder}/parquet")
    rows.write.partitionBy("project", "source").parquet(f"{folder}/table")
    schema = rows.schema
    parts = [spark.read.schema(schema).json(f"{folder}/jsonl").withColumn("form", F.lit("jsonl")), spark.read.parquet(f"{folder}/parquet").withColumn("form", F.lit("parquet"))]
    parts += [P.read_records(spark, f"{folder}/table", "p", source).select(*schema.names).withColumn("form", F.lit("table")) for source in ("src3", "src4")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("form", "uid", "source", F.md5("text").alias("digest"), F.size("tags").alias("tags"))


EXPORT_SQL = """SELECT form, CAST(doc_id AS VARCHAR) AS uid, source, md5(text) AS digest, 2::INT AS tags FROM documents, (VALUES ('jsonl'), ('parquet'), ('table')) f(form)
  WHERE form <> 'table' OR source IN ('src3', 'src4')"""


def _product(name):
    return F.to_json(F.struct(F.col("p_partkey").cast("string").alias("source_id"), F.concat(F.lit("https://x.test/"), "p_partkey").alias("url"),
                              F.concat(F.lit("<i>"), "p_name", F.lit("</i>")).alias("title"), F.when(F.col("p_size") != 7, F.concat(F.lit("€ "), F.col("p_retailprice").cast("decimal(10,2)"))).alias("price")))


def stream_ingest(spark, sf):
    folder = shared_folder(spark)
    raw = _stream(spark, sf, "part").select(F.col("p_brand").alias("source"), F.lit("r1").alias("run_id"), _product("part").alias("raw"))
    log = jobs.RecordLog(f"{folder}/log", buckets=8)
    job = {"template": template("products"), "ctx": Context(regions=["DE"], now=T.NOW), "project": "p", "log": log}
    jobs.stream_ingest(raw, f"{folder}/state", **job).awaitTermination()
    # a repeated batch changes nothing, a later one replaces rows of its keys, and a compaction in between changes no result
    again = T.table(spark, sf, "part").select(F.col("p_brand").alias("source"), F.lit("r2").alias("run_id"), _product("part").alias("raw"))
    jobs.ingest_batch(again, 0, **job)
    log.compact(spark)
    jobs.ingest_batch(again.filter("p_size <= 10").withColumn("raw", F.replace("raw", F.lit("€"), F.lit("$"))), 10 ** 6, **job)
    stored = log.read(spark).select("source", "source_id", "title", "price", "currency")
    bad = log.quarantined(spark).filter("batch < 1000000").select("source", F.try_variant_get(F.parse_json("raw"), "$.source_id", "string").alias("source_id"),
                                                                  F.array_join("reasons", ";").alias("title"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("currency"))
    return stored.unionByName(bad)


INGEST_SQL = """SELECT p_brand AS source, CAST(p_partkey AS VARCHAR) AS source_id, CASE WHEN p_size <> 7 THEN p_name ELSE 'missing required field price' END AS title,
  CASE WHEN p_size <> 7 THEN p_retailprice END AS price, CASE WHEN p_size <> 7 THEN CASE WHEN p_size <= 10 THEN 'USD' ELSE 'EUR' END END AS currency FROM part"""


def _cycle(spark, sf):
    page = (F.floor(F.col("p_partkey") / 500) + 1).cast("int")
    part = T.table(spark, sf, "part").withColumns({"raw": _product("part"), "page": page})
    last = part.groupBy("p_brand").agg(F.max("page").alias("last"))
    pages = part.groupBy("p_brand", "page").agg(F.collect_list("raw").alias("rows")).join(last, "p_brand")
    events = pages.select(F.concat(F.lit("run-"), "p_brand").alias("run_id"), F.col("p_brand").alias("source"), "page", "rows", F.lit(None).cast("string").alias("error"),
                          F.lit(False).alias("http_failed"), ((F.col("page") == F.col("last")) & (F.col("p_brand") != "Brand#2")).alias("done"),
                          F.lit(T.NOW).cast("timestamp").alias("started_at"))
    old = part.select(F.lit("p").alias("project"), F.concat(F.lit("old"), "p_partkey").alias("uid"), F.col("p_brand").alias("source"), F.lit("t").alias("title"),
                      F.lit(dt.datetime(2024, 1, 20)).cast("timestamp").alias("first_seen"), F.lit(dt.datetime(2024, 1, 20)).cast("timestamp").alias("last_seen"),
                      F.lit("run-old").alias("run_id")).filter(F.col("source").isin("Brand#1", "Brand#2"))
    sources = part.select(F.col("p_brand").alias("source"), F.lit(None).cast("bigint").alias("baseline")).distinct()
    history = T.runs(spark, sf).filter(F.lit(False))
    return run_cycle(events, old, sources, history, template("products"), Context(regions=["DE"], now=T.NOW), project="p", max_pages=10 ** 9, max_rows=10 ** 12, now=T.NOW)


def cycle_runs(spark, sf):
    return _cycle(spark, sf).runs.select("source", "status", "stopped", "complete", "rows_stored", "rows_quarantined", "write_mode", "pruned")


CYCLE_SQL = """SELECT p_brand AS source, CASE p_brand WHEN 'Brand#2' THEN 'partial' ELSE 'ok' END AS status,
  CASE p_brand WHEN 'Brand#2' THEN 'max_pages' ELSE 'done' END AS stopped, p_brand <> 'Brand#2' AS complete,
  count(*) FILTER (p_size <> 7) AS rows_stored, count(*) FILTER (p_size = 7) AS rows_quarantined,
  CASE p_brand WHEN 'Brand#2' THEN 'upsert' ELSE 'replace' END AS write_mode, CASE p_brand WHEN 'Brand#1' THEN count(*) ELSE 0 END AS pruned FROM part GROUP BY p_brand"""


def cycle_records(spark, sf):
    return _cycle(spark, sf).records.groupBy("source", "run_id").agg(F.count("*").alias("n"))


CYCLE_RECORDS_SQL = """SELECT p_brand AS source, 'run-' || p_brand AS run_id, count(*) AS n FROM part WHERE p_size <> 7 GROUP BY 1
  UNION ALL SELECT p_brand, 'run-old', count(*) FROM part WHERE p_brand = 'Brand#2' GROUP BY 1"""


def cycle_stops(spark, sf):
    """Walks over pages of fifty parts each, with what may end them: Brand#1 finds an empty second page, Brand#2 is a browser lane that is done
    on page 2, Brand#3 fails on its second and third page, Brand#5 gets no answer; four pages are allowed, and all brands have more."""
    page = (F.floor((F.col("p_partkey") - 1) / 50) + 1).cast("int")
    brand, n = F.col("p_brand"), F.col("page")
    part = T.table(spark, sf, "part").withColumns({"raw": _product("part"), "page": page}).select("p_brand", "page", "raw")
    # what ends a walk is a fetched page of its own, whether or not parts of the brand fall on it
    ends = F.when(brand.isin("Brand#1", "Brand#2"), F.array(F.lit(2))).when(brand == "Brand#3", F.array(F.lit(2), F.lit(3))).when(brand == "Brand#5", F.array(F.lit(1)))
    fetched = part.unionByName(part.select("p_brand").distinct().select("p_brand", F.explode(ends).alias("page"), F.lit(None).cast("string").alias("raw")))
    events = (fetched.groupBy("p_brand", "page").agg(F.collect_list("raw").alias("raws"))
              .select(F.concat(F.lit("run-"), brand).alias("run_id"), brand.alias("source"), "page",
                      F.when(((brand == "Brand#1") & (n == 2)) | (brand == "Brand#5"), F.array().cast("array<string>")).otherwise(F.col("raws")).alias("rows"),
                      F.when((brand == "Brand#3") & n.isin(2, 3), F.concat(F.lit("problem on page "), 5 - n)).alias("error"),
                      (brand == "Brand#5").alias("http_failed"), ((brand == "Brand#2") & (n == 2)).alias("done"), F.lit(T.NOW).cast("timestamp").alias("started_at")))
    sources = T.table(spark, sf, "part").select(brand.alias("source"), F.lit(None).cast("bigint").alias("baseline"),
                                                F.when(brand == "Brand#2", "browser").otherwise("html").alias("lane")).distinct()
    target = events.select(F.lit("p").alias("project"), "run_id", "source", F.lit("u").alias("uid"), F.lit("t").alias("title"),
                           F.col("started_at").alias("first_seen"), F.col("started_at").alias("last_seen")).filter("false")
    runs = run_cycle(events, target, sources, T.runs(spark, sf).filter("false"), template("products"), Context(regions=["DE"], now=T.NOW), project="p", max_pages=4,
                     max_rows=10 ** 12, now=T.NOW, capped=True).runs
    return runs.select("source", "status", "stopped", "complete", "rows_stored", "rows_quarantined", "error")


CYCLE_STOPS_SQL = """WITH p AS (SELECT *, (p_partkey - 1) // 50 + 1 AS page FROM part),
  r AS (SELECT p_brand AS source, count(*) FILTER (reached AND p_size <> 7) AS good, count(*) FILTER (reached AND p_size = 7) AS bad FROM (SELECT *,
      CASE p_brand WHEN 'Brand#1' THEN page = 1 WHEN 'Brand#2' THEN page <= 2 WHEN 'Brand#3' THEN page = 1 WHEN 'Brand#5' THEN false ELSE page <= 4 END AS reached FROM p) GROUP BY 1)
  SELECT source, CASE source WHEN 'Brand#1' THEN 'ok' WHEN 'Brand#3' THEN 'error' WHEN 'Brand#5' THEN 'error' ELSE 'partial' END AS status,
    CASE source WHEN 'Brand#1' THEN 'empty_page' WHEN 'Brand#2' THEN 'page1_only' WHEN 'Brand#3' THEN 'errors' WHEN 'Brand#5' THEN 'fetch_failed' ELSE 'max_pages' END AS stopped,
    source = 'Brand#1' AS complete, good AS rows_stored, CASE WHEN good + bad > 0 THEN bad END AS rows_quarantined,
    CASE source WHEN 'Brand#3' THEN 'problem on page 2' WHEN 'Brand#5' THEN 'no rows: 1 request(s) failed' END AS error FROM r"""


QUERIES = {
    "cycle_stops": (cycle_stops, CYCLE_STOPS_SQL),
    "cycle_runs": (cycle_runs, CYCLE_SQL),
    "cycle_records": (cycle_records, CYCLE_RECORDS_SQL),
    "stream_ingest": (stream_ingest, INGEST_SQL),
    "stream_dedup": (stream_dedup, "SELECT DISTINCT user_id AS run_id, event_type || ':' || CAST(floor(value / 10) AS BIGINT) AS key FROM events"),
    "stream_clock_guard": (stream_clock_guard, "SELECT event_id, event_id % 7 = 0 AS ahead FROM events"),
    "stream_usage": (stream_usage, """SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS source, count(*) AS requests,
        CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS bytes, count(*) >= 4 AS over_budget FROM events GROUP BY 1, 2"""),
    "stream_walk_verdict": (stream_walk_verdict, _verdict_sql()),
    "stream_alerts": (stream_alerts, ALERTS_SQL),
    "stream_stuck": (stream_stuck, STUCK_SQL),
    "alert_delivery": (alert_delivery, DELIVERY_SQL),
    "exported_records": (exported_records, EXPORT_SQL),
}
