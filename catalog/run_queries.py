"""Queries over run histories and the source registry: walks, status, health, alerts, coverage, admission."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordworks.operators import coverage, health, keyed, lookups, walk

from . import tables as T


# ------------------------------------------------------------------------------------------------------------------- walks
def _walk_rows(spark, sf):
    return T.table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.dayofmonth("ts").alias("page"), F.col("event_id").alias("pos"),
        F.concat("event_type", F.lit(":"), (F.floor(F.col("value") / 10)).cast("string")).alias("key"), "event_id")


_WALK_SQL = """(SELECT user_id AS run_id, day(ts) AS page, event_id AS pos, event_type || ':' || CAST(floor(value / 10) AS BIGINT) AS key,
  event_id FROM events)"""
_FRESH_SQL = f"""(SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY page, pos) AS nth FROM (SELECT * FROM {_WALK_SQL}
  QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY page, pos) = 1))"""


def dedup_walk(spark, sf):
    return walk.dedup_walk(_walk_rows(spark, sf)).select("run_id", "key", "event_id")


def dedup_walk_capped(spark, sf):
    return walk.dedup_walk(_walk_rows(spark, sf), 20).select("run_id", "key", "event_id")


def _pages(spark, sf):
    """Each run's events as its pages: errors as failed pages, small values as empty or repeated ones."""
    window = Window.partitionBy("user_id").orderBy("event_id")
    value = F.col("value")
    return T.table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.row_number().over(window).cast("int").alias("page"),
        F.when(value < 2, 0).otherwise(10).alias("raw_count"), F.when(value < 40, 0).otherwise(F.floor(value / 20).cast("int")).alias("fresh_count"),
        F.when((F.col("event_type") == "error") & (value > 60), F.lit("boom")).alias("error"),
        (value < 1).alias("http_failed"), (value > 190).alias("done"))


_PAGES_SQL = """(SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page,
  CASE WHEN value < 2 THEN 0 ELSE 10 END AS raw_count, CASE WHEN value < 40 THEN 0 ELSE floor(value / 20) END AS fresh_count,
  event_type = 'error' AND value > 60 AS failed, value < 1 AS http_failed, value > 190 AS done FROM events)"""
VERDICT_SQL = f"""
WITH p AS (SELECT * FROM {_PAGES_SQL} WHERE page <= 40),
a AS (SELECT *, sum(CAST(failed AS INT)) OVER w AS errors, sum(CASE WHEN failed THEN 0 ELSE fresh_count END) OVER w AS total,
  CASE WHEN NOT failed THEN fresh_count = 0 AND raw_count > 0 END AS dry FROM p WINDOW w AS (PARTITION BY run_id ORDER BY page)),
b AS (SELECT *, last_value(dry IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM a),
c AS (SELECT *, CASE WHEN failed THEN CASE WHEN errors >= 2 THEN 'errors' END WHEN done THEN 'done'
  WHEN raw_count = 0 THEN CASE WHEN http_failed THEN 'fetch_failed' ELSE 'empty_page' END
  WHEN dry AND COALESCE(was, false) THEN 'repeating' WHEN total >= 60 THEN 'max_rows' END AS stop FROM b),
d AS (SELECT *, min(CASE WHEN stop IS NOT NULL THEN page END) OVER (PARTITION BY run_id) AS stop_page FROM c),
t AS (SELECT run_id, COALESCE(max(CASE WHEN page = stop_page THEN stop END), 'max_pages') AS stopped, max(page) AS pages,
  CAST(least(max(total), 60) AS BIGINT) AS rows, count(*) FILTER (failed) AS page_errors, count(*) FILTER (http_failed) AS http_failures
  FROM d WHERE stop_page IS NULL OR page <= stop_page GROUP BY run_id)
SELECT *, stopped IN ('done', 'empty_page', 'repeating') AND page_errors = 0 AND http_failures = 0 AS complete FROM t"""


def walk_verdict(spark, sf):
    return walk.walk_verdict(_pages(spark, sf), 40, 60)


def run_counters(spark, sf):
    rows = T.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.dayofmonth("ts").alias("page"), (F.col("value") > 10).alias("stored"))
    return walk.run_counters(rows)


def recent_yield(spark, sf):
    return walk.recent_yield(T.runs(spark, sf))


def run_status(spark, sf):
    rows = T.table(spark, sf, "events")
    stopped = F.element_at(F.array(*map(F.lit, ["done", "crashed", "time_budget", "max_pages", "empty_page"])), (F.col("event_id") % 5 + 1).cast("int"))
    stored = F.floor(F.when(F.col("value") < 20, 0).otherwise(F.col("value"))).cast("bigint")
    error = F.when(F.col("event_type") == "error", "boom")
    status = walk.run_status(stopped, stored, F.col("event_id") % 2 == 0, error, F.col("user_id"), F.col("event_id") % 3 == 0)
    return rows.select("event_id", status.alias("status"))


RUN_STATUS_SQL = """
WITH e AS (SELECT *, ['done', 'crashed', 'time_budget', 'max_pages', 'empty_page'][CAST(event_id % 5 + 1 AS INT)] AS stopped,
  CASE WHEN value < 20 THEN 0 ELSE floor(value) END AS stored FROM events)
SELECT event_id, CASE WHEN stopped = 'crashed' THEN 'error' WHEN stopped = 'time_budget' AND stored = 0 THEN 'timeout'
  WHEN stored = 0 AND event_type = 'error' THEN 'error' WHEN stored = 0 THEN 'empty'
  WHEN user_id >= 20 AND stored < 0.5 * user_id AND NOT (event_id % 3 = 0 AND stopped = 'max_pages') THEN 'degraded'
  WHEN event_id % 2 = 0 THEN 'ok' ELSE 'partial' END AS status FROM e"""


def fetch_outcomes(spark, sf):
    outcome = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "blocked").when(F.col("event_type") == "click", "gated").otherwise("ok")
    return walk.fetch_outcomes(T.table(spark, sf, "events").select(F.col("user_id").alias("host"), outcome.alias("outcome")))


def usage_rollup(spark, sf):
    requests = T.table(spark, sf, "events").select(F.col("user_id").alias("source"), "ts", F.round(F.col("value") * 100).cast("bigint").alias("bytes"))
    return walk.usage_rollup(requests).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def usage_remaining(spark, sf):
    return walk.usage_remaining(usage_rollup(spark, sf), 340, 3000000)


# ------------------------------------------------------------------------------------------------------------------ health
def last_finished_run(spark, sf):
    return health.last_finished_run(T.running(spark, sf), T.now()).select("source", "run_id", "status")


def latest_per_key(spark, sf):
    return keyed.latest_per_key(T.runs(spark, sf), ["source", "status"], [F.col("started_at"), F.col("run_id")]).select("source", "status", "run_id")


def dry_streak(spark, sf):
    rounds = T.table(spark, sf, "events").select(F.col("user_id").alias("project"), F.col("event_id").alias("seq"),
                                                 F.when(F.col("value") > 40, 1).otherwise(0).alias("added"))
    return coverage.dry_streak(rounds, ["project"])


def health_findings(spark, sf):
    return health.health_findings(T.running(spark, sf), T.run_sources(spark, sf), T.now()).select("source", "kind", "key")


_FINDINGS_SQL = f"""
WITH last5 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) AS rank FROM {T.RUNNING_SQL} QUALIFY rank <= 5),
steady AS (SELECT * FROM last5 WHERE heartbeat_at <= {T.NOW_SQL} + INTERVAL 5 MINUTE),
done AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS n FROM steady WHERE status <> 'running'),
facts AS (SELECT s.*,
  (SELECT count(*) FROM last5 l WHERE l.source = s.source AND l.heartbeat_at > {T.NOW_SQL} + INTERVAL 5 MINUTE) AS ahead,
  (SELECT count(*) FROM done d WHERE d.source = s.source) AS n_done,
  (SELECT count(*) FROM done d WHERE d.source = s.source AND n <= 2 AND rows_stored > 0) AS stored2,
  (SELECT max(status) FROM done d WHERE d.source = s.source AND n = 1) AS last_status,
  (SELECT count(*) FROM done d WHERE d.source = s.source AND n <= 3 AND status = 'error') AS errors3,
  (SELECT max(started_at) FROM steady d WHERE d.source = s.source AND status IN ('ok', 'partial', 'degraded')) AS good
  FROM {T.RUN_SOURCES_SQL} s),
findings AS (
  SELECT source, 'clock_skew' AS kind, NULL AS key FROM facts WHERE ahead > 0
  UNION ALL SELECT source, 'review_stale', NULL FROM facts WHERE status = 'review_stale'
  UNION ALL SELECT source, 'zero', NULL FROM facts WHERE enabled AND n_done >= 2 AND stored2 = 0
  UNION ALL SELECT source, 'degraded', NULL FROM facts WHERE enabled AND last_status = 'degraded'
  UNION ALL SELECT source, 'error_streak', NULL FROM facts WHERE enabled AND errors3 = 3
  UNION ALL SELECT source, 'stale', NULL FROM facts WHERE enabled AND {T.NOW_SQL} - COALESCE(good, updated_at) > to_seconds(CAST(2 * 3600 * COALESCE(cadence_hours, 24) AS BIGINT))
  UNION ALL SELECT source, 'stuck', CAST(run_id AS VARCHAR) FROM steady WHERE status = 'running' AND {T.NOW_SQL} - heartbeat_at > INTERVAL 1800 SECOND)"""
FINDING_KINDS = ["zero", "degraded", "error_streak", "stuck", "stale", "clock_skew"]


def _finding(kind):
    def build(spark, sf):
        return health_findings(spark, sf).filter(F.col("kind") == kind).select("source", F.coalesce("key", F.lit("")).alias("key"))
    return build


def close_stuck(spark, sf):
    runs = T.running(spark, sf)
    found = health.health_findings(runs, T.run_sources(spark, sf), T.now())
    closed = health.close_stuck(runs, found.withColumn("key", F.col("key").cast("bigint")), T.now())
    return closed.groupBy("status").agg(F.count("*").alias("n"))


def due_sources(spark, sf):
    return health.due_sources(T.run_sources(spark, sf), T.running(spark, sf), T.now())


DUE_SQL = f"""
WITH l AS (SELECT source, max(started_at) AS started FROM {T.RUNNING_SQL} WHERE status <> 'running' AND started_at <= {T.NOW_SQL} + INTERVAL 5 MINUTE GROUP BY 1),
s AS (SELECT source, COALESCE(cadence_hours, 24) AS hours FROM {T.RUN_SOURCES_SQL})
SELECT source, started IS NULL OR epoch({T.NOW_SQL}) - floor(epoch(started)) >= hours * 3600 - 300 AS due,
  COALESCE(strftime(date_trunc('second', started) + to_seconds(CAST(hours * 3600 AS BIGINT)), '%Y-%m-%dT%H:%M:%S'), 'now') AS next_due FROM s LEFT JOIN l USING (source)"""


def _alerts(spark, sf):
    return T.table(spark, sf, "events").filter(F.col("event_type").isin("click", "error")).select(
        F.concat(F.lit("s"), F.col("user_id")).alias("source"),
        F.element_at(F.array(*map(F.lit, ["zero", "degraded", "stuck", "stale"])), (F.col("event_id") % 4 + 1).cast("int")).alias("kind"),
        F.when(F.col("event_id") % 4 == 2, (F.col("event_id") - F.col("event_id") % 7).cast("string")).alias("key"),
        F.col("ts").cast("timestamp").alias("created_at"))


_ALERTS_SQL = """(SELECT 's' || user_id AS source, ['zero', 'degraded', 'stuck', 'stale'][CAST(event_id % 4 + 1 AS INT)] AS kind,
  CASE WHEN event_id % 4 = 2 THEN CAST(event_id - event_id % 7 AS VARCHAR) END AS key, ts AS created_at FROM events WHERE event_type IN ('click', 'error'))"""


def suppress_alerts(spark, sf):
    findings = health.health_findings(T.running(spark, sf), T.run_sources(spark, sf), T.now()).select("source", "kind", F.col("key").cast("string").alias("key"))
    raised = health.suppress_alerts(findings, _alerts(spark, sf), T.running(spark, sf), T.now())
    return raised.select("source", "kind", F.coalesce("key", F.lit("")).alias("key"))


SUPPRESS_SQL = _FINDINGS_SQL + f""", al AS (SELECT * FROM {_ALERTS_SQL}),
last AS (SELECT source, kind, max(created_at) AS at FROM al GROUP BY ALL),
good AS (SELECT source, max(finished_at) AS at FROM {T.RUNNING_SQL} WHERE status IN ('ok', 'partial') GROUP BY ALL)
SELECT f.source, f.kind, COALESCE(f.key, '') AS key FROM findings f LEFT JOIN last USING (source, kind) LEFT JOIN good ON good.source = f.source
WHERE CASE WHEN f.key IS NOT NULL THEN NOT EXISTS (SELECT 1 FROM al WHERE al.source = f.source AND al.kind = f.kind AND al.key = f.key
    AND epoch(al.created_at) > epoch({T.NOW_SQL}) - 86400)
  ELSE last.at IS NULL OR floor(epoch(last.at)) <= epoch({T.NOW_SQL}) - 86400
    OR (f.kind IN ('zero', 'degraded', 'error_streak', 'stale', 'review_stale') AND COALESCE(good.at > last.at, false)) END"""


def pending_alerts(spark, sf):
    alerts = _alerts(spark, sf).withColumn("alert_id", F.xxhash64("source", "created_at")).select(
        F.concat_ws("/", "source", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).alias("alert_id"), "created_at")
    tried = T.table(spark, sf, "events").select(
        F.concat_ws("/", F.concat(F.lit("s"), F.col("user_id")), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("alert_id"), (F.col("value") > 20).alias("delivered"))
    return health.pending_alerts(alerts, tried, T.now()).select("alert_id")


def source_view(spark, sf):
    runs = T.running(spark, sf)
    reviews = keyed.latest_per_key(T.runs(spark, sf), ["source"], [F.col("rows_stored"), F.col("run_id")]).select("source", F.col("status").alias("verdict"))
    counts = T.runs(spark, sf).groupBy("source").agg(F.count("*").alias("records"))
    usage = usage_rollup(spark, sf).filter("day = '2024-01-29'").select(F.concat(F.lit("s"), F.col("source")).alias("source"), "requests")
    return lookups.source_view(T.run_sources(spark, sf).select("source", "enabled"), health.last_finished_run(runs, T.now()), reviews, counts, usage).select(
        "source", "enabled", "last_status", "last_rows_stored", "review_verdict", "records", "requests")


SOURCE_VIEW_SQL = f"""
SELECT s.source, s.enabled, l.status AS last_status, l.rows_stored AS last_rows_stored, r.status AS review_verdict, c.records, u.requests
FROM {T.RUN_SOURCES_SQL} s
LEFT JOIN (SELECT * FROM {T.RUNNING_SQL} WHERE status <> 'running' AND started_at <= {T.NOW_SQL} + INTERVAL 5 MINUTE
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) = 1) l USING (source)
LEFT JOIN (SELECT * FROM {T.RUNS_SQL} QUALIFY row_number() OVER (PARTITION BY source ORDER BY rows_stored DESC, run_id DESC) = 1) r USING (source)
LEFT JOIN (SELECT source, count(*) AS records FROM {T.RUNS_SQL} GROUP BY 1) c USING (source)
LEFT JOIN (SELECT source, count(*) AS requests FROM {T.RUNS_SQL} WHERE CAST(started_at AS DATE) = DATE '2024-01-29' GROUP BY 1) u USING (source)"""


# ---------------------------------------------------------------------------------------------------------------- coverage
def coverage_matrix(spark, sf):
    return coverage.coverage_matrix(T.registry(spark, sf), T.REGIONS, T.ANGLES)


_CELLS_SQL = f"""(SELECT g.region, g.angle, count(s.source) AS sources FROM
  (SELECT 'N' || n_nationkey AS region, unnest(['classifieds', 'official', 'operators']) AS angle FROM nation) g
  LEFT JOIN {T.REGISTRY_SQL} s ON list_contains(s.regions, g.region) AND list_contains(s.angles, g.angle) AND COALESCE(s.status, '') <> 'rejected'
  GROUP BY ALL)"""


def coverage_wide(spark, sf):
    return coverage.coverage_wide(coverage_matrix(spark, sf), T.ANGLES)


def coverage_gaps(spark, sf):
    return coverage.coverage_gaps(coverage_matrix(spark, sf))


def coverage_angles(spark, sf):
    return coverage.angles_per_region(coverage_matrix(spark, sf)).select("region", F.array_join("covered", ",").alias("covered"), F.array_join("todo", ",").alias("todo"))


def coverage_verdict(spark, sf):
    rounds = T.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.when(F.col("value") > 60, 1).otherwise(0).alias("added"))
    return coverage.coverage_verdict(T.registry(spark, sf), rounds, coverage_matrix(spark, sf), 100000)


def known_sites(spark, sf):
    return coverage.known_sites(T.registry(spark, sf))


def admit(spark, sf):
    candidates = T.table(spark, sf, "customer").select(F.col("c_name").alias("site"), F.hash("c_name").alias("h"), F.col("c_custkey").alias("arrival"),
                                                       (F.col("c_acctbal") < 0).alias("blocked"))
    return coverage.admit(candidates, 10, 60, 170).select("site", "decision")


ADMIT_SQL = """
WITH c AS (SELECT c_name AS site, c_custkey AS arrival, c_acctbal < 0 AS blocked,
  row_number() OVER (PARTITION BY c_acctbal < 0 ORDER BY c_custkey) AS n FROM customer)
SELECT site, CASE WHEN blocked THEN CASE WHEN n <= 10 THEN 'blocked' ELSE 'rejected' END WHEN n <= 50 THEN 'added' ELSE 'deferred' END AS decision FROM c"""


def admit_large(spark, sf):
    """A budget of about half of all orders, with arrivals that many orders share: the cut is found without a sort."""
    n = F.col("o_orderkey")
    candidates = T.table(spark, sf, "orders").select(n.cast("string").alias("site"), (F.col("o_custkey") % 40).alias("arrival"), F.lit(None).cast("boolean").alias("blocked"))
    total = candidates.count()
    decided = coverage.admit(candidates, 0, total // 2)
    return decided.groupBy("arrival").agg(F.count_if(F.col("decision") == "added").alias("added"), F.count_if(F.col("decision") == "deferred").alias("deferred"))


ADMIT_LARGE_SQL = """WITH c AS (SELECT o_custkey % 40 AS arrival, count(*) AS n, sum(count(*)) OVER (ORDER BY o_custkey % 40) - count(*) AS before FROM orders GROUP BY 1),
  t AS (SELECT count(*) // 2 AS room FROM orders)
SELECT arrival, CAST(greatest(0, least(n, room - before)) AS BIGINT) AS added, CAST(n - greatest(0, least(n, room - before)) AS BIGINT) AS deferred FROM c, t"""


def deferred_set(spark, sf):
    parts = T.table(spark, sf, "part").withColumn("site", F.concat_ws("-", "p_name", "p_partkey"))
    old, batch = parts.filter("p_size < 20").select("site"), parts.filter("p_size > 15").select("site")
    return coverage.readmit(coverage.defer(old, batch), parts.filter("p_retailprice < 950").select("site"))


def _merged(spark, sf):
    registry = T.registry(spark, sf).select(
        F.col("source").alias("id"), F.concat(F.lit("site"), F.regexp_extract("source", r"0*(\d+)$", 1), F.lit(".example")).alias("site"),
        F.lit("u").alias("url"), "status", F.array(F.lit("PT")).alias("regions"), "angles",
        F.array().cast("array<struct<url:string,observation:string>>").alias("evidence"))
    n = F.col("o_orderkey")
    url = F.concat(F.lit("https://www.site"), (n % 3000).cast("string"), F.lit(".example/list/"), n.cast("string"))
    seen = F.when(F.col("o_custkey") % 31 != 0, "seen")
    candidates = T.table(spark, sf, "orders").select(
        n.alias("arrival"), url.alias("url"), F.array(F.when(F.col("o_orderstatus") == "F", "Spain").otherwise("PT")).alias("regions"),
        F.array(F.when(F.col("o_custkey") % 50 == 0, "gossip").when(F.col("o_custkey") % 2 == 0, "official").otherwise("operators")).alias("angles"),
        F.array(F.struct(url.alias("url"), seen.alias("observation"), F.when(n % 2 == 0, "2024-01-05").alias("seen_at")),
                F.struct(F.concat(F.lit("https://press.test/"), n).alias("url"), F.lit("read").alias("observation"), F.lit("2024-01-06").alias("seen_at"))).alias("evidence"),
        F.lit(False).alias("blocked"), F.lit(None).cast("string").alias("mirror_of"))
    return coverage.merge_candidates(registry, candidates, ["PT", "ES"], 400, now=T.NOW)


def merge_candidates(spark, sf):
    found = F.col("evidence")
    count = lambda test: F.size(F.filter(found, test))
    return _merged(spark, sf).registry.select(
        "site", F.array_join("regions", ",").alias("regions"), F.array_join("angles", ",").alias("angles"), F.size(found).alias("proofs"), count(lambda e: e["on_domain"]).alias("own"),
        count(lambda e: e["seen_at"] == "2024-01-30 00:00:00").alias("undated"), count(lambda e: e["seen_at"].isNull()).alias("timeless"))


def merge_deferred(spark, sf):
    return _merged(spark, sf).deferred.select("site", "arrival", F.array_join("regions", ",").alias("regions"), F.size("evidence").alias("proofs"))


def merge_rejected(spark, sf):
    return _merged(spark, sf).rejected.select("arrival", "reason")


def merge_counts(spark, sf):
    return _merged(spark, sf).counts


_MERGE_CTES = f"""
WITH o AS (SELECT *, o_custkey % 50 = 0 AS gossip, o_custkey % 31 = 0 AS bare FROM orders),
c AS (SELECT o_orderkey AS arrival, 'site' || (o_orderkey % 3000) || '.example' AS site, CASE WHEN o_orderstatus = 'F' THEN 'ES' ELSE 'PT' END AS region,
    CASE WHEN o_custkey % 2 = 0 THEN 'official' ELSE 'operators' END AS angle FROM o WHERE NOT gossip AND NOT bare),
reg AS (SELECT * FROM {T.REGISTRY_SQL}),
new AS (SELECT site, min(arrival) AS first FROM c WHERE site NOT IN (SELECT site FROM reg) GROUP BY 1),
room AS (SELECT 400 - count(*) FILTER (COALESCE(status, '') NOT IN ('rejected', 'blocked', 'lane_none')) AS n FROM reg),
added AS (SELECT site, first FROM new QUALIFY row_number() OVER (ORDER BY first) <= (SELECT n FROM room)),
entering AS (SELECT * FROM c WHERE site IN (SELECT site FROM reg) OR site IN (SELECT site FROM added))"""
MERGE_SQL = _MERGE_CTES + """,
r AS (SELECT site, region, min(arrival) AS nth FROM (SELECT site, region, arrival FROM entering UNION ALL SELECT site, 'PT', -1 FROM reg) GROUP BY ALL),
a AS (SELECT site, angle, min(arrival) AS nth FROM (SELECT site, angle, arrival FROM entering UNION ALL SELECT site, angles[1], -1 FROM reg) GROUP BY ALL)
SELECT site, regions, angles, COALESCE(proofs, 0)::INT AS proofs, COALESCE(own, 0)::INT AS own, COALESCE(undated, 0)::INT AS undated, 0 AS timeless FROM
  (SELECT site, string_agg(region, ',' ORDER BY nth) AS regions FROM r GROUP BY 1)
  JOIN (SELECT site, string_agg(angle, ',' ORDER BY nth) AS angles FROM a GROUP BY 1) USING (site)
  LEFT JOIN (SELECT site, 2 * count(*) AS proofs, count(*) AS own, count(*) FILTER (arrival % 2 = 1) AS undated FROM entering GROUP BY 1) USING (site)"""
_DEFERRED_SQL = """SELECT c.site, c.arrival, c.region AS regions, 2 AS proofs FROM c JOIN new n ON n.site = c.site AND n.first = c.arrival WHERE c.site NOT IN (SELECT site FROM added)"""
MERGE_DEFERRED_SQL = _MERGE_CTES + " " + _DEFERRED_SQL
MERGE_REJECTED_SQL = _MERGE_CTES + """ SELECT o_orderkey AS arrival, CASE WHEN gossip THEN 'unknown angle' ELSE 'evidence must include a URL on the site''s own domain with an observation' END AS reason
  FROM o WHERE gossip OR bare UNION ALL SELECT arrival, 'max_sources reached; deferred' FROM c WHERE site IN (SELECT site FROM new) AND site NOT IN (SELECT site FROM added)"""
MERGE_COUNTS_SQL = _MERGE_CTES + """ SELECT (SELECT count(*) FROM added) AS added, (SELECT count(*) FROM entering) - (SELECT count(*) FROM added) AS merged,
  (SELECT count(*) FROM o) - (SELECT count(*) FROM entering) AS rejected"""


def site_slugs(spark, sf):
    # two sites may share a slug: the second one gets a number
    names = T.table(spark, sf, "part").select(F.concat("p_name", F.when(F.col("p_size") % 2 == 0, ".x").otherwise("-x")).alias("site")).distinct()
    return coverage.with_slugs(names.withColumn("id", F.lit(None).cast("string"))).select("site", "id")


QUERIES = {
    "dedup_walk": (dedup_walk, f"SELECT run_id, key, event_id FROM {_FRESH_SQL}"),
    "dedup_walk_capped": (dedup_walk_capped, f"SELECT run_id, key, event_id FROM {_FRESH_SQL} WHERE nth <= 20"),
    "walk_verdict": (walk_verdict, VERDICT_SQL),
    "run_counters": (run_counters, """SELECT user_id AS run_id, max(day(ts)) AS pages, count(*) AS rows_fetched, count(*) FILTER (value > 10) AS rows_stored,
        count(*) FILTER (NOT value > 10) AS rows_quarantined FROM events GROUP BY 1"""),
    "recent_yield": (recent_yield, f"""SELECT source, list_sort(list(rows_stored))[CAST(floor(count(*) / 2) AS INT) + 1] AS recent_yield FROM
        (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) AS n FROM {T.RUNS_SQL}
         WHERE status IN ('ok', 'partial') AND rows_stored > 0) WHERE n <= 5 GROUP BY source"""),
    "run_status": (run_status, RUN_STATUS_SQL),
    "fetch_outcomes": (fetch_outcomes, """SELECT user_id AS host, count(*) AS requests, count(*) FILTER (event_type IN ('purchase', 'view')) AS ok,
        count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'signup') AS blocked,
        count(*) FILTER (event_type = 'click') AS gated, count(*) FILTER (event_type IN ('error', 'signup', 'click')) AS failures FROM events GROUP BY 1"""),
    "usage_rollup": (usage_rollup, """SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS source, count(*) AS requests,
        CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY 1, 2"""),
    "usage_remaining": (usage_remaining, """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS used_requests,
        CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS used_bytes, greatest(0, 340 - count(*)) AS requests_left,
        CAST(greatest(0, 3000000 - sum(CAST(round(value * 100) AS BIGINT))) AS BIGINT) AS bytes_left FROM events GROUP BY 1"""),
    "last_finished_run": (last_finished_run, f"""SELECT source, run_id, status FROM {T.RUNNING_SQL} WHERE status <> 'running'
        AND started_at <= {T.NOW_SQL} + INTERVAL 5 MINUTE QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) = 1"""),
    "latest_per_key": (latest_per_key, f"""SELECT source, status, run_id FROM {T.RUNS_SQL}
        QUALIFY row_number() OVER (PARTITION BY source, status ORDER BY started_at DESC, run_id DESC) = 1"""),
    "dry_streak": (dry_streak, """SELECT user_id AS project, count(*) FILTER (event_id > COALESCE(last, -1)) AS dry_streak FROM
        (SELECT *, max(CASE WHEN value > 40 THEN event_id END) OVER (PARTITION BY user_id) AS last FROM events) GROUP BY 1"""),
    "health_findings": (health_findings, _FINDINGS_SQL + " SELECT source, kind, key FROM findings"),
    **{f"health_{kind}": (_finding(kind), _FINDINGS_SQL + f" SELECT source, COALESCE(key, '') AS key FROM findings WHERE kind = '{kind}'")
       for kind in FINDING_KINDS},
    "close_stuck": (close_stuck, _FINDINGS_SQL + f""" SELECT CASE WHEN f.key IS NOT NULL THEN 'stuck' ELSE r.status END AS status, count(*) AS n
        FROM {T.RUNNING_SQL} r LEFT JOIN findings f ON f.kind = 'stuck' AND f.source = r.source AND f.key = CAST(r.run_id AS VARCHAR) GROUP BY 1"""),
    "due_sources": (due_sources, DUE_SQL),
    "suppress_alerts": (suppress_alerts, SUPPRESS_SQL),
    "pending_alerts": (pending_alerts, f"""WITH a AS (SELECT source || '/' || strftime(created_at, '%Y-%m-%d %H:%M:%S') AS alert_id, created_at FROM {_ALERTS_SQL}),
        t AS (SELECT 's' || user_id || '/' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS alert_id, count(*) AS n, bool_or(value > 20) AS d FROM events GROUP BY 1)
        SELECT a.alert_id FROM a LEFT JOIN t USING (alert_id) WHERE floor(epoch(created_at)) > epoch({T.NOW_SQL}) - 86400 AND NOT COALESCE(d, false) AND COALESCE(n, 0) < 20"""),
    "source_view": (source_view, SOURCE_VIEW_SQL),
    "coverage_matrix": (coverage_matrix, f"SELECT * FROM {_CELLS_SQL}"),
    "coverage_wide": (coverage_wide, f"""SELECT region, CAST(sum(sources) FILTER (angle = 'classifieds') AS BIGINT) AS classifieds,
        CAST(sum(sources) FILTER (angle = 'official') AS BIGINT) AS official, CAST(sum(sources) FILTER (angle = 'operators') AS BIGINT) AS operators
        FROM {_CELLS_SQL} GROUP BY region"""),
    "coverage_gaps": (coverage_gaps, f"SELECT region, angle FROM {_CELLS_SQL} WHERE sources = 0"),
    "coverage_angles": (coverage_angles, f"""SELECT region, COALESCE(string_agg(angle, ',' ORDER BY angle) FILTER (sources > 0), '') AS covered,
        COALESCE(string_agg(angle, ',' ORDER BY angle) FILTER (sources = 0), '') AS todo FROM {_CELLS_SQL} GROUP BY region"""),
    "coverage_verdict": (coverage_verdict, f"""WITH s AS (SELECT count(*) AS sources FROM {T.REGISTRY_SQL} WHERE COALESCE(status, '') NOT IN ('rejected', 'blocked', 'lane_none')),
        e AS (SELECT count(*) AS empty_cells FROM {_CELLS_SQL} WHERE sources = 0),
        d AS (SELECT count(*) AS dry_streak FROM events WHERE event_id > COALESCE((SELECT max(event_id) FROM events WHERE value > 60), -1))
        SELECT sources, empty_cells, dry_streak, sources >= 100000 AS budget_reached, dry_streak >= 2 AND empty_cells = 0 AND sources < 100000 AS saturated FROM s, e, d"""),
    "known_sites": (known_sites, f"SELECT DISTINCT site FROM {T.REGISTRY_SQL}"),
    "admit": (admit, ADMIT_SQL),
    "admit_large": (admit_large, ADMIT_LARGE_SQL),
    "deferred_set": (deferred_set, "SELECT p_name || '-' || p_partkey AS site FROM part WHERE NOT p_retailprice < 950"),
    "merge_candidates": (merge_candidates, MERGE_SQL),
    "merge_deferred": (merge_deferred, MERGE_DEFERRED_SQL),
    "merge_rejected": (merge_rejected, MERGE_REJECTED_SQL),
    "merge_counts": (merge_counts, MERGE_COUNTS_SQL),
    "site_slugs": (site_slugs, """WITH n AS (SELECT DISTINCT p_name || CASE WHEN p_size % 2 = 0 THEN '.x' ELSE '-x' END AS site FROM part),
        s AS (SELECT site, trim(regexp_replace(lower(site), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM n),
        k AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY site) AS n FROM s)
        SELECT site, CASE WHEN n = 1 THEN slug ELSE slug || '_' || n END AS id FROM k"""),
}
