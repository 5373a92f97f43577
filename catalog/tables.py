"""The driver's tables in the roles of the engine's tables, in Spark and (as text) in SQL.

documents stand in for stored records, events for the run history, nations and suppliers for the source registry.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordworks.session import settled

NOW = dt.datetime(2024, 1, 30)
NOW_SQL = "TIMESTAMP '2024-01-30 00:00:00'"
EPOCH = 1704067200
EPOCH_SQL = "TIMESTAMP '2024-01-01 00:00:00'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over all partitions of a shuffle by their keys.  A compact file is a few row groups and is read by as few tasks, which matters
    when a row takes long to parse."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`dealt` rows of a handful of bytes that become pages or listings, written like this: filters over what is derived from them, which parse too,
    would otherwise be moved in front of the shuffle."""
    return settled(dealt(df, *keys))


def now():
    return F.lit(NOW).cast("timestamp")


def clock(seconds):
    """Seconds after 2024-01-01 as ISO text."""
    return F.date_format(F.timestamp_seconds(F.lit(EPOCH) + seconds), "yyyy-MM-dd HH:mm:ss")


def clock_sql(seconds: str) -> str:
    return f"strftime({EPOCH_SQL} + to_seconds({seconds}), '%Y-%m-%d %H:%M:%S')"


def records(spark: SparkSession, sf: str) -> DataFrame:
    """documents as stored records: seen once an hour, two runs per source."""
    return table(spark, sf, "documents").select(
        F.lit("p").alias("project"), F.col("doc_id").cast("string").alias("uid"), "source", "doc_id", "lang", "n_chars", "text",
        F.substring(F.sha1("text"), 1, 20).alias("fingerprint"), F.lit("2024-01-01 00:00:00").alias("first_seen"),
        clock(F.col("doc_id") * 60).alias("last_seen"), F.concat(F.lit("r"), F.col("doc_id") % 2).alias("run_id"))


RECORDS_SQL = f"""(SELECT 'p' AS project, CAST(doc_id AS VARCHAR) AS uid, source, doc_id, lang, n_chars, text,
  substr(sha1(text), 1, 20) AS fingerprint, '2024-01-01 00:00:00' AS first_seen, {clock_sql('doc_id * 60')} AS last_seen,
  'r' || (doc_id % 2) AS run_id FROM documents)"""

STATUS = {"purchase": "ok", "view": "partial", "click": "degraded", "signup": "empty", "error": "error"}


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """events as the run history: one source per user."""
    status = F.col("event_type")
    mapped = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[status]
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        F.concat(F.lit("s"), F.col("user_id")).alias("source"), F.col("event_id").alias("run_id"), mapped.alias("status"),
        F.when(status.isin("signup", "error"), 0).otherwise(F.floor("value")).cast("bigint").alias("rows_stored"),
        ts.alias("started_at"), ts.alias("heartbeat_at"), (ts + F.expr("INTERVAL 1 MINUTE")).alias("finished_at"),
        F.lit("done").alias("stopped"), F.when(status == "error", "boom").alias("error"), "value")


RUNS_SQL = """(SELECT 's' || user_id AS source, event_id AS run_id,
  CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'view' THEN 'partial' WHEN 'click' THEN 'degraded' WHEN 'signup' THEN 'empty'
    ELSE 'error' END AS status,
  CAST(CASE WHEN event_type IN ('signup', 'error') THEN 0 ELSE floor(value) END AS BIGINT) AS rows_stored,
  ts AS started_at, ts AS heartbeat_at, ts + INTERVAL 1 MINUTE AS finished_at, 'done' AS stopped,
  CASE WHEN event_type = 'error' THEN 'boom' END AS error, value FROM events)"""


def running(spark: SparkSession, sf: str) -> DataFrame:
    """The run history with the views still running."""
    return runs(spark, sf).withColumn("status", F.when(F.col("status") == "partial", "running").otherwise(F.col("status")))


RUNNING_SQL = f"""(SELECT * REPLACE (CASE WHEN status = 'partial' THEN 'running' ELSE status END AS status) FROM {RUNS_SQL})"""


def run_sources(spark: SparkSession, sf: str) -> DataFrame:
    """One registry row per user."""
    return table(spark, sf, "events").select("user_id").distinct().select(
        F.concat(F.lit("s"), F.col("user_id")).alias("source"), (F.col("user_id") % 5 != 0).alias("enabled"),
        F.when(F.col("user_id") % 7 == 0, "review_stale").otherwise("enabled").alias("status"), F.lit(900).alias("time_budget_s"),
        F.when(F.col("user_id") % 3 == 0, 1.0).otherwise(F.lit(None).cast("double")).alias("cadence_hours"),
        F.lit(dt.datetime(2024, 1, 1)).cast("timestamp").alias("updated_at"))


RUN_SOURCES_SQL = """(SELECT DISTINCT 's' || user_id AS source, user_id % 5 <> 0 AS enabled,
  CASE WHEN user_id % 7 = 0 THEN 'review_stale' ELSE 'enabled' END AS status, 900 AS time_budget_s,
  CASE WHEN user_id % 3 = 0 THEN 1.0 END AS cadence_hours, TIMESTAMP '2024-01-01' AS updated_at FROM events)"""


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """suppliers as the source registry: two regions and one angle each."""
    angles = F.array(*[F.lit(a) for a in ANGLES])
    n = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("source"), F.concat(F.lit("site"), n, F.lit(".example")).alias("site"),
        F.when(n % 11 == 0, "rejected").when(n % 13 == 0, "blocked").when(n % 17 == 0, F.lit(None)).otherwise("enabled").alias("status"),
        F.when(n % 3 == 0, "feed").when(n % 3 == 1, "html").alias("lane"), (n % 4 != 0).alias("enabled"),
        F.array(F.concat(F.lit("N"), F.col("s_nationkey")), F.concat(F.lit("N"), (F.col("s_nationkey") + 1) % 25)).alias("regions"),
        F.array(F.element_at(angles, (n % 3 + 1).cast("int"))).alias("angles"))


ANGLES = ["classifieds", "official", "operators"]
REGIONS = [f"N{i}" for i in range(25)]
REGISTRY_SQL = """(SELECT s_name AS source, 'site' || s_suppkey || '.example' AS site,
  CASE WHEN s_suppkey % 11 = 0 THEN 'rejected' WHEN s_suppkey % 13 = 0 THEN 'blocked' WHEN s_suppkey % 17 = 0 THEN NULL
    ELSE 'enabled' END AS status,
  CASE s_suppkey % 3 WHEN 0 THEN 'feed' WHEN 1 THEN 'html' END AS lane, s_suppkey % 4 <> 0 AS enabled,
  ['N' || s_nationkey, 'N' || ((s_nationkey + 1) % 25)] AS regions,
  [['classifieds', 'official', 'operators'][CAST(s_suppkey % 3 + 1 AS INT)]] AS angles FROM supplier)"""
