"""Health findings, due sources and alert suppression over the run history.

Only the latest five runs of a source matter, so each source is reduced to an array of at most five small structs in one
pass; the findings are expressions over that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .keyed import latest_per_key, top_per_key

_RUN = ["status", "rows_stored", "started_at", "heartbeat_at", "finished_at", "stopped", "error", "run_id"]


def last_finished_run(runs: DataFrame, now: Column) -> DataFrame:
    """Latest finished run per source; runs stamped ahead of the clock are ignored."""
    limit = F.timestamp_micros(F.unix_micros(now) + K.SKEW_SECONDS * 1_000_000)
    finished = runs.filter((F.col("status") != "running") & (F.col("started_at").cast("timestamp") <= limit))
    return latest_per_key(finished, ["source"], [F.col("started_at"), F.col("run_id")])


def recent_runs(runs: DataFrame, n: int = K.HEALTH_WINDOW_RUNS) -> DataFrame:
    """source, recent: the latest `n` runs, newest first."""
    last = top_per_key(runs, ["source"], [F.col("started_at").desc(), F.col("run_id").desc()], n)
    run = F.struct("rank", *[F.col(c).cast("timestamp").alias(c) if c.endswith("_at") else F.col(c) for c in _RUN])
    return last.groupBy("source").agg(F.sort_array(F.collect_list(run)).alias("recent"))


def _seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def _micros(ts: Column) -> Column:
    """Exact time: whole seconds would move a heartbeat by up to one of them, and so across a limit."""
    return F.unix_micros(ts.cast("timestamp"))


def _found(condition: Column, kind: str, key: Column | None = None, detail: Column | None = None) -> Column:
    empty = F.lit(None).cast("string")
    return F.when(condition, F.struct(F.lit(kind).alias("kind"), (empty if key is None else key).alias("key"),
                                      (empty if detail is None else detail.cast("string")).alias("detail")))


def health_findings(runs: DataFrame, sources: DataFrame, now: Column, cadence: float = K.DEFAULT_CADENCE_HOURS) -> DataFrame:
    """findings(source, kind, key, detail) of sources(source, enabled, status, time_budget_s, cadence_hours, updated_at).
    Skewed runs are set aside first; disabled sources can only be skewed, stuck or awaiting review."""
    at, second = _micros(now), 1_000_000
    state = sources.join(recent_runs(runs), "source", "left")

    def ahead(r: Column) -> Column:
        return _micros(F.coalesce(r["heartbeat_at"], r["started_at"], now)) > at + K.SKEW_SECONDS * second

    limit = F.greatest(2 * F.coalesce("time_budget_s", F.lit(0)), F.lit(K.STUCK_MIN_SECONDS)).cast("bigint")
    state = state.withColumns({
        "skewed": F.filter("recent", ahead),
        "steady": F.filter("recent", lambda r: ~ahead(r)),
    }).withColumns({
        "done": F.filter("steady", lambda r: r["status"] != "running"),
        "stuck": F.filter("steady", lambda r: (r["status"] == "running") & (at - _micros(r["heartbeat_at"]) > limit * second)),
        "good": F.filter("steady", lambda r: r["status"].isin("ok", "partial", "degraded")),
        "hours": F.coalesce(F.col("cadence_hours").cast("double"), F.lit(float(cadence))),
    })
    done, enabled = F.col("done"), F.coalesce(F.col("enabled").cast("boolean"), F.lit(False))
    first = F.get("done", F.lit(0))
    nothing = F.forall(F.slice("done", 1, 2), lambda r: F.coalesce(r["rows_stored"], F.lit(0)) == 0)
    failed = F.forall(F.slice("done", 1, 3), lambda r: r["status"] == "error")
    reference = F.coalesce(F.get("good", F.lit(0))["started_at"], F.col("updated_at").cast("timestamp"))
    single = F.array_compact(F.array(
        _found(F.size("skewed") > 0, "clock_skew", None, F.get("skewed", F.lit(0))["run_id"]),
        _found(F.col("status") == "review_stale", "review_stale"),
        _found(enabled & (F.size(done) >= 2) & nothing, "zero", None, first["stopped"]),
        _found(enabled & (first["status"] == "degraded"), "degraded", None, first["rows_stored"]),
        _found(enabled & (F.size(done) >= 3) & failed, "error_streak", None, first["error"]),
        _found(enabled & (F.col("hours") > 0) & (at - _micros(reference) > 2 * 3600 * second * F.col("hours")), "stale", None, _seconds(reference)),
    ))
    stuck = F.transform(F.coalesce("stuck", F.array().cast(state.schema["stuck"].dataType)),
                        lambda r: F.struct(F.lit("stuck").alias("kind"), r["run_id"].cast("string").alias("key"),
                                           r["run_id"].cast("string").alias("detail")))
    return state.select("source", F.inline(F.concat(single, stuck)))


def close_stuck(runs: DataFrame, findings: DataFrame, now: Column) -> DataFrame:
    """Run history with the stuck runs closed."""
    stuck = findings.filter(F.col("kind") == "stuck").select("source", F.col("key").alias("run_id"), F.lit(True).alias("__stuck"))
    hit = F.col("__stuck").isNotNull()
    return runs.join(stuck, ["source", "run_id"], "left").withColumns({
        "status": F.when(hit, "stuck").otherwise(F.col("status")),
        "finished_at": F.when(hit, now).otherwise(F.col("finished_at").cast("timestamp")),
        "error": F.when(hit, "no heartbeat; closed by the health check").otherwise(F.col("error"))}).select(*runs.columns)


def cadence_hours(text: Column) -> Column:
    """'daily', '6h', 'every 2 days', a number of hours; NULL or '' is daily, an unknown text fails the job."""
    low = F.lower(F.trim(text.cast("string")))
    chain = F.when(low.isNull() | (low == ""), F.lit(K.DEFAULT_CADENCE_HOURS))
    for word, hours in K.CADENCE_HOURS.items():
        chain = chain.when(low == word, F.lit(float(hours)))
    shape = r"^(?:every\s*)?(\d+(?:\.\d+)?)\s*(h|hours?|d|days?|w|weeks?)$"
    unit = F.substring(F.regexp_extract(low, shape, 2), 1, 1)
    factor = F.when(unit == "h", 1.0).when(unit == "d", 24.0).otherwise(168.0)
    return (chain.when(low.rlike(shape), F.regexp_extract(low, shape, 1).try_cast("double") * factor)
            .when(low.try_cast("double").isNotNull(), low.try_cast("double"))
            .otherwise(F.raise_error(F.concat(F.lit("unknown cadence "), low)).cast("double")))


def due_sources(sources: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """source, due, next_due: due when the last finished run started a cadence (less five minutes) ago or never; a cadence
    of zero is manual."""
    last = last_finished_run(runs, now).select("source", F.col("started_at").cast("timestamp").alias("started"))
    hours = cadence_hours(F.col("cadence_hours"))
    state = sources.select("source", hours.alias("hours")).join(last, "source", "left")
    waited = _seconds(now) - _seconds(F.col("started"))
    due = (F.col("hours") > 0) & (F.col("started").isNull() | (waited >= F.col("hours") * 3600 - K.SKEW_SECONDS))
    next_due = F.when(F.col("hours") > 0, F.coalesce(
        F.date_format(F.timestamp_seconds(_seconds(F.col("started")) + F.col("hours") * 3600), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("now")))
    return state.select("source", due.alias("due"), next_due.alias("next_due"))


def suppress_alerts(findings: DataFrame, alerts: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Findings that deserve a new alert.  A keyed finding is alerted once per day; another one is held back for a day after
    its last alert, unless a healthy run has ended that incident since."""
    recent = _seconds(now) - K.REALERT_HOURS * 3600
    alerts = alerts.withColumn("__at", F.col("created_at").cast("timestamp"))
    keyed = (alerts.filter(F.col("key").isNotNull() & (F.unix_micros("__at") > _micros(now) - K.REALERT_HOURS * 3600 * 1_000_000))
             .select("source", "kind", "key").distinct().withColumn("__seen", F.lit(True)))
    last = alerts.groupBy("source", "kind").agg(F.max("__at").alias("__last"))
    healthy = runs.filter(F.col("status").isin("ok", "partial")).groupBy("source").agg(
        F.max(F.col("finished_at").cast("timestamp")).alias("__healthy"))
    joined = findings.join(keyed, ["source", "kind", "key"], "left").join(last, ["source", "kind"], "left").join(healthy, "source", "left")
    over = F.col("kind").isin(*K.INCIDENT_KINDS) & F.coalesce(F.col("__healthy") > F.col("__last"), F.lit(False))
    held = F.when(F.col("key").isNotNull(), F.col("__seen").isNotNull()).otherwise(
        F.coalesce(F.unix_seconds("__last") > recent, F.lit(False)) & ~over)
    return joined.filter(~held).select(*findings.columns)


def pending_alerts(alerts: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Alerts of the last day that no attempt has delivered, with fewer than 20 attempts: alerts(alert_id, created_at, ..),
    outcomes(alert_id, delivered)."""
    tried = outcomes.groupBy("alert_id").agg(F.count("*").alias("__attempts"), F.max("delivered").alias("__delivered"))
    young = _seconds(F.col("created_at")) > _seconds(now) - K.REALERT_HOURS * 3600
    left = (~F.coalesce("__delivered", F.lit(False))) & (F.coalesce("__attempts", F.lit(0)) < K.MAX_DELIVERY_ATTEMPTS)
    return alerts.join(tried, "alert_id", "left").filter(young & left).select(*alerts.columns)
