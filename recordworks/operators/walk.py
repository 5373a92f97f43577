"""Walks over the pages of a source: row dedup, completeness verdict, run counters and run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..session import settled
from .keyed import top_per_key

BLOCK = 10_000


def row_key(item_id: Column, url: Column, raw: Column) -> Column:
    """Identity of a row inside a walk: item id, link or the whole row."""
    return F.coalesce(F.nullif(item_id, F.lit("")), F.nullif(url, F.lit("")), raw)


def dedup_walk(rows: DataFrame, max_rows: int | None = None, key: str = "key") -> DataFrame:
    """rows(run_id, page, pos, key, ..): the first row per key in page order, at most `max_rows` per run.

    The cap is a running count per run.  It is taken in two levels (rows per block of a page, then a prefix sum over the
    blocks), so a run of any size is counted in parallel."""
    first = F.min_by(F.struct(*rows.columns), F.struct("page", "pos")).alias("row")
    fresh = rows.groupBy("run_id", key).agg(first).select("row.*")
    if max_rows is None:
        return fresh
    blocked = settled(fresh.withColumn("__block", F.floor(F.col("pos") / BLOCK)))  # the first rows are found once, and read for the sums and the cut
    sizes = blocked.groupBy("run_id", "page", "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("run_id").orderBy("page", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("run_id", "page", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("run_id", "page", "__block").orderBy("pos")
    return (blocked.join(starts.filter(F.col("__start") < max_rows), ["run_id", "page", "__block"])
            .withColumn("__at", F.col("__start") + F.row_number().over(inside))
            .filter(F.col("__at") <= max_rows).select(*rows.columns))


def walk_verdict(pages: DataFrame, max_pages: int, max_rows: int) -> DataFrame:
    """pages(run_id, page, raw_count, fresh_count, error, http_failed, done) -> one row per run: why the walk stopped,
    whether it is complete, and its totals up to the stopping page.  A run has at most `max_pages` pages here, which
    bounds its window."""
    window = Window.partitionBy("run_id").orderBy("page")
    so_far, earlier = window.rowsBetween(Window.unboundedPreceding, 0), window.rowsBetween(Window.unboundedPreceding, -1)
    failed = F.col("error").isNotNull()
    dry = (F.col("fresh_count") == 0) & (F.col("raw_count") > 0)
    staged = (pages.filter(F.col("page") <= max_pages)
              .withColumns({"__failed": failed, "__dry": F.when(~failed, dry)})
              .withColumns({"__errors": F.sum(F.col("__failed").cast("int")).over(so_far),
                            "__rows": F.sum(F.when(~F.col("__failed"), F.col("fresh_count")).otherwise(0)).over(so_far),
                            "__was_dry": F.last("__dry", ignorenulls=True).over(earlier)}))
    stop = (F.when(F.col("__failed"), F.when(F.col("__errors") >= K.MAX_PAGE_ERRORS, "errors"))
            .when(F.col("done"), "done")
            .when(F.col("raw_count") == 0, F.when(F.col("http_failed"), "fetch_failed").otherwise("empty_page"))
            .when(F.col("__dry") & F.coalesce("__was_dry", F.lit(False)), "repeating")
            .when(F.col("__rows") >= max_rows, "max_rows"))
    marked = staged.withColumn("__stop", stop).withColumn(
        "__stopped_before", F.coalesce(F.max(F.col("__stop").isNotNull()).over(earlier), F.lit(False)))
    totals = marked.filter(~F.col("__stopped_before")).groupBy("run_id").agg(
        F.coalesce(F.max("__stop"), F.lit("max_pages")).alias("stopped"),
        F.max("page").alias("pages"),
        F.least(F.max("__rows"), F.lit(max_rows).cast("bigint")).alias("rows"),
        F.count_if("__failed").alias("page_errors"),
        F.count_if("http_failed").alias("http_failures"))
    complete = F.col("stopped").isin("done", "empty_page", "repeating") & (F.col("page_errors") == 0) & (F.col("http_failures") == 0)
    return totals.withColumn("complete", complete)


def run_counters(rows: DataFrame) -> DataFrame:
    """rows(run_id, page, stored BOOLEAN) -> pages, fetched, stored and quarantined per run."""
    return rows.groupBy("run_id").agg(F.max("page").alias("pages"), F.count("*").alias("rows_fetched"),
                                      F.count_if("stored").alias("rows_stored"), F.count_if(~F.col("stored")).alias("rows_quarantined"))


def recent_yield(runs: DataFrame, n: int = K.RECENT_YIELD_RUNS) -> DataFrame:
    """Upper median of the rows stored by the last `n` healthy runs of each source."""
    healthy = runs.filter(F.col("status").isin("ok", "partial") & (F.col("rows_stored") > 0))
    last = top_per_key(healthy, ["source"], [F.col("started_at").desc(), F.col("run_id").desc()], n)
    stored = F.sort_array(F.collect_list("rows_stored"))
    middle = F.get(stored, F.floor(F.size(stored) / 2).cast("int"))
    return last.groupBy("source").agg(middle.alias("recent_yield"))


def run_status(stopped: Column, stored: Column, complete: Column, error: Column, baseline: Column,
               capped: Column | bool = False) -> Column:
    """Status of a finished run; the order of the rules matters.  `capped`: the caller limited the number of pages."""
    capped = F.lit(capped) if isinstance(capped, bool) else capped
    low = ((baseline >= K.MIN_BASELINE_FOR_DEGRADED) & (stored < K.DEGRADED_FRACTION * baseline)
           & ~(capped & (stopped == "max_pages")))
    return (F.when(stopped.isin(*K.FAILED_STOPS), "error")
            .when((stopped == "time_budget") & (stored == 0), "timeout")
            .when((stored == 0) & error.isNotNull(), "error")
            .when(stored == 0, "empty")
            .when(F.coalesce(low, F.lit(False)), "degraded")
            .when(complete, "ok").otherwise("partial"))


def fetch_outcomes(log: DataFrame) -> DataFrame:
    """log(host, outcome) -> counts per host and outcome class; any failure makes a walk incomplete."""
    kinds = ["ok", "error", "blocked", "gated"]
    counts = [F.count_if(F.col("outcome") == k).alias(k) for k in kinds]
    failures = F.count_if(F.col("outcome").isin("error", "blocked", "gated")).alias("failures")
    return log.groupBy("host").agg(F.count("*").alias("requests"), *counts, failures)


def usage_rollup(requests: DataFrame) -> DataFrame:
    """requests(source, ts, bytes) -> daily counters per source."""
    return requests.groupBy(F.to_date("ts").alias("day"), "source").agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"))


def usage_remaining(usage: DataFrame, daily_requests: int, daily_bytes: float) -> DataFrame:
    """What is left of the daily budget, never below zero."""
    used = usage.groupBy("day").agg(F.sum("requests").alias("used_requests"), F.sum("bytes").alias("used_bytes"))
    return used.withColumns({"requests_left": F.greatest(F.lit(0), F.lit(daily_requests) - F.col("used_requests")),
                             "bytes_left": F.greatest(F.lit(0), F.lit(daily_bytes) - F.col("used_bytes"))})
