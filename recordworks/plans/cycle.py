"""One collection cycle: landed rows in, record table, quarantine, run verdicts and status out."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.core import moment
from ..operators import records as R
from ..operators import walk as W
from ..session import settled
from ..templates import Template
from .normalise import Context, accepted, normalise_records, quarantined

RECORD_META = ["uid", "source", "fingerprint", "first_seen", "last_seen", "run_id", "project"]


class Cycle(NamedTuple):
    records: DataFrame
    quarantine: DataFrame
    runs: DataFrame
    checked: DataFrame
    findings: DataFrame


def fresh_rows(events: DataFrame, max_rows: int) -> DataFrame:
    """events(run_id, source, page, rows ARRAY<JSON text>, ..) -> new rows of each walk in page order."""
    rows = events.select("run_id", "source", "page", F.posexplode("rows").alias("pos", "raw"))
    doc = F.try_parse_json("raw")
    key = W.row_key(F.try_variant_get(doc, "$.source_id", "string"), F.try_variant_get(doc, "$.url", "string"), F.coalesce(F.to_json(doc), F.col("raw")))  # keys sorted
    return W.dedup_walk(rows.withColumn("key", key), max_rows)


def verdicts(events: DataFrame, fresh: DataFrame, max_pages: int, max_rows: int) -> DataFrame:
    counts = fresh.groupBy("run_id", "page").agg(F.count("*").alias("fresh_count"))
    pages = events.select("run_id", "page", F.size("rows").alias("raw_count"), "error", "http_failed", "done")
    joined = pages.join(counts, ["run_id", "page"], "left").withColumn("fresh_count", F.coalesce("fresh_count", F.lit(0)))
    return W.walk_verdict(joined, max_pages, max_rows)


def run_cycle(events: DataFrame, target: DataFrame, sources: DataFrame, history: DataFrame, template: Template, ctx: Context, *,
              project: str, max_pages: int, max_rows: int, gazetteer: DataFrame | None = None, fx: DataFrame | None = None,
              now: Column | dt.datetime | None = None, prune_after_days: float = 30, capped: bool = False) -> Cycle:
    """events(run_id, source, page, rows, error, http_failed, done, started_at), sources(source, baseline, and `lane` if known),
    history = earlier runs; `capped`: the caller limited the number of pages.  Returns the new record snapshot, quarantine entries,
    finished runs with their status, the checked rows and what to alert about.

    Only what a walk has reached counts: rows of failed pages and of pages after the one it stopped at are left out."""
    at = moment(now)
    walked = settled(fresh_rows(events.filter("error IS NULL"), max_rows))
    walks = settled(verdicts(events, walked, max_pages, max_rows))
    reached = walks.select("run_id", F.col("pages").alias("__last"))
    fresh = walked.join(reached, "run_id").filter("page <= __last").drop("__last")
    checked = settled(normalise_records(fresh.drop("key"), template, ctx, gazetteer, fx))
    good = accepted(checked)
    seq = F.struct("page", "pos").alias("seq")
    batch = good.withColumns({"project": F.lit(project), "first_seen": at, "last_seen": at}).select(
        *[c for c in target.columns if c in [*good.columns, "project", "first_seen", "last_seen"]], seq)
    stored = settled(R.upsert(target, batch, at))
    quarantine = R.quarantine_rows(quarantined(checked).withColumn("project", F.lit(project)), at)
    counters = W.run_counters(checked.select("run_id", "page", (F.size("reasons") == 0).alias("stored")))
    seen = events.join(reached, "run_id").filter("page <= __last")
    started = seen.groupBy("run_id", "source").agg(F.min("started_at").alias("started_at"),
                                                   F.max_by("error", F.when(F.col("error").isNotNull(), F.col("page"))).alias("error"))
    known = [c for c in ("baseline", "lane") if c in sources.columns]
    runs = (walks.drop("pages").join(started, "run_id").join(counters, "run_id", "left")
            .join(sources.select("source", *known), "source", "left").join(W.recent_yield(history), "source", "left"))
    runs = runs.withColumns({"rows_stored": F.coalesce("rows_stored", F.lit(0)), "baseline": F.nullif("baseline", F.lit(0))})
    if "lane" in known:  # such a lane shows the first page only, so its walk never stands for the whole inventory
        first_only = F.coalesce(F.col("complete") & F.col("lane").isin(*K.FIRST_PAGE_LANES), F.lit(False))
        runs = runs.withColumns({"stopped": F.when(first_only, "page1_only").otherwise(F.col("stopped")), "complete": F.col("complete") & ~first_only}).drop("lane")
    unanswered = F.when((F.col("rows_stored") == 0) & (F.col("http_failures") > 0), F.concat(F.lit("no rows: "), "http_failures", F.lit(" request(s) failed")))
    reference = F.coalesce("baseline", "recent_yield", F.lit(0))
    runs = runs.withColumn("error", F.coalesce("error", unanswered)).withColumn("reference", reference)
    runs = settled(runs.withColumn("status", W.run_status(F.col("stopped"), F.col("rows_stored"), F.col("complete"), F.col("error"), F.col("reference"), capped)))
    findings = runs.filter("status = 'degraded'").select("source", F.lit("degraded").alias("kind"), F.format_string(
        "%d rows, under %d%% of the baseline %d", "rows_stored", F.lit(round(100 * K.DEGRADED_FRACTION)), F.col("reference").cast("bigint")).alias("message"))
    final = R.finalize(stored, runs.select("source", "run_id", "started_at", "complete", F.col("rows_stored").alias("stored"), "baseline"),
                       at, prune_after_days)
    return Cycle(final.records, quarantine, runs.drop("baseline", "reference").join(final.summary, "source", "left"), checked, findings)
