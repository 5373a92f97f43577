"""Record table maintenance: upsert, never-wipe finalise, pruning, quarantine, counters, retention.

Tables are snapshots.  Every function is DataFrame -> DataFrame; `write_partitions` replaces only the partitions a batch
touched.  Keys are spread by hash, so no step gathers a source or a run in one task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..session import Scratch
from .keyed import latest_per_key, top_per_key

RECORD_KEY = ["project", "uid"]


def upsert(target: DataFrame, batch: DataFrame, now: Column, key: list[str] | None = None, order: str = "seq") -> DataFrame:
    """Insert or replace by key.  `first_seen` survives, everything else comes from the batch; the last row of the batch
    per key (by `order`) wins."""
    key = key or RECORD_KEY
    newest = latest_per_key(batch, key, [F.col(order)]).drop(order).withColumn("__in_batch", F.lit(True))
    old = target.select(*key, *[F.col(c).alias(f"__old_{c}") for c in target.columns if c not in key])
    joined = old.join(newest, key, "full_outer")
    fresh = F.col("__in_batch").isNotNull()
    kept = []
    for name in target.columns:
        before = F.col(f"__old_{name}") if name not in key else None
        if name in key:
            kept.append(F.col(name))
        elif name == "first_seen":
            kept.append(F.coalesce(before, now).alias(name))
        elif name == "last_seen":
            kept.append(F.when(fresh, now).otherwise(before).alias(name))
        elif name in newest.columns:
            kept.append(F.when(fresh, F.col(name)).otherwise(before).alias(name))
        else:
            kept.append(before.alias(name))
    return joined.select(*kept)


class Finalised(NamedTuple):
    records: DataFrame
    summary: DataFrame


MAX_VERDICTS = 1_000_000  # rows of a verdict table (a few dozen bytes each) that may be broadcast; more are joined by shuffle


def _per_source(target: DataFrame, verdicts: DataFrame) -> DataFrame:
    """`target` beside the row of its source in a written table of one row a source.  Its rows are counted, not estimated: up to MAX_VERDICTS of them
    are broadcast, so that records don't move; beyond that the join shuffles and AQE splits hot sources."""
    small = verdicts.limit(MAX_VERDICTS + 1).count() <= MAX_VERDICTS
    return target.join(F.broadcast(verdicts) if small else verdicts, "source", "left")


def finalize(target: DataFrame, runs: DataFrame, now: Column, prune_after_days: float) -> Finalised:
    """The never-wipe rule for finished runs, at most one per source: runs(source, run_id, started_at, complete, stored,
    baseline).  A complete walk that stored at least 60 % of the baseline removes rows of other runs last seen before it
    started; any other walk only removes rows unseen for `prune_after_days`.  A missing baseline is the number of rows
    that other runs left: only such sources' records are read for it.

    Verdicts are a written table; the records are judged in one scan, whose result serves the new table and the counts."""
    scratch = Scratch(target.sparkSession)
    sized = scratch.keep(runs.select("source", F.col("run_id").alias("__run"), F.col("started_at").alias("__started"), "complete", "stored",
                                     F.nullif("baseline", F.lit(0)).alias("__baseline")))
    unknown = sized.filter("__baseline IS NULL").select("source", "__run")
    others = _per_source(target.select("source", "run_id"), unknown).filter(F.col("__run").isNotNull()).groupBy("source").agg(
        F.count_if(F.col("run_id") != F.col("__run")).alias("__others"))
    verdicts = sized.join(others, "source", "left").select(
        "source", "__run", "__started", "stored", "complete", F.coalesce("__baseline", "__others", F.lit(0)).alias("__base"))
    replaces = F.col("complete") & (F.col("stored") > 0) & (F.col("stored") >= K.REPLACE_MIN_FRACTION * F.col("__base"))
    verdicts = scratch.keep(verdicts.withColumn("__replace", F.coalesce(replaces, F.lit(False))))
    cutoff = F.timestamp_micros((F.unix_micros(now) - F.lit(int(prune_after_days * 86400 * 1000000))).cast("bigint"))
    seen = F.col("last_seen").cast("timestamp")
    gone = F.coalesce(F.when(F.col("__replace"), (F.col("run_id") != F.col("__run")) & (seen < F.col("__started").cast("timestamp")))
                      .when(F.col("__run").isNotNull(), seen < cutoff), F.lit(False))
    judged = scratch.keep(_per_source(target, verdicts.select("source", "__run", "__started", "__replace")).select(*target.columns, gone.alias("__gone")))
    pruned = judged.filter("__gone").groupBy("source").agg(F.count(F.lit(1)).alias("pruned"))
    summary = verdicts.join(pruned, "source", "left").select(
        "source", F.when(F.col("__replace"), "replace").otherwise("upsert").alias("write_mode"),
        F.coalesce("pruned", F.lit(0)).alias("pruned"),
        F.when(F.col("__replace"), F.col("stored")).otherwise(F.nullif("__base", F.lit(0))).alias("baseline"))
    return Finalised(judged.filter(~F.col("__gone")).select(*target.columns), summary)


def prune(target: DataFrame, cutoff: Column) -> DataFrame:
    """Rows seen at or after the cutoff."""
    return target.filter(F.col("last_seen") >= cutoff)


def quarantine_rows(rejected: DataFrame, now: Column) -> DataFrame:
    """rejected(project, source, run_id, reasons ARRAY, raw) as quarantine rows, whole, under a hash of their content."""
    blob = F.col("raw")
    why = F.to_json("reasons")
    digest = F.sha2(F.concat_ws("\x1f", "project", F.coalesce("source", F.lit("")), why, blob), 256)
    return rejected.select(F.concat(F.lit("q"), F.substring(digest, 1, 24)).alias("qid"), "project", "source", "run_id", "reasons",
                           blob.alias("raw"), now.alias("created_at"))


def upsert_quarantine(target: DataFrame, batch: DataFrame) -> DataFrame:
    """One entry per id: a repeat only refreshes run and time (the other columns are part of the id)."""
    both = target.unionByName(batch)
    latest = F.max_by(F.struct("run_id", "created_at"), F.struct("created_at", "run_id"))
    rest = [F.any_value(c).alias(c) for c in ("project", "source", "reasons", "raw")]
    return both.groupBy("qid").agg(*rest, latest.alias("last")).select("qid", "project", "source", "last.run_id", "reasons", "raw",
                                                                       "last.created_at")


def merge_counters(target: DataFrame, increments: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Existing counters plus increments."""
    both = target.select(*keys, *counters).unionByName(increments.select(*keys, *counters))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def retain(table: DataFrame, column: str, before: Column, keep_status: list[str] | None = None) -> DataFrame:
    """History rows from `before` on; rows in one of `keep_status` stay whatever their age."""
    keep = F.col(column) >= before
    return table.filter(keep | F.col("status").isin(*keep_status) if keep_status else keep)


def union_sources(*outputs: DataFrame) -> DataFrame:
    """Outputs of several sources as one table; columns one of them lacks become NULL."""
    first, *rest = outputs
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def merge_evidence(evidence: DataFrame, keep: int | None = None) -> DataFrame:
    """evidence(site, seq, url, observation, ..): first occurrence per link in order, all of a site or its last `keep`."""
    first = F.min_by(F.struct(*evidence.columns), F.col("seq")).alias("row")
    unique = evidence.groupBy("site", "url").agg(first).select("row.*")
    tail = unique if keep is None else top_per_key(unique, ["site"], [F.col("seq").desc()], keep)
    entry = F.struct("seq", *[c for c in evidence.columns if c not in ("site", "seq")])
    return tail.groupBy("site").agg(F.sort_array(F.collect_list(entry)).alias("evidence"))


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions present in `df` (dynamic partition overwrite)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))
