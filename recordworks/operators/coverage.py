"""Coverage of regions and angles, candidate admission and merging."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.core import moment
from ..functions.sites import SuffixRules, host_of, site_key, slug
from ..session import settled
from .keyed import first_per_key
from .lookups import expand_regions
from .records import merge_evidence

ANGLES = K.ANGLES


def _grid(spark: SparkSession, regions: list[str], angles: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, regions))).alias("region")).select(
        "region", F.explode(F.array(*map(F.lit, angles))).alias("angle"))


def coverage_matrix(sources: DataFrame, regions: list[str], angles: list[str] | None = None) -> DataFrame:
    """sources(status, regions ARRAY, angles ARRAY) -> region, angle, sources, with zero rows.  Rejected sources do not
    count, blocked ones do: the site exists."""
    angles = angles or ANGLES
    live = sources.filter(F.coalesce("status", F.lit("")) != "rejected")
    cells = (live.select(F.explode("regions").alias("region"), "angles").select("region", F.explode("angles").alias("angle"))
             .filter(F.col("region").isin(*regions) & F.col("angle").isin(*angles)).withColumn("n", F.lit(1)))
    return (cells.unionByName(_grid(sources.sparkSession, regions, angles).withColumn("n", F.lit(0)))
            .groupBy("region", "angle").agg(F.sum("n").alias("sources")))


def coverage_wide(matrix: DataFrame, angles: list[str] | None = None) -> DataFrame:
    """One row per region, one column per angle."""
    return matrix.groupBy("region").pivot("angle", angles or ANGLES).agg(F.sum("sources"))


def coverage_gaps(matrix: DataFrame) -> DataFrame:
    return matrix.filter("sources = 0").select("region", "angle")


def angles_per_region(matrix: DataFrame) -> DataFrame:
    """Covered and open angles per region."""
    covered = F.sort_array(F.collect_list(F.when(F.col("sources") > 0, F.col("angle"))))
    todo = F.sort_array(F.collect_list(F.when(F.col("sources") == 0, F.col("angle"))))
    return matrix.groupBy("region").agg(covered.alias("covered"), todo.alias("todo"))


def dry_streak(rounds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """rounds(.., seq BIGINT, added): trailing rounds that added nothing, per key, or one row for all without keys.

    The last productive round of each key, then the dry rounds behind it are counted.  Both combine before the shuffle, and a task holds two
    numbers for each of its keys, however their round numbers are spread."""
    names = keys or []
    fruitful = F.coalesce(F.col("added") > 0, F.lit(False))
    marked = rounds.select(*names, F.col("seq").cast("bigint").alias("__seq"), fruitful.alias("__fruitful"))
    last = marked.groupBy(*names).agg(F.max(F.when(F.col("__fruitful"), F.col("__seq"))).alias("__last"))
    dry = marked.filter(~F.col("__fruitful")).select(*names, "__seq")

    def beside(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        if not names:
            return left.crossJoin(F.broadcast(right))  # one row
        other = right.select(*[F.col(n).alias(f"__{n}") for n in names], *[c for c in right.columns if c not in names])
        same = [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names]
        return left.join(other, same, how).drop(*[f"__{n}" for n in names])

    behind = beside(dry, last, "inner").filter(F.col("__last").isNull() | (F.col("__seq") > F.col("__last")))
    counts = behind.groupBy(*names).agg(F.count("__seq").alias("__n"))
    return beside(last, counts, "left").select(*names, F.coalesce("__n", F.lit(0)).alias("dry_streak"))


def coverage_verdict(sources: DataFrame, rounds: DataFrame, matrix: DataFrame, max_sources: int) -> DataFrame:
    """One row: sources, empty_cells, dry_streak, budget_reached, saturated.  Each table is read once and reduced in its own tasks first."""
    counted = sources.filter(~F.coalesce("status", F.lit("")).isin(*K.OFF_BUDGET_STATUS))
    facts = (counted.agg(F.count("*").alias("v")).withColumn("name", F.lit("sources"))
             .unionByName(matrix.agg(F.count_if(F.col("sources") == 0).alias("v")).withColumn("name", F.lit("empty_cells")))
             .unionByName(dry_streak(rounds).select(F.col("dry_streak").alias("v")).withColumn("name", F.lit("dry_streak"))))
    row = facts.agg(*[F.coalesce(F.max(F.when(F.col("name") == n, F.col("v"))), F.lit(0)).alias(n)
                      for n in ("sources", "empty_cells", "dry_streak")])
    reached = F.col("sources") >= max_sources
    return row.withColumns({"budget_reached": reached,
                            "saturated": (F.col("dry_streak") >= K.DRY_ROUNDS) & (F.col("empty_cells") == 0) & ~reached})


def known_sites(sources: DataFrame) -> DataFrame:
    return sources.select("site").distinct().orderBy("site")


RANGES = 1024  # counts that come to the driver in one round


def _cut(rows: DataFrame, order: list[str], k: int) -> Column:
    """A condition that holds for exactly the first k of `rows` by whole numbers `order` (for more than k only where rows agree in all of them).

    Nothing is sorted: counts in RANGES ranges between the least and the greatest value tell in which range the cut falls, and that range is
    divided again, until it is one value; then the next number divides the rows of that value.  A round is an aggregate of RANGES rows at most."""
    below, same = F.lit(False), F.lit(True)
    for name in order:
        if k <= 0:
            break
        value, part = F.col(name), rows.filter(same)
        low, high, n = part.agg(F.min(name), F.max(name), F.count(name)).first()
        if n <= k:
            return below | same  # all of them, an empty table included
        while low < high:
            width = -(-(high - low + 1) // RANGES)
            counts = {r["r"]: r["n"] for r in part.filter(value.between(low, high)).groupBy(
                F.floor((value.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int").alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()}
            before, at = 0, 0
            for at in sorted(counts):
                if before + counts[at] > k:
                    break
                before += counts[at]
            below, k = below | (same & value.between(low, low + at * width - 1)), k - before
            low, high = low + at * width, min(high, low + (at + 1) * width - 1)
        same = same & (value == low)
    return below if k <= 0 else below | same


def admit(candidates: DataFrame, live: int, max_sources: int, recorded_blocked: int = 0) -> DataFrame:
    """candidates(site, arrival, blocked) -> decision: `added` in arrival order until the budget is used, `blocked` outside
    the budget up to three times it, the rest `deferred` or `rejected`.  Sites of the same arrival are taken by a hash of their names.

    The place where the budget ends is found by counting (`_cut`), so a budget of any size needs no sort and no join, and every row is
    decided where it is."""
    blocked = F.coalesce(F.col("blocked"), F.lit(False))
    room, room_blocked = max(0, max_sources - live), max(0, K.BLOCKED_FACTOR * max_sources - recorded_blocked)
    keyed = candidates.withColumns({"__at": F.col("arrival").cast("bigint"), "__tie": F.xxhash64("site")})
    fits, fits_blocked = (_cut(keyed.filter(kind), ["__at", "__tie"], n) if n else F.lit(False) for kind, n in ((~blocked, room), (blocked, room_blocked)))
    decision = F.when(blocked, F.when(fits_blocked, "blocked").otherwise("rejected")).otherwise(F.when(fits, "added").otherwise("deferred"))
    return keyed.withColumn("decision", decision).drop("__at", "__tie")


def clean_evidence(evidence: Column, site: Column, now: Column, suffixes: SuffixRules | None = None) -> Column:
    """array<struct<url, observation, seen_at, on_domain>>: entries without an address go, a missing time is `now`, and each entry tells whether
    it lies on the candidate's own site."""
    given = F.filter(evidence, lambda e: F.coalesce(e["url"], F.lit("")) != "")
    return F.transform(given, lambda e: F.struct(e["url"].alias("url"), F.coalesce(e["observation"], F.lit("")).alias("observation"),
                                                 F.coalesce(F.nullif(e["seen_at"], F.lit("")), now.cast("string")).alias("seen_at"), (site_key(e["url"], suffixes) == site).alias("on_domain")))


def _with_seen_at(df: DataFrame) -> DataFrame:
    """Evidence whose entries have no time yet gets an empty one."""
    entry = df.schema["evidence"].dataType.elementType
    if "seen_at" in entry.names:
        return df
    return df.withColumn("evidence", F.transform("evidence", lambda e: F.struct(e["url"].alias("url"), e["observation"].alias("observation"), F.lit(None).cast("string").alias("seen_at"))))


def candidate_reasons(candidates: DataFrame, project_regions: list[str], suffixes: SuffixRules | None = None, now: Column | dt.datetime | None = None) -> DataFrame:
    """Candidates with their site key, region codes, clean evidence and the first rule they break (NULL when none).  A candidate that states no
    region or angle gets the project's regions and the usual angle."""
    site = site_key(F.col("url"), suffixes)

    def given(name: str, default: list[str]) -> Column:
        return F.when(F.size(F.coalesce(name, F.array().cast("array<string>"))) > 0, F.col(name)).otherwise(F.array(*map(F.lit, default)).cast("array<string>"))

    stated = {"url": F.trim(F.col("url")), "site": site, "regions": given("regions", project_regions), "angles": given("angles", [K.DEFAULT_ANGLE])}
    df = expand_regions(_with_seen_at(candidates).withColumns(stated), "regions", "codes")
    df = df.withColumn("evidence", clean_evidence(F.col("evidence"), F.col("site"), moment(now), suffixes))
    own = F.exists("evidence", lambda e: e["on_domain"] & (e["observation"] != ""))
    angles = F.array(*map(F.lit, ANGLES))
    project = F.array(*map(F.lit, [*project_regions, K.GLOBAL]))
    reason = (F.when(~F.col("url").rlike("^https?://"), "url must start with http:// or https://")
              .when((F.col("site") == "") | ~F.col("site").rlike("[.:]"), "url has no registrable domain")
              .when(F.col("mirror_of").isNotNull(), "mirrors are never collected")
              .when(F.size("codes_unknown") > 0, "unknown region")
              .when(~F.arrays_overlap("codes", project), "regions are outside the project")
              .when(F.size(F.array_except("angles", angles)) > 0, "unknown angle")
              .when(~F.coalesce(own, F.lit(False)), "evidence must include a URL on the site's own domain with an observation"))
    return df.withColumn("reason", F.coalesce(F.when(F.col("url").isNull(), F.lit("url must start with http:// or https://")), reason))


EVIDENCE = "array<struct<url:string,observation:string,seen_at:string,on_domain:boolean>>"


def _full_evidence(registry: DataFrame) -> DataFrame:
    """A registry whose evidence may lack the times and the flags of its entries."""
    have = registry.schema["evidence"].dataType.elementType.names
    if {"seen_at", "on_domain"} <= set(have):
        return registry
    return registry.withColumn("evidence", F.transform("evidence", lambda e: F.struct(
        e["url"].alias("url"), e["observation"].alias("observation"), (e["seen_at"] if "seen_at" in have else F.lit(None)).cast("string").alias("seen_at"),
        (site_key(e["url"]) == F.col("site")).alias("on_domain"))))


class Merged(NamedTuple):
    registry: DataFrame
    deferred: DataFrame
    rejected: DataFrame
    counts: DataFrame


def _ordered_union(items: DataFrame, name: str) -> DataFrame:
    """items(site, at, name ARRAY) -> distinct values per site in order of first appearance."""
    single = items.select("site", "at", F.posexplode(name).alias("pos", "value"))
    first = single.groupBy("site", "value").agg(F.min(F.struct("at", "pos")).alias("first"))
    ordered = F.sort_array(F.collect_list(F.struct("first", "value")))
    return first.groupBy("site").agg(F.transform(ordered, lambda x: x["value"]).alias(name))


def merge_candidates(registry: DataFrame, candidates: DataFrame, project_regions: list[str], max_sources: int,
                     suffixes: SuffixRules | None = None, now: Column | dt.datetime | None = None) -> Merged:
    """Candidates into the registry: known sites gain regions, angles and evidence, new sites are admitted by budget.

    registry(id, site, url, status, regions, angles, evidence ARRAY<STRUCT<url, observation, seen_at, on_domain>>),
    candidates(arrival, url, regions, angles, evidence ARRAY<STRUCT<url, observation[, seen_at]>>, blocked, mirror_of)."""
    # the checked candidates feed every output below, so they are computed once
    checked = settled(candidate_reasons(candidates, project_regions, suffixes, now).select(
        "arrival", "url", "site", "codes", "angles", "evidence", "blocked", "reason"))
    rejected = checked.filter("reason IS NOT NULL").select("arrival", "url", "reason")
    fine = checked.filter("reason IS NULL").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    known = registry.select("site", "id", F.lit(True).alias("known"))
    first = first_per_key(fine, ["site"], [F.col("arrival")]).join(known, "site", "left")
    budget = registry.agg(F.count_if(~F.coalesce("status", F.lit("")).isin(*K.OFF_BUDGET_STATUS)).alias("live"),
                          F.count_if(F.col("status") == "blocked").alias("blocked")).first()
    decided = admit(first.filter("known IS NULL"), budget["live"], max_sources, budget["blocked"]).select("site", "decision")
    placed = fine.join(known.drop("id"), "site", "left").join(decided, "site", "left").withColumn(
        "decision", F.when(F.col("known"), F.lit("merged")).otherwise(F.col("decision")))
    entering = placed.filter(F.col("decision").isin("merged", "added", "blocked"))
    before = _full_evidence(registry).select("site", F.lit(-1).cast("bigint").alias("at"), "regions", "angles", "evidence")
    after = entering.select("site", F.col("arrival").cast("bigint").alias("at"), F.col("codes").alias("regions"), "angles", "evidence")
    both = before.unionByName(after)
    proof = both.select("site", "at", F.posexplode("evidence").alias("pos", "e")).select(
        "site", F.struct("at", "pos").alias("seq"), F.col("e.url").alias("url"),
        F.struct(F.coalesce("e.observation", F.lit("")).alias("observation"), "e.seen_at", "e.on_domain").alias("observation"))
    evidence = merge_evidence(proof.filter("url IS NOT NULL")).select("site", F.transform(
        "evidence", lambda e: F.struct(e["url"].alias("url"), e["observation"]["observation"].alias("observation"), e["observation"]["seen_at"].alias("seen_at"),
                                       e["observation"]["on_domain"].alias("on_domain"))).alias("evidence"))
    new = first.filter("known IS NULL").join(decided.filter(F.col("decision").isin("added", "blocked")), "site").select(
        "site", F.lit(None).cast("string").alias("id"), "url", F.when(F.col("decision") == "blocked", "blocked").otherwise("candidate").alias("status"))
    base = registry.select("site", "id", "url", "status").unionByName(new)
    out = base.join(_ordered_union(both, "regions"), "site", "left").join(_ordered_union(both, "angles"), "site", "left").join(evidence, "site", "left")
    none = F.array().cast(EVIDENCE)
    out = with_slugs(out).select("id", "site", "url", "status", "regions", "angles", F.coalesce("evidence", none).alias("evidence"))
    deferred = first_per_key(placed.filter(F.col("decision") == "deferred"), ["site"], [F.col("arrival")]).select(
        "site", "url", F.col("codes").alias("regions"), "angles", "evidence", "blocked", "arrival")
    is_first = F.col("arrival") == F.col("__first")
    added = F.col("decision").isin("added", "blocked") & is_first
    merged = (F.col("decision") == "merged") | (F.col("decision").isin("added", "blocked") & ~is_first)
    firsts = fine.groupBy("site").agg(F.min("arrival").alias("__first"))
    tally = placed.join(firsts, "site").agg(F.count_if(added).alias("added"), F.count_if(merged).alias("merged"),
                                            F.count_if(~added & ~merged).alias("rejected"))
    broken = rejected.agg(F.count("*").alias("rejected")).select(F.lit(0).alias("added"), F.lit(0).alias("merged"), "rejected")
    counts = tally.unionByName(broken).agg(*[F.sum(c).alias(c) for c in ("added", "merged", "rejected")])
    over = placed.filter(F.col("decision").isin("deferred", "rejected")).select(
        "arrival", "url", F.when(F.col("decision") == "deferred", F.lit("max_sources reached; deferred"))
        .otherwise(F.lit("too many blocked sources recorded")).alias("reason"))
    return Merged(out, deferred, rejected.unionByName(over), counts)


def with_slugs(registry: DataFrame) -> DataFrame:
    """Ids for rows without one: the slug of the site, or with the least free of _2, _3 .. when it is taken.  An id or slug like foo_2 takes the
    number 2 of foo."""
    base = registry.withColumn("__slug", slug(F.col("site")))
    names = base.select(F.coalesce("id", "__slug").alias("name"), F.col("id").isNotNull().alias("fixed"))
    number = F.regexp_extract("name", r"_(\d{1,9})$", 1)
    taken = names.filter("fixed").select(F.col("name").alias("__slug"), F.lit(1).alias("n")).unionByName(
        names.filter(number != "").select(F.regexp_replace("name", r"_\d+$", "").alias("__slug"), number.cast("int").alias("n")))
    taken = taken.groupBy("__slug").agg(F.collect_set("n").alias("__taken"))
    new = base.filter("id IS NULL").withColumn("__k", F.row_number().over(Window.partitionBy("__slug").orderBy("site"))).join(taken, "__slug", "left")
    used = F.coalesce("__taken", F.array().cast("array<int>"))
    n = F.get(F.array_except(F.sequence(F.lit(1), F.col("__k") + F.size(used)), used), F.col("__k") - 1)
    named = new.withColumn("id", F.when(n == 1, F.col("__slug")).otherwise(F.concat_ws("_", "__slug", n.cast("string"))))
    return base.filter("id IS NOT NULL").select(*registry.columns).unionByName(named.select(*registry.columns))


def defer(deferred: DataFrame, batch: DataFrame) -> DataFrame:
    """Deferred candidates with new ones added; a site is kept once."""
    fresh = batch.join(deferred.select("site"), "site", "left_anti")
    return deferred.unionByName(fresh, allowMissingColumns=True)


def readmit(deferred: DataFrame, registry: DataFrame) -> DataFrame:
    """Deferred candidates that are still unknown to the registry: the input of the next, larger budget."""
    return deferred.join(registry.select("site"), "site", "left_anti")


def site_name(url: Column) -> Column:
    return host_of(url)

