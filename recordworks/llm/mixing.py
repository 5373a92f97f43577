"""Mixing sources to target weights.

Tokens are summed per source, each source's target gives a repetition rate, and each document is emitted floor(rate) times plus
one more time when a number hashed from its id is below the rate's fraction.  Reruns agree because nothing is drawn.

Targets: the sources in code point order (null last) weigh `weights` in turn and share `share` times all tokens.  A target stops at
`cap` times its source's tokens; what is above is shared again by weight until nothing is above.  As the share grows with
one multiplier for all sources, that is the multiplier at which min(cap * size, multiplier * weight) adds up to the total.

Defined results: null text has no tokens; a source without tokens gets target 0 and its documents are emitted no time.  A document
with a null id is hashed by its text.  Rows that repeat an id share one number.  An empty table gives an empty result.
Other columns are carried; one with the name of a result column gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordworks.session import settled

from .base import WORD, packed, unpacked, whole

WEIGHTS = (5.0, 2.0, 1.0)
BROADCAST_SOURCES = 50_000  # rows of (name, target); more sources than that are joined by shuffle
RESULTS = ["size", "source_size", "target", "copies", "taken"]


def size_of(text: str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """`place` 0, 1, ... in code point order of `src`, null last, without bringing all sources to one task: ranges are numbered
    inside and offset by the counts of the ranges before."""
    partitions = sources.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = settled(sources.repartitionByRange(int(partitions), F.col("src").asc_nulls_last())
                     .withColumn("part", F.spark_partition_id()))
    counts = [(r["part"], r["count"]) for r in ranged.groupBy("part").count().orderBy("part").collect()]  # one row a partition
    offset, seen = F.lit(0).cast("long"), 0
    for part, count in counts:
        offset = F.when(F.col("part") == part, F.lit(seen)).otherwise(offset)
        seen += count
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("src").asc_nulls_last()))
    return ranged.withColumn("place", within - 1 + offset).drop("part")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources(src, source_size) -> the same with `target`."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    table = settled(_numbered(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * cap))
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # each turn settles at least one more source at its cap; few turns in practice
        capped = F.col("most") <= F.col("weight") * level
        row = table.agg(F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not row[1]:
            break
        higher = (total - (row[0] or 0.0)) / row[1]
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return table.select("src", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def _unit(seed: int, doc_id: str, text: str) -> Column:
    """A number in [0, 1) hashed from the seed and the document."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.sha2(whole(text), 256))
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 12), 16, 10).cast("double") / float(16**12)


def mixed_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: list[str] | None = None,
                 seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Each row with its size, its source's size and target, and how often (`copies`) and how many tokens (`taken`) the mix takes."""
    sized = docs.select(packed(docs, carry).alias("row"), F.col(source).alias("src"), size_of(text).alias("size"), _unit(seed, doc_id, text).alias("unit"))
    sums = docs.select(F.col(source).alias("src"), size_of(text).alias("size")).groupBy("src").agg(F.sum("size").alias("source_size"))
    goal = settled(targets(sums, weights, share, cap))
    few = goal.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    goal = goal.withColumnRenamed("src", "goal_src")
    joined = sized.join(F.broadcast(goal) if few else goal.hint("merge"), sized["src"].eqNullSafe(goal["goal_src"]), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (F.col("unit") < rate - F.floor(rate)).cast("long")
    out = joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return unpacked(out, "row", docs.columns if carry is None else carry, RESULTS)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as the mix takes it, with its own columns."""
    names = docs.columns
    counted = mixed_counts(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *[F.col(f"`{c}`") for c in ("doc_id", "text", "source")]),
                           carry=["row"], **options)
    emitted = counted.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return emitted.select("row.*")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(sha256('7:' || doc_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS unit FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight
    FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS most, sum(2.0::DOUBLE * source_size) OVER w AS capped, sum(weight) OVER () - sum(weight) OVER w AS rest,
    lead(2.0::DOUBLE * source_size / weight) OVER (ORDER BY 2.0 * source_size / weight, source) AS following,
    1.5::DOUBLE * sum(source_size) OVER () AS total
    FROM s WINDOW w AS (ORDER BY 2.0 * source_size / weight, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT coalesce(min(CASE WHEN rest > 0 AND (total - capped) / rest < following AND (total - capped) / rest >= most / weight THEN (total - capped) / rest END), 0) AS later,
    max(total) AS total, (SELECT sum(weight) FROM s) AS weights, (SELECT min(2.0 * source_size / weight) FROM s) AS first_cap FROM r),
t AS (SELECT s.source, source_size, least(2.0 * source_size, weight * CASE WHEN total / weights < first_cap THEN total / weights ELSE later END)::DOUBLE AS target
    FROM s, l)
SELECT d.doc_id, d.size, t.source_size, t.target, (d.size * c.copies)::BIGINT AS taken FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source,
  LATERAL (SELECT CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate) q,
  LATERAL (SELECT floor(q.rate) + CASE WHEN d.unit < q.rate - floor(q.rate) THEN 1 ELSE 0 END AS copies) c"""
