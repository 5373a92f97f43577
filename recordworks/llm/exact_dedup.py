"""Exact deduplication: a two-pass Bloom filter finds the hashes that may be repeated, and only their rows are shuffled.

Pass 1 reads one 64-bit hash per row.  A hash has `PROBES` cells in one 4 KB block of a blocked Bloom filter; a cell that two or
more rows touch is set.  Counting cells is a partial aggregation of small integers.  The filter has `bits_per_row` bits for each
row up to `max_filter_mb`, so the broadcast has a fixed bound; beyond it more rows are shuffled and the result is the same.
Pass 2 reads the rows again: a row with an unset cell is the only one of its text and passes straight through; the others
are grouped by the SHA-256 of their text.

Defined results: null text counts as empty text.  Empty tables give empty results.  A null id sorts after all others.  Rows that
repeat both an id and its text count separately in `group_size`, and only one of them is kept.  Other columns are carried; one
with the name of a result column gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordworks.session import settled

from .base import BLOCK_BITS, SPACES, bit_of, packed, unpacked, whole

PROBES = 2
RESULTS = ["keep_id", "group_size", "kept", "text_sha256"]


def _cells(h: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(h, F.lit(j)), F.lit(BLOCK_BITS)) for j in range(PROBES)]


def repeated_filter(hashes: DataFrame, rows: int, bits_per_row: int, max_filter_mb: int) -> tuple[DataFrame, int]:
    """hashes(h) -> (the filter as rows of block and bitmap, its number of blocks)."""
    blocks = max(1, min(max_filter_mb * 256, -(-rows * bits_per_row // BLOCK_BITS)))
    cells = hashes.select(F.pmod("h", F.lit(blocks)).alias("block"), F.explode(F.array_distinct(F.array(*_cells(F.col("h"))))).alias("cell"))
    twice = cells.groupBy("block", "cell").count().filter("count >= 2")
    return settled(twice.groupBy("block").agg(F.expr("bitmap_construct_agg(cell)").alias("bitmap"))), blocks


def _probed(docs: DataFrame, doc_id: str, text: str, carry: list[str] | None, bits_per_row: int, max_filter_mb: int) -> DataFrame:
    """row, id, sha and `hit`: whether another row may have the same text."""
    keyed = docs.select(packed(docs, carry).alias("row"), F.col(doc_id).alias("id"),
                        F.sha2(F.regexp_replace(whole(text), SPACES, " "), 256).alias("sha"))
    hashes = keyed.select(F.xxhash64("sha").alias("h"))
    repeated, blocks = repeated_filter(hashes, docs.count(), bits_per_row, max_filter_mb)
    h = F.xxhash64("sha")
    probed = keyed.withColumn("block", F.pmod(h, F.lit(blocks))).join(F.broadcast(repeated), "block", "left")
    hit = bit_of(F.col("bitmap"), _cells(h)[0])
    for cell in _cells(h)[1:]:
        hit = hit & bit_of(F.col("bitmap"), cell)
    return probed.select("row", "id", "sha", F.coalesce(hit, F.lit(False)).alias("hit"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None,
                 bits_per_row: int = 16, max_filter_mb: int = 32) -> DataFrame:
    """Each row with the id that stays of its group, the group's size, whether the row itself stays, and the text's SHA-256."""
    probed = _probed(docs, doc_id, text, carry, bits_per_row, max_filter_mb)
    alone = probed.filter(~F.col("hit")).select("row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                                F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    hits = probed.filter("hit")
    groups = settled(hits.groupBy("sha").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))
    nth = F.row_number().over(Window.partitionBy("sha", "id").orderBy(F.lit(1)))
    shared = (hits.withColumn("nth", nth).join(groups, "sha", "left")
              .withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")))
              .select("row", "keep_id", F.coalesce("group_size", F.lit(1)).alias("group_size"),
                      (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), F.col("sha").alias("text_sha256")))
    return unpacked(alone.unionByName(shared), "row", docs.columns if carry is None else carry, RESULTS)


def first_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits_per_row: int = 16, max_filter_mb: int = 32) -> DataFrame:
    """The rows that stay, with their own columns.  Spark limits the window inside each map task, so a large group sends one row a task."""
    probed = _probed(docs, doc_id, text, None, bits_per_row, max_filter_mb)
    nth = F.row_number().over(Window.partitionBy("sha").orderBy(F.col("id").asc_nulls_last()))
    first = probed.filter("hit").withColumn("nth", nth).filter("nth = 1")
    kept = probed.filter(~F.col("hit")).select("row").unionByName(first.select("row"))
    return unpacked(kept, "row", docs.columns, [])


OP4_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""
