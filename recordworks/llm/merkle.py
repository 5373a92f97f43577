"""Merkle fixity audit of WARC replicas.

A replica is a table of records (file, offset, bytes).  Each record is hashed; the records of a file in offset order are the leaves of
a tree whose nodes hash their children's hashes and cover an ordered range of offsets.  The audit compares the roots of two replicas
and goes down only from nodes that differ, so that intact files cost one comparison.

A node has at most `FANOUT` children.  Leaves are placed by the rank of their offset among both replicas' offsets of the file, so a
record that one replica lacks doesn't shift the others.  Ranks come from windows inside offset ranges, not from one window over a file:
a file that holds a third of all records is spread over many tasks.

Defined results: a null body counts as empty; rows without a file or offset can't be placed and are left out.  Rows that repeat an
offset in one replica are one leaf, hashed over all of them.  Empty tables have no roots and give an empty audit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordworks.session import settled

FANOUT = 16


def _leaves(records: DataFrame) -> DataFrame:
    """file, offset, end, hash of the records at that offset."""
    rows = records.filter(F.col("file").isNotNull() & F.col("offset").isNotNull()).select(
        "file", "offset", F.length(F.coalesce("body", F.lit(b""))).cast("long").alias("n"), F.sha2(F.coalesce("body", F.lit(b"")), 256).alias("hash"))
    return rows.groupBy("file", "offset").agg(F.max("n").alias("n"), F.sort_array(F.collect_set("hash")).alias("h"), F.count(F.lit(1)).alias("times")).select(
        "file", "offset", (F.col("offset") + F.col("n")).alias("end"),
        F.when(F.col("times") == 1, F.get("h", F.lit(0))).otherwise(F.sha2(F.concat_ws("", F.array_join("h", ""), F.col("times").cast("string")), 256)).alias("hash"))


def _placed(left: DataFrame, right: DataFrame, span: int) -> DataFrame:
    """One row for each file and offset of either replica, with both hashes and the leaf's place.  Offsets are cut in ranges of `span` bytes;
    a range's records are numbered inside it, and a place is (range, number)."""
    both = left.withColumnsRenamed({"end": "a_end", "hash": "a"}).join(right.withColumnsRenamed({"end": "b_end", "hash": "b"}), ["file", "offset"], "full")
    both = both.withColumn("chunk", F.floor(F.col("offset") / span))
    number = F.row_number().over(Window.partitionBy("file", "chunk").orderBy("offset")) - 1
    return both.select("file", "chunk", number.alias("place"), "offset", F.greatest("a_end", "b_end").alias("end"), "a", "b")


def _parent(node: Column) -> Column:
    return F.floor(node / FANOUT)


def _combined(side: str) -> Column:
    """Hash of the children's hashes in order of their places; null when no child exists."""
    ordered = F.transform(F.sort_array(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("node", F.col(side).alias("h"))))), lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["h"]))
    return F.when(F.count(side) > 0, F.sha2(F.array_join(ordered, ","), 256)).alias(side)


def trees(left: DataFrame, right: DataFrame, span: int = 1 << 26) -> list[DataFrame]:
    """The levels of both replicas' trees, leaves first: file, chunk, node, start, end, a, b.  Nodes of a range end in one node, and
    these are the leaves of the file's own upper tree, so a node never has more than FANOUT children at any level."""
    leaf = settled(_placed(_leaves(left), _leaves(right), span).select("file", "chunk", F.col("place").cast("long").alias("node"), F.col("offset").alias("start"), "end", "a", "b"))
    levels = [leaf]

    def grow(level: DataFrame, keys: list[str]) -> DataFrame:
        return level.groupBy(*keys, _parent(F.col("node")).alias("parent")).agg(
            F.min("start").alias("start"), F.max("end").alias("end"), _combined("a"), _combined("b")).withColumnRenamed("parent", "node")

    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        levels.append(settled(grow(levels[-1], ["file", "chunk"])))
    top = settled(levels[-1].select("file", F.lit(-1).cast("long").alias("chunk"), F.col("chunk").alias("node"), "start", "end", "a", "b"))
    levels.append(top)
    while True:
        levels.append(settled(grow(levels[-1], ["file", "chunk"])))
        if (levels[-1].agg(F.max("node")).first()[0] or 0) == 0:
            return levels


def audit(left: DataFrame, right: DataFrame, span: int = 1 << 26) -> DataFrame:
    """One row for each record that the replicas disagree on: file, offset, end, and how (`changed`, or absent in one of them)."""
    levels = trees(left, right, span)
    differs = ~F.col("a").eqNullSafe(F.col("b"))
    bad = levels[-1].filter(differs)
    inner = next(i for i, level in enumerate(levels) if i and level.filter("chunk = -1").limit(1).count()) if bad.limit(1).count() else len(levels)
    for i in range(len(levels) - 2, -1, -1):
        level = levels[i].filter(differs)
        if i == inner - 1:  # from the file's upper tree into the ranges: a leaf there is the single top node of a range
            bad = level.join(bad.select("file", F.col("node").alias("chunk")), ["file", "chunk"], "left_semi")
        else:
            up = bad.select("file", "chunk", F.col("node").alias("parent"))
            bad = level.withColumn("parent", _parent(F.col("node"))).join(up, ["file", "chunk", "parent"], "left_semi").drop("parent")
    how = F.when(F.col("a").isNull(), "absent in a").when(F.col("b").isNull(), "absent in b").otherwise("changed")
    return bad.select("file", F.col("start").alias("offset"), "end", how.alias("status"))


def warc_records(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as WARC records: file, offset, body.  A page's file comes from its url's host; offsets are its id times a
    fixed stride, which leaves room for any record (offsets are ordered, not dense)."""
    body = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\n\r\n"), F.coalesce("html", F.lit("")), F.lit("\r\n\r\n"))
    host = F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("unknown"))
    return pages.filter(F.col("page_id").isNotNull()).select(F.concat(host, F.lit(".warc")).alias("file"), (F.col("page_id") * STRIDE).alias("offset"), F.encode(body, "UTF-8").alias("body"), "page_id")


STRIDE = 1 << 22


def damaged(records: DataFrame) -> DataFrame:
    """A replica with faults that follow from the data: records whose body's hash starts with 00 have a byte replaced, those with 01 are absent."""
    h = F.substring(F.sha2("body", 256), 1, 2)
    body = F.when(h == "00", F.concat(F.encode(F.lit("X"), "UTF-8"), F.substring("body", 2, 1 << 30))).otherwise(F.col("body"))
    return records.filter(h != "01").withColumn("body", body)


OP2_SQL = r"""
WITH r AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), ''), 'unknown') || '.warc' AS file, page_id * 4194304 AS "offset",
    encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS body FROM pages WHERE page_id IS NOT NULL),
h AS (SELECT *, substr(sha256(body), 1, 2) AS mark FROM r)
SELECT file, "offset", "offset" + octet_length(body) AS "end", CASE mark WHEN '00' THEN 'changed' ELSE 'absent in b' END AS status
FROM h WHERE mark IN ('00', '01')"""
