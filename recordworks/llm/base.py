"""What the corpus operators share: word patterns, let-bindings, row packing and row keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordworks.session import settled

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES, -1), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is evaluated once per row, however often the body (or a lambda in it) reads it."""
    return F.transform(F.array(value), body)[0]


def packed(docs: DataFrame, carry: list[str] | None = None) -> Column:
    """The columns to carry as one struct, so that no name of theirs can clash with an operator's own columns."""
    names = docs.columns if carry is None else carry
    return F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(None).cast("string").alias("_none"))


def unpacked(df: DataFrame, row: str, names: list[str], results: list[str]) -> DataFrame:
    """Carried columns, then results.  A carried column with the name of a result gives way to the result."""
    return df.select(*[F.col(row)[c].alias(c) for c in names if c not in results], *results)


def row_keys(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """(k1, k2): a key for a row by its id and its text.  Rows that agree in both are interchangeable copies; a null id is 0
    in k1 and is told from an id of 0 by k2."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("k1"),
            F.xxhash64(F.col(doc_id).cast("string"), whole(text)).alias("k2")]


def small_batches(spark: SparkSession, rows: int = 500, size: str = "8m") -> None:
    """Arrow batches bounded in rows and bytes, so that very long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


BLOCK_BITS = 32768  # bits of one bitmap of bitmap_construct_agg


def bit_of(bitmap: Column, place: Column) -> Column:
    """Whether a bit of such a bitmap is set; null without a bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(place, F.lit(8)).cast("int"))) != 0


def flagged(df: DataFrame, key: str, wanted: DataFrame, rows: int, max_filter_mb: int = 32) -> DataFrame:
    """`df` with `_maybe`: whether its long `key` may be among those of `wanted(key)`, by a Bloom filter of at most `max_filter_mb` that is
    broadcast.  It only spares shuffling rows that an exact join would find nothing for; when it is full, it flags everything."""
    blocks = max(1, min(max_filter_mb * 256, -(-rows * 16 // BLOCK_BITS)))
    cell = lambda h: F.pmod(F.xxhash64(h), F.lit(BLOCK_BITS))
    bits = settled(wanted.select(F.pmod(key, F.lit(blocks)).alias("_block"), cell(F.col(key)).alias("_cell"))
                   .groupBy("_block").agg(F.expr("bitmap_construct_agg(_cell)").alias("_bitmap")))
    probed = df.withColumn("_block", F.pmod(key, F.lit(blocks))).join(F.broadcast(bits), "_block", "left")
    return probed.select(*df.columns, F.coalesce(bit_of(F.col("_bitmap"), cell(F.col(key))), F.lit(False)).alias("_maybe"))


def maybe_in(df: DataFrame, key: str, wanted: DataFrame, rows: int) -> DataFrame:
    """The flagged rows of `df`."""
    return flagged(df, key, wanted, rows).filter("_maybe").select(*df.columns)
