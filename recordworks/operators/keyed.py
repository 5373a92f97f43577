"""First or latest row per key.

All forms are `row_number() <= n`, which Spark limits inside each map task before the shuffle (WindowGroupLimit), so a key that
holds a large share of all rows sends a handful of rows, not the share.  Columns nobody reads are pruned down to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[Column | str], ascending: list[Column]) -> DataFrame:
    """The row with the smallest order value per key."""
    window = Window.partitionBy(*keys).orderBy(*ascending)
    return df.withColumn("__n", F.row_number().over(window)).filter(F.col("__n") == 1).drop("__n")


def latest_per_key(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """The row with the largest order value per key."""
    return first_per_key(df, keys, [c.desc() for c in order])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first `n` rows per key with their rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def distinct_latest(records: DataFrame) -> DataFrame:
    """One row per fingerprint, the most recently seen (ties: smallest uid); rows without a fingerprint all stay."""
    group = F.when(F.col("fingerprint").isNull(), F.struct(F.lit(1).alias("own"), F.col("uid").alias("k"))).otherwise(
        F.struct(F.lit(0).alias("own"), F.col("fingerprint").alias("k")))
    newest_first = -F.unix_micros(F.col("last_seen").cast("timestamp"))
    return first_per_key(records, [group], [newest_first, F.col("uid")])
