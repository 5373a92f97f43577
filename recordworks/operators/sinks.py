"""Exports and alert delivery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import read_or_empty


def csv_safe(text: Column) -> Column:
    """A text cell that a spreadsheet would evaluate gets a leading quote."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_cells(df: DataFrame, raw: bool = False) -> DataFrame:
    """Nested values as JSON, text cells neutralised unless `raw`, numbers untouched."""
    out = []
    for field in df.schema:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            cell = F.to_json(cell)
        elif isinstance(field.dataType, T.StringType) and not raw:
            cell = csv_safe(cell)
        out.append(cell.alias(field.name))
    return df.select(*out)


def export_csv(df: DataFrame, path: str, raw: bool = False) -> None:
    csv_cells(df, raw).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False).csv(path)


def export_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


EXPORTS: dict[str, Callable] = {"csv": export_csv, "jsonl": export_jsonl, "parquet": export_parquet}


def export(df: DataFrame, fmt: str, path: str, **options) -> None:
    if fmt.lower() not in EXPORTS:
        raise ValueError("format: csv | jsonl | parquet")
    EXPORTS[fmt.lower()](df, path, **options)


def infer_kinds(df: DataFrame, names: list[str], values: str = "v") -> DataFrame:
    """field, kind of the values of a VARIANT object: only booleans, only whole numbers, numbers, or else text; one pass."""
    def kinds(name: str) -> list[Column]:
        value = F.variant_get(values, f'$["{name}"]', "variant")
        kind = F.schema_of_variant(value)
        present = value.isNotNull() & (kind != "VOID")
        return [F.coalesce(F.bool_and(F.when(present, kind == "BOOLEAN")), F.lit(False)).alias(f"{name}__b"),
                F.coalesce(F.bool_and(F.when(present, kind == "BIGINT")), F.lit(False)).alias(f"{name}__i"),
                F.coalesce(F.bool_and(F.when(present, kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))), F.lit(False)).alias(f"{name}__n")]

    flags = df.agg(*[k for name in names for k in kinds(name)])
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.when(F.col(f"{n}__b"), "BOOLEAN").when(F.col(f"{n}__i"), "BIGINT")
                              .when(F.col(f"{n}__n"), "DOUBLE").otherwise("STRING").alias("kind")) for n in names])
    return flags.select(F.inline(rows))


def typed_columns(df: DataFrame, kinds: dict[str, str], values: str = "v") -> DataFrame:
    """Fields of a VARIANT object as columns of the inferred kinds."""
    return df.select(*[F.try_variant_get(values, f'$["{n}"]', k.lower()).alias(n) for n, k in kinds.items()])


# ------------------------------------------------------------------------------------------------------------------ delivery
OUTCOME = "alert_id string, channel string, batch long, delivered boolean, error string, attempted_at timestamp"


def read_outcomes(spark: SparkSession, ledger: str) -> DataFrame:
    """The outcome ledger: one row for each attempt to deliver an alert on a channel; empty before the first attempt."""
    return read_or_empty(spark, ledger, OUTCOME)


def pending_on(alerts: DataFrame, outcomes: DataFrame, channel: str, max_attempts: int | None = None) -> DataFrame:
    """Alerts that a channel has not taken yet, and, with a bound, has not been offered that often."""
    mine = outcomes.filter(F.col("channel") == channel).groupBy("alert_id").agg(F.bool_or("delivered").alias("taken"), F.count(F.lit(1)).alias("attempts"))
    settled_for = mine.filter("taken" if max_attempts is None else F.col("taken") | (F.col("attempts") >= max_attempts))
    return alerts.join(settled_for.select("alert_id"), "alert_id", "left_anti")


def deliver_alerts(alerts: DataFrame, batch_id: int, channels: dict[str, Callable[[DataFrame], None]], ledger: str, now: Column | None = None,
                   max_attempts: int | None = None) -> None:
    """Offer pending alerts(alert_id, ..) to every channel on its own and note in the ledger what came of it, alert by alert and channel by channel.

    A channel gets what the ledger doesn't say it has taken, so another channel's failure never sends it an alert again, and repeating a batch after a
    failure sends only what was not noted.  The outcome of a channel is written before the next channel is tried."""
    spark = alerts.sparkSession
    for name, send in channels.items():
        batch = pending_on(alerts, read_outcomes(spark, ledger), name, max_attempts).persist()
        try:
            if not batch.limit(1).count():
                continue
            problem = None
            try:
                send(batch)
            except Exception as failure:  # a channel's own failure is an outcome, not an error of the job
                problem = f"{type(failure).__name__}: {failure}"
            rows = batch.select(F.col("alert_id").cast("string").alias("alert_id"), F.lit(name).alias("channel"), F.lit(batch_id).cast("long").alias("batch"), F.lit(problem is None).alias("delivered"),
                                F.lit(problem).cast("string").alias("error"), (F.current_timestamp() if now is None else now).alias("attempted_at"))
            rows.write.mode("append").parquet(ledger)
        finally:
            batch.unpersist()


def stream_delivery(alerts: DataFrame, checkpoint: str, channels: dict[str, Callable[[DataFrame], None]], ledger: str, backlog: DataFrame | None = None):
    """Deliver a stream of alerts.  What an earlier batch could not deliver is in `backlog` (a table of all alerts) and is offered again with each batch."""
    def each(batch: DataFrame, batch_id: int) -> None:
        deliver_alerts(batch if backlog is None else batch.unionByName(backlog, allowMissingColumns=True).dropDuplicates(["alert_id"]), batch_id, channels, ledger)

    return alerts.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def delivery_state(alerts: DataFrame, outcomes: DataFrame, channels: list[str]) -> DataFrame:
    """alerts(alert_id, ..) x channels -> delivered, attempts: one row for each channel of each alert."""
    tried = outcomes.groupBy("alert_id", "channel").agg(F.bool_or("delivered").alias("delivered"), F.count(F.lit(1)).alias("attempts"))
    wanted = alerts.select("alert_id", F.explode(F.array(*map(F.lit, channels))).alias("channel"))
    return wanted.join(tried, ["alert_id", "channel"], "left").fillna({"delivered": False, "attempts": 0})
