"""Checks on normalised rows and quality reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.core import rx
from ..templates import NUMERIC_TYPES, Conflict, Expiry, Field, Template


def _plain(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else str(value)


def number_text(value: Column, integer: bool) -> Column:
    """A number as it appears in a reason: whole numbers of a decimal field keep '.0', never an exponent."""
    if integer:
        return value.cast("string")
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, F.concat(value.cast("bigint").cast("string"), F.lit(".0"))).otherwise(value.cast("string"))


def check_required(template: Template) -> list[Column]:
    out = []
    for f in template.fields.values():
        if f.required:
            value = F.col(f.name)
            empty = value.isNull() if f.type in NUMERIC_TYPES else value.isNull() | (value.cast("string") == "")
            out.append(F.when(empty, F.lit(f"missing required field {f.name}")))
    return out


def _limit(f: Field, side: str) -> Column | None:
    base = getattr(f, side)
    overrides = [(when, bounds[side]) for when, bounds in f.conditional_bounds if side in bounds]
    if base is None and not overrides:
        return None
    limit = F.lit(base).cast("double")
    for (other, want), bound in overrides:
        limit = F.when(F.col(other) == want, F.lit(bound)).otherwise(limit)
    return limit


def _limit_text(f: Field, side: str) -> Column:
    text = F.lit(_plain(getattr(f, side)) if getattr(f, side) is not None else None).cast("string")
    for (other, want), bounds in f.conditional_bounds:
        if side in bounds:
            text = F.when(F.col(other) == want, F.lit(_plain(bounds[side]))).otherwise(text)
    return text


def check_bounds(template: Template, usd_rate: Column | None = None, currency: Column | None = None) -> list[Column]:
    """Sanity bounds per field, with conditional overrides; USD bounds apply when the row's currency has a rate (`usd_rate`:
    units of the currency per USD)."""
    out = []
    for f in template.fields.values():
        if f.type not in NUMERIC_TYPES:
            continue
        value = F.col(f.name)
        shown = F.concat(F.lit(f"{f.name}="), number_text(value, f.type == "integer"))
        low, high = _limit(f, "minimum"), _limit(f, "maximum")
        if low is not None:
            below = value <= low if f.exclusive_minimum else value < low
            out.append(F.when(below, F.concat(shown, F.lit(" below the sanity bound "), _limit_text(f, "minimum"))))
        if high is not None:
            out.append(F.when(value > high, F.concat(shown, F.lit(" above the sanity bound "), _limit_text(f, "maximum"))))
        if f.type == "money" and usd_rate is not None and (f.usd_minimum or f.usd_maximum):
            usd, code = value / usd_rate, F.lit("") if currency is None else currency
            if f.usd_minimum:
                out.append(F.when(usd < f.usd_minimum, F.concat(shown, F.lit(" "), code, F.lit(f" is below {_plain(f.usd_minimum)} USD"))))
            if f.usd_maximum:
                out.append(F.when(usd > f.usd_maximum, F.concat(shown, F.lit(" "), code, F.lit(f" is above {_plain(f.usd_maximum)} USD"))))
    return out


def check_expiry(expires: Expiry, now: Column) -> Column:
    """The first present date lies more than the grace days in the past."""
    day = F.substring(F.coalesce(*[F.nullif(F.col(f).cast("string"), F.lit("")) for f in expires.fields]), 1, 10)
    limit = F.date_format(F.date_sub(now.cast("date"), expires.grace_days), "yyyy-MM-dd")
    return F.when(day < limit, F.concat(F.lit(f"{expires.reason} ("), day, F.lit(")")))


def find_conflicts(conflicts: tuple[Conflict, ...]) -> list[Column]:
    """A title that speaks of another category (rent words in a sale category, unless sale words are there too)."""
    out = []
    for c in conflicts:
        text = F.col(c.field)
        hit = text.rlike(rx(c.pattern))
        if c.unless:
            hit = hit & ~text.rlike(rx(c.unless))
        out.append(F.when(hit, F.lit(c.reason)))
    return out


def reasons(checks: list[Column]) -> Column:
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def split_by_rules(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reasons): a row is rejected by every rule whose condition holds."""
    judged = df.withColumn("reasons", reasons([F.when(condition, F.lit(reason)) for reason, condition in rules.items()]))
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


# ---------------------------------------------------------------------------------------------------------------- reports
def field_coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, coverage: share of rows with a value that is not empty, 2 decimals; one pass for all fields."""
    kinds = dict(df.dtypes)

    def filled(name: str) -> Column:
        value = F.col(name)
        if kinds[name].startswith(("array", "map")):
            return value.isNotNull() & (F.size(value) > 0)
        return value.isNotNull() & (value != "") if kinds[name] == "string" else value.isNotNull()

    shares = df.agg(*[F.round(F.avg(F.when(filled(n), 1.0).otherwise(0.0)), 2).alias(n) for n in fields])
    return shares.unpivot([], fields, "field", "coverage")


def acceptance(df: DataFrame) -> DataFrame:
    """rows, valid, valid_fraction (3 decimals), ok of checked rows (reasons ARRAY); an empty input fails."""
    counts = df.agg(F.count("*").alias("rows"), F.count_if(F.size("reasons") == 0).alias("valid"))
    share = F.coalesce(F.try_divide(F.col("valid").cast("double"), F.col("rows").cast("double")), F.lit(0.0))
    return counts.withColumns({"valid_fraction": F.round(share, 3), "ok": (F.col("rows") > 0) & (share >= K.MIN_VALID_FRACTION)})


def acceptance_samples(df: DataFrame, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """A few accepted and a few rejected rows to look at."""
    return df.filter(F.size("reasons") == 0).limit(n), df.filter(F.size("reasons") > 0).limit(n)


def reason_histogram(df: DataFrame, column: str = "reasons") -> DataFrame:
    return df.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def warning_histogram(df: DataFrame, column: str = "warnings") -> DataFrame:
    """Parse warnings per field (the part before the colon)."""
    return df.select(F.explode(column).alias("w")).groupBy(F.substring_index("w", ":", 1).alias("field")).agg(F.count("*").alias("rows"))


def status_counts(df: DataFrame, column: str, missing: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))


def cross_source_duplicates(records: DataFrame) -> DataFrame:
    """Fingerprints found in more than one source.  Two aggregated bounds tell that without collecting the sources."""
    spread = records.filter("fingerprint IS NOT NULL").groupBy("fingerprint").agg(
        F.min("source").alias("__low"), F.max("source").alias("__high"), F.count("*").alias("rows"))
    return spread.filter("__low <> __high").select("fingerprint", "rows")
