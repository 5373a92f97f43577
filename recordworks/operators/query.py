"""Record queries: filters, distinct view, order, page and total; list views."""

from __future__ import annotations

from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..templates import Template
from .keyed import distinct_latest

META = ["source", "first_seen", "last_seen", "fingerprint"]
COMPARISONS = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
}
OPERATORS = [*COMPARISONS, "contains", "in", "exists"]


class Page(NamedTuple):
    """A page of rows and, as a one-row frame, the number of rows before paging."""

    rows: DataFrame
    total: DataFrame


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _typed(column: Column, kind: str, value: Any) -> Column:
    """A number compares as a number, anything else as text (booleans and dates keep their type)."""
    if _is_number(value) or isinstance(value, bool) or not isinstance(value, str):
        return column
    return column if kind in ("string", "date", "timestamp", "timestamp_ntz") else column.cast("string")


def predicate(name: str, operator: str, value: Any, kind: str = "string") -> Column:
    """One condition as a column; an unknown operator fails here, before any job runs."""
    column = F.col(name)
    if operator in COMPARISONS:
        return COMPARISONS[operator](_typed(column, kind, value), F.lit(value))
    if operator == "contains":
        text = str(value).lower().replace("\\", "\\\\")
        return F.lower(column.cast("string")).like(f"%{text}%")
    if operator == "in":
        chosen = list(value or [])
        return _typed(column, kind, chosen[0]).isin(*chosen) if chosen else F.lit(False)
    if operator == "exists":
        return column.isNotNull() if value else column.isNull()
    raise ValueError(f"unknown operator {operator!r}; use {OPERATORS}")


def conditions(df: DataFrame, filters: dict[str, Any] | None, allowed: list[str]) -> list[Column]:
    kinds = dict(df.dtypes)
    out = []
    for name, condition in (filters or {}).items():
        if name not in allowed:
            raise ValueError(f"unknown field {name!r}; fields: {allowed}")
        chosen = condition if isinstance(condition, dict) else {"eq": condition}
        out += [predicate(name, operator, value, kinds.get(name, "string")) for operator, value in chosen.items()]
    return out


def query(records: DataFrame, *, columns: list[str] | Template, filters: dict[str, Any] | None = None,
          fields: list[str] | None = None, source: str | None = None, order_by: str | None = None, desc: bool = True,
          limit: int | None = 100, offset: int = 0, distinct: bool = False) -> Page:
    """Filtered, ordered, paged records.  The distinct view is taken over all records first: when the newest row of a
    fingerprint fails the filters, the whole group is gone.  `limit` None gives all rows from `offset` on."""
    known = [*columns.output_columns(), "extra"] if isinstance(columns, Template) else list(columns)
    order = order_by or "last_seen"
    if order not in META and order not in known:
        raise ValueError(f"cannot order by {order!r}")
    where = conditions(records, filters, known)
    if source is not None:
        where.append(F.col("source") == source)
    base = distinct_latest(records) if distinct else records
    matching = base.filter(reduce(lambda a, b: a & b, where)) if where else base
    key = F.col(order).desc() if desc else F.col(order).asc()
    shown = fields or [c for c in known if c in records.columns]
    page = _limited(matching.orderBy(key, F.col("uid").asc()).offset(max(0, int(offset))), limit).select(*shown, *[m for m in META if m not in shown])
    return Page(page, matching.agg(F.count("*").alias("total")))


def _limited(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(max(1, int(limit)))


def list_latest(table: DataFrame, order: list[Column], *, limit: int | None = None, **equals: Any) -> DataFrame:
    """The rows of a history or registry table, latest first, at most `limit`; conditions that are None are left out."""
    for name, value in equals.items():
        if value is not None:
            table = table.filter(F.col(name) == F.lit(value))
    return _limited(table.orderBy(*order), limit)


def usage_since(usage: DataFrame, day: str | None = None) -> DataFrame:
    """Daily usage rows from a day on, newest day first."""
    rows = usage if day is None else usage.filter(F.col("day") >= day)
    return rows.orderBy(F.col("day").desc(), F.col("source"))
