"""Areas, distances and weights with their units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .core import SPACE, all_groups, let, look_up, rx
from .numbers import number
from .text import unescape

_BEFORE = rx(rf"\d[\d.,{SPACE}'’]*(?:\s*(?:{K.UNIT_AMOUNT_SUFFIX}))?")
# kind -> (units in order, unit when none is shown, decimals)
KINDS = {
    "area": (K.AREA_UNITS, "sqm", 2),
    "distance": (K.DISTANCE_UNITS, "km", 1),
    "weight": (K.WEIGHT_UNITS, "kg", 4),
}


def _shown(text: Column, units) -> Column:
    """struct(unit, before): the first unit of the list that occurs, and the text in front of it.  One search for any of the units spares texts
    without a unit the others; the text is then cut once, where the unit that counts stands, by a pattern that is compiled once (a split compiles its
    own for every row)."""
    chain = F.lit(None).cast("struct<unit:string,before:string>")
    for unit, pattern, _ in reversed(units):
        chain = F.when(text.rlike(rx(pattern)), F.struct(F.lit(unit).alias("unit"), F.regexp_extract(text, rx(rf"^(.*?)(?:{pattern})", "isu"), 1).alias("before"))).otherwise(chain)
    return F.when(text.rlike(rx("|".join(f"(?:{pattern})" for _, pattern, _ in units))), chain)


def measure(kind: str, text: Column, hint: Column | None = None, given: Column | None = None) -> Column:
    """struct(value, unit) in the canonical unit of `kind`.  The amount is the last numeric run before the unit; `hint` is the
    unit when the text shows none and `given` the amount when the raw value was a number.  A unit without a factor gives a
    NULL value."""
    units, default, digits = KINDS[kind]
    factors = {u: f for u, _, f in units if f is not None}
    hint = F.lit(None).cast("string") if hint is None else hint
    given = F.lit(None).cast("double") if given is None else given

    def result(amount: Column, unit: Column) -> Column:
        factor = look_up(factors, unit).cast("double")
        return F.struct(F.round(amount * factor, digits).alias("value"), unit.alias("unit"))

    def parsed(raw: Column) -> Column:
        def with_unit(shown: Column) -> Column:
            run = F.try_element_at(all_groups(shown["before"], _BEFORE), F.lit(-1))
            return result(number(F.coalesce(run, raw)), F.coalesce(shown["unit"], hint, F.lit(default)))
        return let(_shown(raw, units), with_unit)

    stated = F.coalesce(hint, F.lit(default))
    return F.when(given.isNotNull(), result(given, stated)).when(text.isNotNull(), let(unescape(text), parsed))
