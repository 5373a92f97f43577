"""Amounts in text: grouping marks, decimal marks, multiplier words, Indian and CJK notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .core import SPACE, all_groups, beyond_ascii, let, look_up, rx
from .text import unescape

_RUN = rf"\d[\d.,{SPACE}'’]*"
_MULTIPLIER = "|".join(f"(?:{p})" for p, _ in K.MULTIPLIERS)
# the look-ahead in front only makes the search cheaper
_NUMBER = rx(rf"(?=[-\d])(?<![\w-])-?{_RUN}(?:[{SPACE}]*(?:{_MULTIPLIER}))?")
_GROUPING = " \t\r\n\f\v'’\u0085\u00a0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(chr(c) for c in range(0x2000, 0x200B))
_SMALL, _LARGE = "".join(K.CJK_SMALL), "".join(K.CJK_LARGE)
_CJK = rf"(\d[\d.,]*)[{SPACE}]*(?=[{_SMALL}{_LARGE}])([{_SMALL}]?)[{SPACE}]*([{_LARGE}]?)"


def digits_text(text: Column) -> Column:
    """Entities decoded and Arabic digits and marks turned into ASCII: the form the number parser reads."""
    return let(unescape(text), lambda t: F.when(beyond_ascii(t), F.translate(t, K.ARABIC_FROM, K.ARABIC_TO)).otherwise(t))


def squeeze_run(run: Column) -> Column:
    """A numeric run without sign, grouping blanks and apostrophes, and without trailing marks."""
    return F.rtrim(F.translate(run, "-" + _GROUPING, ""), F.lit(".,"))


def plain_number(run: Column) -> Column:
    """The value of a squeezed run.  With both marks present the later one is decimal; with one kind it groups when it
    occurs twice or is followed by exactly three last digits."""
    comma, dot = F.contains(run, F.lit(",")), F.contains(run, F.lit("."))
    comma_last = F.length(F.substring_index(run, ",", -1)) < F.length(F.substring_index(run, ".", -1))
    several = F.length(run) - F.length(F.translate(run, ",.", "")) > 1
    ascii_form = (F.when(comma & dot, F.when(comma_last, F.translate(run, ",.", ".")).otherwise(F.translate(run, ",", "")))
                  .when(comma | dot, F.when(several | F.substring(run, -4, 1).isin(",", "."), F.translate(run, ",.", ""))
                        .otherwise(F.translate(run, ",", ".")))
                  .otherwise(run))
    return ascii_form.try_cast("double")


def _factor(match: Column) -> Column:
    word = F.lower(F.regexp_extract(match, rf"([\p{{L}}][^\d]*)$", 1))
    chain = F.lit(1.0)
    for pattern, value in reversed(K.MULTIPLIERS):
        chain = F.when(word.rlike("^(?:" + pattern.replace(r"\b", "") + ")$"), F.lit(value)).otherwise(chain)
    return F.when(match.rlike(r"\p{L}"), chain).otherwise(F.lit(1.0))


def _generic(text: Column) -> Column:
    """The first amount with its sign and multiplier word."""
    def value(match: Column) -> Column:
        run = F.when(match.rlike(r"\p{L}"), F.regexp_extract(match, rf"^-?({_RUN})", 1)).otherwise(match)
        sign = F.when(F.startswith(match, F.lit("-")), F.lit(-1.0)).otherwise(F.lit(1.0))
        return let(squeeze_run(run), lambda r: plain_number(r) * _factor(match) * sign)

    return let(F.regexp_extract(text, _NUMBER, 0), lambda m: F.when(m != "", value(m)))


def _cjk_sum(text: Column) -> Column:
    """n x small unit x big unit, summed ('3億5000万'); NULL when no number carries a unit."""
    numbers, small, large = (all_groups(text, _CJK, i) for i in (1, 2, 3))
    parts = F.transform(numbers, lambda n, i: plain_number(squeeze_run(n))
                        * F.coalesce(look_up(K.CJK_SMALL, F.get(small, i)).cast("double"), F.lit(1.0))
                        * F.coalesce(look_up(K.CJK_LARGE, F.get(large, i)).cast("double"), F.lit(1.0)))
    known = F.filter(parts, lambda p: p.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda total, p: total + p))


def number_in(text: Column) -> Column:
    """The amount of a text that `digits_text` has prepared."""
    cjk = F.when(beyond_ascii(text) & text.rlike(f"[{_SMALL}{_LARGE}]"), _cjk_sum(text))
    return F.coalesce(cjk, _generic(text))


def number(text: Column) -> Column:
    """The amount in a raw text, NULL when there is none."""
    return let(digits_text(text), number_in)


def integer_of(value: Column) -> Column:
    """Half-even rounding to a whole number."""
    return F.bround(value, 0).try_cast("bigint")


def price_range(text: Column) -> Column:
    """struct(low, high) over the parts around a dash or a 'to' word."""
    parts = F.filter(F.split(digits_text(text), rx(K.RANGE_SPLIT)), lambda p: p.rlike(r"\d"))
    return let(F.filter(F.transform(parts, lambda p: number_in(p)), lambda n: n.isNotNull()),
               lambda found: F.struct(F.array_min(found).alias("low"), F.array_max(found).alias("high")))
