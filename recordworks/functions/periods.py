"""Periods an amount is quoted per, and conversion between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .core import alternation, best_ranked, group, let, look_up, no_letters_around, rx

WORDS = {word: period for period, names in K.PERIOD_WORDS.items() for word in names}
_LONG = sorted((w for w in WORDS if len(w) >= 3), key=len, reverse=True)
_LONG_PATTERN = no_letters_around(alternation(_LONG))
_LONG_RANKS = {word: rank for rank, word in enumerate(_LONG)}


def period(text: Column, default: Column | None = None) -> Column:
    """Exact word, then the word without a 'per' prefix, then the longest word inside the text, then a short unit after a
    slash (never a square or cubic metre), then the default."""
    def found(t: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(t, rx(K.PERIOD_PREFIX, ""), ""), r"^[ ./]+|[ ./]+$", "")
        inside = look_up({str(i): WORDS[w] for i, w in enumerate(_LONG)},
                         best_ranked(t, _LONG_PATTERN, _LONG_RANKS).cast("string"))
        short = look_up(WORDS, group(t, rx(K.PERIOD_AFTER_SLASH, ""), 1))
        return F.coalesce(look_up(WORDS, t), look_up(WORDS, bare), F.when(t.rlike(r"[\p{L}]"), F.coalesce(inside, short)))

    known = F.when(text.isNotNull(), let(F.lower(F.trim(text)), found))
    return known if default is None else F.coalesce(known, default)


def convert_period(amount: Column, source: Column, target: str) -> Column:
    """Amount per `source` period as an amount per `target` period, 2 decimals."""
    per_year = look_up(K.PERIODS_PER_YEAR, source).cast("double")
    return F.round(amount * per_year / F.lit(K.PERIODS_PER_YEAR[target]), 2)
