"""Currency detection, money amounts and price basis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .core import all_groups, best_ranked, let, look_up, no_letters_around, one_of, quote, rx
from .numbers import number
from .text import unescape

_SYMBOLS = list(K.CURRENCY_SYMBOLS.items())


def _symbol_pattern() -> str:
    parts, first = [], set()
    for symbol, _ in sorted(_SYMBOLS, key=lambda s: len(s[0]), reverse=True):
        first.add(symbol[0])
        if symbol.isalpha() and symbol not in K.CASE_SENSITIVE_SYMBOLS:
            first |= {symbol[0].lower(), symbol[0].upper()}
            parts.append(f"(?iu:{no_letters_around(quote(symbol))})")
        else:
            parts.append(quote(symbol))
    # the look-ahead on first characters only makes the search cheaper
    return "(?=[" + "".join(quote(c) for c in sorted(first)) + "])(?:" + "|".join(parts) + ")"


_SYMBOL_PATTERN = _symbol_pattern()
_SYMBOL_RANKS = {symbol.lower(): rank for rank, (symbol, _) in enumerate(_SYMBOLS)}
_CODE = rx(r"(?=[A-Z]{3})\b[A-Z]{3}\b", "")


def _by_symbol(rank: Column, default: Column) -> Column:
    family = F.lit(None).cast("string")
    for i, (symbol, code) in enumerate(_SYMBOLS):
        if code == "?":
            fallback, members = K.CURRENCY_FAMILIES[symbol]
            family = F.when(rank == i, F.when(one_of(default, members), default).otherwise(F.lit(fallback))).otherwise(family)
    fixed = look_up({str(i): c for i, (_, c) in enumerate(_SYMBOLS) if c != "?"}, rank.cast("string"))
    return F.when(rank.isNull(), default).otherwise(F.coalesce(fixed, family))


def detect_currency(text: Column, default: Column, currencies: list[str]) -> Column:
    """ISO code of an amount text: the first known code, else the first symbol in priority order.  The members of an
    ambiguous symbol's family follow the row's default currency."""
    masked = F.when(text.rlike("(?i)sq|ft|psf"), F.regexp_replace(text, rx(K.NOT_MONEY), " ")).otherwise(text)

    def found(t: Column) -> Column:
        codes = F.filter(all_groups(t, _CODE), lambda c: one_of(c, currencies))
        symbol = let(best_ranked(t, _SYMBOL_PATTERN, _SYMBOL_RANKS), lambda rank: _by_symbol(rank, default))
        return F.coalesce(F.get(codes, F.lit(0)), symbol)

    return F.when(text.isNull(), default).otherwise(let(masked, found))


def spaced_currency(text: Column) -> Column:
    """'RM799' -> 'RM 799': the number parser refuses a digit glued to a letter."""
    return F.when(text.rlike(r"[\p{L}.]\d"), F.regexp_replace(text, rx(K.GLUED_CURRENCY, ""), "$1 ")).otherwise(text)


def is_free(text: Column) -> Column:
    return ~text.rlike(r"\d") & text.rlike(rx(K.FREE_WORDS))


def money(text: Column, default: Column, currencies: list[str]) -> Column:
    """struct(amount, currency) of a price text."""
    def parsed(raw: Column) -> Column:
        return F.when(is_free(raw), F.struct(F.lit(0.0).alias("amount"), default.alias("currency"))).otherwise(
            let(spaced_currency(raw), lambda t: F.struct(number(t).alias("amount"),
                                                         detect_currency(t, default, currencies).alias("currency"))))

    none = F.struct(F.lit(None).cast("double").alias("amount"), default.alias("currency"))
    return F.when(text.isNull(), none).otherwise(let(unescape(text), parsed))


def price_basis(text: Column) -> Column:
    """'per_area' or 'per_person' when the price text says so, else NULL."""
    return F.when(text.rlike(rx(K.PER_AREA)), "per_area").when(text.rlike(rx(K.PER_PERSON)), "per_person")
