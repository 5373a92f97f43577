"""Text cleaning as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .core import SPACE, all_groups, filled, let, look_up, rx

_AMPERSAND = r"&(?:(?:amp|AMP);?|#0*38;|#[xX]0*26;)"
_ENTITY = (r"&(?!(?:amp|AMP);?|#0*38;|#[xX]0*26;)(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,8};?)")


@lru_cache(maxsize=1)
def _names() -> dict[str, str]:
    """HTML 4 entity names (with the legacy forms that may lack the semicolon), from the standard library's tables."""
    return {name: char for name, char in entities.html5.items()
            if name.rstrip(";") in entities.name2codepoint and char != "&"}


def _character(code: Column) -> Column:
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32"))


def _entity(match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9a-fA-F]", "")
    return F.coalesce(
        F.when(F.lower(F.substring(match, 1, 3)) == "&#x", _character(F.conv(digits, 16, 10).try_cast("bigint")))
        .when(F.substring(match, 1, 2) == "&#", _character(digits.try_cast("bigint")))
        .otherwise(look_up(_names(), F.substring(match, F.lit(2), F.length(match)))), match)


def unescape(text: Column, closed: bool = False) -> Column:
    """HTML entities decoded once.  Each distinct entity of a text is replaced in turn, the ampersand itself last, so
    `&amp;lt;` becomes `&lt;` and not `<`.  `closed`: only entities that end in a semicolon, so what a cut page leaves of one stays."""
    entity, ampersand = (_ENTITY.replace(";?", ";"), _AMPERSAND.replace(";?", ";")) if closed else (_ENTITY, _AMPERSAND)
    found = F.sort_array(F.array_distinct(all_groups(text, entity)), asc=False)
    decoded = F.aggregate(found, text, lambda done, match: F.replace(done, match, _entity(match)))
    return F.when(F.contains(text, F.lit("&")), F.regexp_replace(decoded, ampersand, "&")).otherwise(text)


# one blank needs no replacement, so only other or repeated white space is matched
_BLANKS = f"[{SPACE}&&[^ ]][{SPACE}]*| [{SPACE}]+"


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def clean_text(text: Column, limit: int | None = None, closed: bool = False) -> Column:
    """Hidden blocks dropped with their content, tags removed, entities decoded (see `unescape`), white space collapsed; at most `limit` characters, if given."""
    without_tags = F.regexp_replace(F.regexp_replace(text, rx(K.HIDDEN_BLOCK_TO_END, "is"), " "), K.TAG, " ")
    bare = F.when(F.contains(text, F.lit("<")), without_tags).otherwise(text)
    whole = squeeze(let(bare, lambda t: unescape(t, closed)))
    return filled(whole if limit is None else F.substring(whole, 1, limit))


def visible_text(html: Column, closed: bool = False) -> Column:
    """What a reader sees of a page: hidden blocks and every tag removed, entities decoded (see `unescape`)."""
    bare = F.regexp_replace(F.regexp_replace(html, rx(K.HIDDEN_BLOCK, "is"), " "), "<[^>]+>", " ")
    return squeeze(let(F.coalesce(bare, F.lit("")), lambda t: unescape(t, closed)))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, str]:
    """Characters whose decomposition starts with one base character, and that base (Latin, Greek, Cyrillic, full width);
    combining marks are removed."""
    source, target = [], []
    for low, high in ((0xC0, 0x250), (0x370, 0x500), (0x1E00, 0x2000), (0xFF01, 0xFF5F)):
        for code in range(low, high):
            char = chr(code)
            base = "".join(c for c in unicodedata.normalize("NFKD", char).casefold() if not unicodedata.combining(c))
            if len(base) == 1 and base != char:
                source.append(char)
                target.append(base)
    return "".join(source), "".join(target), "".join(chr(c) for c in range(0x300, 0x370))


def fold(text: Column) -> Column:
    """Lower case without accents."""
    source, target, marks = _folding()
    return F.replace(F.translate(F.lower(text), source + marks, target), F.lit("ß"), F.lit("ss"))


def city_key(name: Column) -> Column:
    """Comparison key of a place name: folded, common prefixes and punctuation removed."""
    bare = F.regexp_replace(F.trim(fold(name)), rx(K.CITY_PREFIX), "")
    return F.trim(F.regexp_replace(bare, f"[{SPACE}\\-_.,'’()/]+", " "))
