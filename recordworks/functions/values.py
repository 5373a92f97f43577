"""Booleans, enums, lists, pattern checks and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ..templates import Field
from .core import BOUNDARY, alternation, best_ranked, let, look_up, no_word_around, one_of, quote, rx
from .text import clean_text


def boolean(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(one_of(low, K.TRUE_WORDS), True).when(one_of(low, K.FALSE_WORDS), False)


def enum(text: Column, field: Field) -> Column:
    """Allowed value of a raw wording; `enum_of` over the cleaned, lower-cased text."""
    return F.when(text.isNotNull(), let(F.lower(F.coalesce(clean_text(text), F.lit(""))), lambda low: enum_of(low, field)))


def enum_of(low: Column, field: Field) -> Column:
    """Allowed value, the value with underscores, exact synonym, longest synonym as a whole word, allowed value as a word,
    'other' when the field has it."""
    ranked = sorted(field.synonyms, key=len, reverse=True)
    underscored = F.translate(low, "- ", "__")
    tail = F.lit("other" if "other" in field.allowed else None).cast("string")
    for value in reversed(field.allowed):
        tail = F.when(low.rlike(f"(?iu){BOUNDARY}{quote(value.replace('_', ' '))}{BOUNDARY}"), value).otherwise(tail)
    choices = [F.when(one_of(low, field.allowed), low).when(one_of(underscored, field.allowed), underscored)]
    if ranked:
        rank = best_ranked(low, no_word_around(alternation(ranked)), {w: i for i, w in enumerate(ranked)})
        choices += [look_up(field.synonyms, low),
                    look_up({str(i): field.synonyms[w] for i, w in enumerate(ranked)}, rank.cast("string"))]
    return F.when(low.isNotNull(), F.coalesce(*choices, tail))


def text_list(text: Column) -> Column:
    """Comma-separated values, trimmed, without empty ones."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(text != "", parts)


def matches(value: Column, pattern: str) -> Column:
    return value.rlike(rx(pattern, ""))


_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"


def _without_dots(path: Column) -> Column:
    """'.' and '..' segments resolved in the path part of a path-and-query text."""
    bare = F.regexp_extract(path, "^([^?#]*)", 1)
    rest = F.substring(path, F.length(bare) + 1, F.length(path))
    segments = F.split(bare, "/", -1)
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda done, seg:
                       F.when(seg == ".", done)
                       .when(seg == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done))
                       .otherwise(F.array_append(done, seg)))
    closed = F.when(bare.rlike(r"(^|/)\.\.?$"), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(bare.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(closed, "/"), rest)).otherwise(path)


def resolve_url(text: Column, base: Column) -> Column:
    """A reference merged with its base (RFC 3986)."""
    link = F.trim(text)
    origin = F.regexp_extract(base, _ORIGIN, 1)
    base_path = F.regexp_extract(base, _ORIGIN + r"([^?#]*)", 2)
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_replace(base_path, "[^/]*$", ""))
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.\\-]*:)", 1)
    return (F.when(base.isNull() | link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
            .when(link == "", base)
            .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
            .when(F.startswith(link, F.lit("/")), F.concat(origin, _without_dots(link)))
            .when(F.startswith(link, F.lit("?")), F.concat(origin, base_path, link))
            .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), link))
            .otherwise(F.concat(origin, _without_dots(F.concat(folder, link)))))


def absolute_url(text: Column, base: Column | None = None) -> Column:
    """A link made absolute against `base`; NULL unless it is http(s) with a host."""
    trimmed = F.trim(text)
    link = F.when(F.startswith(trimmed, F.lit("//")), F.concat(F.lit("https:"), trimmed)).otherwise(trimmed)
    if base is not None:
        link = resolve_url(link, base)
    return F.when(link.rlike("^(?i)https?://[^/?#]+") & (trimmed != ""), link)
