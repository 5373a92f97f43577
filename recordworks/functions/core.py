"""Building blocks: regular expressions with Unicode classes, literal maps and let-bindings."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
LETTER = r"\p{L}\p{Nl}\p{No}"
BOUNDARY = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
SPACE = r"\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def rx(pattern: str, flags: str = "iu") -> str:
    """A pattern written with \\b, \\w, \\s and [^\\W\\d_] in their Unicode sense, spelled out for java.util.regex (whose
    own classes are ASCII, and whose Unicode word class differs on superscripts and combining marks)."""
    for short, long in ((r"[^\W\d_]", f"[{LETTER}]"), (r"[^\W_]", r"[\p{L}\p{N}]"), (r"\b", BOUNDARY)):
        pattern = pattern.replace(short, long)
    out, in_class = [], False
    for token in re.findall(r"\\.|.", pattern, re.S):
        if token == "[" and not in_class:
            in_class = True
        elif token == "]":
            in_class = False
        if token == r"\s":
            token = SPACE if in_class else f"[{SPACE}]"
        elif token == r"\w":
            token = WORD if in_class else f"[{WORD}]"
        out.append(token)
    return (f"(?{flags})" if flags else "") + "".join(out)


def alternation(texts: Iterable[str]) -> str:
    """Literal texts as alternatives, longest first."""
    return "|".join(quote(w) for w in sorted(texts, key=len, reverse=True))


def quote(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def no_letters_around(body: str) -> str:
    return f"(?<![{LETTER}])(?:{body})(?![{LETTER}])"


def no_word_around(body: str) -> str:
    return f"(?<![{WORD}])(?:{body})(?![{WORD}])"


def lit_map(mapping: dict[str, object]) -> Column:
    """A small constant map (folded to one literal by the optimizer)."""
    text = "\x02".join(f"{k}\x01{v}" for k, v in mapping.items())
    return F.str_to_map(F.lit(text), F.lit("\x02"), F.lit("\x01"))


def look_up(mapping: dict[str, object], key: Column) -> Column:
    """The value of `key` in a small constant map as STRING, NULL when it is absent."""
    return F.try_element_at(lit_map(mapping), key)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body` (needed inside lambdas, where stages cannot reach)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def each(columns: list[Column], body: Callable[[Column], Column]) -> Column:
    """The same expression over several columns as one array: written, optimized and compiled once instead of per column."""
    return F.transform(F.array(*columns), body)


def beyond_ascii(text: Column) -> Column:
    """A cheap test that spares plain texts the rarer replacements."""
    return F.octet_length(text) > F.length(text)


def filled(text: Column) -> Column:
    """The text, NULL when it is empty; the argument is evaluated once."""
    return let(text, lambda t: F.when(t != "", t))


def group(text: Column, pattern: str, index: int) -> Column:
    """A capture group of the first match, NULL when there is none or the group is empty."""
    return filled(F.regexp_extract(text, pattern, index))


def all_groups(text: Column, pattern: str, index: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(index))


def best_ranked(text: Column, pattern: str, ranks: dict[str, int]) -> Column:
    """The lowest rank among all matches of `pattern` (ranks keyed by the lower-cased match)."""
    hits = F.transform(all_groups(text, pattern), lambda m: look_up(ranks, F.lower(m)).cast("int"))
    return F.array_min(hits)


def one_of(value: Column, members: Iterable[str]) -> Column:
    """Membership in a constant list of words, as one literal instead of one per word."""
    return F.array_contains(F.split(F.lit(" ".join(members)), " "), value)


def contains_any(column: Column, texts: Iterable[str]) -> Column:
    """Plain searches: each walks a long page faster than a pattern that tries all texts at every character."""
    return let(column, lambda c: reduce(Column.__or__, [F.contains(c, F.lit(t)) for t in texts]))


def moment(value: Column | dt.datetime | str | None) -> Column:
    """A point in time as a TIMESTAMP column: the current time when none is given."""
    if value is None:
        return F.current_timestamp()
    return (value if isinstance(value, Column) else F.lit(value)).cast("timestamp")
