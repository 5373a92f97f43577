"""Dates and times in many notations -> ISO text.

A wall-clock time without an offset is local time in the row's country when that country has one time zone; a date
without a time is midnight UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .core import all_groups, alternation, beyond_ascii, group, let, look_up, no_letters_around, rx

_MONTHS = {word: i + 1 for i, names in enumerate(K.MONTH_WORDS) for word in names}
_NAMES = alternation(_MONTHS)
_DAY_FIRST = K.DATE_WITH_DAY_FIRST.replace("{months}", _NAMES)
_MONTH_FIRST = K.DATE_WITH_MONTH_FIRST.replace("{months}", _NAMES)
# pattern, day group, month group, year group; the order is the order of preference
_WORDED = [(rx(_DAY_FIRST), 1, 2, 3), (rx(_MONTH_FIRST), 2, 1, 3), (rx(_DAY_FIRST + "?"), 1, 2, 3), (rx(_MONTH_FIRST + "?"), 2, 1, 3)]
_RELATIVE = rx(K.DATE_RELATIVE.replace("{ago}", K.AGO_UNITS).replace("{after}", K.AGO_AFTER))
_ISO = (r"^(\d{4})-?(0[1-9]|1[0-2])-?(0[1-9]|[12]\d|3[01])"
        r"(?:[^\d](?:([01]\d|2[0-3])(?::?([0-5]\d)(?::?([0-5]\d)(?:[.,](\d{1,9}))?)?)?)(Z|z|[+-]\d{2}(?::?\d{2})?)?)?$")
_ZONES = K.COUNTRY_ZONES


def _part(y: Column, m: Column, d: Column, rest: Column) -> Column:
    return F.struct(y.cast("string").alias("y"), m.cast("string").alias("m"), d.cast("string").alias("d"), rest.alias("rest"))



def _tail(text: Column, pattern: str) -> Column:
    start = F.regexp_instr(text, F.lit(pattern))
    return F.substring(text, start + F.length(F.regexp_extract(text, pattern, 0)), F.length(text))


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, m, d), "y-M-d")


def _infer_year(month: Column, day: Column, now: Column) -> Column:
    """The year of a date that names none: the next such day unless it was within the last 60 days."""
    this = F.year(now)
    chain = F.when(F.lit(False), F.lit(None).cast("int"))
    for shift in (0, 1, -1):
        ahead = F.date_diff(_day((this + shift).cast("string"), month, day), now.cast("date"))
        chain = chain.when(ahead.between(-K.YEAR_BACK_DAYS, K.YEAR_AHEAD_DAYS), this + shift)
    return chain.otherwise(this).cast("string")


def _numeric_last(text: Column, country: Column) -> Column:
    """a.b.yyyy: day first, month first in a few countries when written with a slash; swapped when it must be."""
    a, b, y = (F.regexp_extract(text, K.DATE_YEAR_LAST, i) for i in (1, 2, 3))
    month_first = F.upper(country).isin(*K.MONTH_FIRST_COUNTRIES) & F.contains(
        F.regexp_extract(text, K.DATE_YEAR_LAST, 0), F.lit("/"))
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    first, second = a.cast("int"), b.cast("int")
    month, day = F.when(month_first, first).otherwise(second), F.when(month_first, second).otherwise(first)
    swap = (month > 12) & (day <= 12)
    return _part(year, F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day), _tail(text, K.DATE_YEAR_LAST))


def _worded(text: Column, now: Column) -> Column:
    """Dates with a month name; a match that carries a year is preferred, then the earliest one."""
    at = [F.regexp_instr(text, F.lit(p)) for p, _, _, _ in _WORDED]

    def parts(i: int, pos: Column) -> Column:
        pattern, d, m, y = _WORDED[i]
        match = F.regexp_extract(text, pattern, 0)
        day, word, year = F.regexp_extract(match, pattern, d), F.regexp_extract(match, pattern, m), group(match, pattern, y)
        month = look_up(_MONTHS, F.lower(word))
        rest = F.concat(F.substring(text, F.lit(1), pos - 1), F.lit(" "),
                        F.substring(text, pos + F.length(match), F.length(text)))
        return _part(F.coalesce(year, _infer_year(month, day, now)), month, day, rest)

    return let(F.array(*at), lambda p: F.when((p[0] > 0) & ((p[1] == 0) | (p[0] <= p[1])), parts(0, p[0]))
               .when(p[1] > 0, parts(1, p[1]))
               .when((p[2] > 0) & ((p[3] == 0) | (p[2] <= p[3])), parts(2, p[2]))
               .when(p[3] > 0, parts(3, p[3])))


def _clock(rest: Column) -> Column:
    """The first wall-clock time in a text as minutes of the day: '18:30', '6pm', '6.30 p.m.', '18h30', '19 Uhr'."""
    pattern = rx(K.TIME_OF_DAY)
    hours, minutes, marks = (all_groups(rest, pattern, i) for i in (1, 2, 3))

    def minute_of_day(h: Column, i: Column) -> Column:
        hour, minute = h.cast("int"), F.get(minutes, i)
        mark = F.replace(F.lower(F.get(marks, i)), F.lit("."), F.lit(""))
        bare = (minute == "") & (mark == "")
        wrong = mark.isin("am", "pm") & (hour > 12)
        hour24 = F.when((mark == "pm") & (hour < 12), hour + 12).when((mark == "am") & (hour == 12), F.lit(0)).otherwise(hour)
        return F.when(~bare & ~wrong, hour24 * 60 + F.coalesce(minute.try_cast("int"), F.lit(0)))

    return F.get(F.filter(F.transform(hours, minute_of_day), lambda v: v.isNotNull()), F.lit(0))


def _offset(local: Column, zone: Column) -> Column:
    """'+02:00' for a local time in a zone, NULL zone -> '+00:00'."""
    seconds = F.unix_seconds(local) - F.unix_seconds(F.to_utc_timestamp(local, F.coalesce(zone, F.lit("UTC"))))
    size = F.abs(seconds)
    return F.format_string("%s%02d:%02d", F.when(seconds < 0, "-").otherwise("+"),
                           F.floor(size / 3600).cast("int"), F.floor((size % 3600) / 60).cast("int"))


def _instant(ts: Column, date_only: bool) -> Column:
    return F.date_format(ts, "yyyy-MM-dd" if date_only else "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def _kind(t: Column, low: Column) -> Column:
    """Which notation a text is in.  Relative words come before every notation but a full ISO text, which has none."""
    today, yesterday = (rx(no_letters_around(alternation(w)), "") for w in (K.TODAY_WORDS, K.YESTERDAY_WORDS))
    ago = low.rlike(_RELATIVE) & ((F.regexp_extract(low, _RELATIVE, 3) != "") | low.rlike(rx(K.AGO_BEFORE, "")))
    worded = t.rlike(r"\p{L}")
    return (F.when(t == "", None)
            .when(t.rlike(_ISO) & _day(*(F.regexp_extract(t, _ISO, i) for i in (1, 2, 3))).isNotNull(), "iso")
            .when(worded & low.rlike(today), "today")
            .when(worded & low.rlike(yesterday), "yesterday")
            .when(worded & ago, "ago")
            .when(t.rlike(K.DATE_YEAR_FIRST), "ymd")
            .when(t.rlike(K.DATE_YEAR_LAST), "dmy")
            .when(beyond_ascii(t) & t.rlike(K.DATE_CJK), "cjk")
            .when(worded & t.rlike(r"\d"), "named"))


def _ago(low: Column, now: Column) -> Column:
    unit, count = F.regexp_extract(low, _RELATIVE, 2), F.regexp_extract(low, _RELATIVE, 1)
    seconds = (F.when(unit.isin(*K.AGO_MINUTES), 60).when(unit.isin(*K.AGO_HOURS), 3600)
               .when(unit.isin(*K.AGO_WEEKS), 7 * 86400).when(unit.isin(*K.AGO_MONTHS), 30 * 86400).otherwise(86400))
    return F.timestamp_seconds(F.unix_seconds(now) - count.try_cast("bigint") * seconds)


def _iso(t: Column, zone: Column, date_only: bool) -> Column:
    """A full ISO text, normalised: offset written as +hh:mm, a local time completed with its zone's offset."""
    part = [F.regexp_extract(t, _ISO, i) for i in range(9)]
    day = _day(*part[1:4])
    if date_only:
        return F.date_format(day, "yyyy-MM-dd")
    clock = sum((F.coalesce(part[i].try_cast("int"), F.lit(0)) * size for i, size in ((4, 3600), (5, 60), (6, 1))), F.lit(0))
    fraction = F.when(part[7].rlike("[1-9]"), F.concat(F.lit("."), F.rpad(F.substring(part[7], 1, 6), 6, "0"))).otherwise("")
    digits = F.replace(part[8], F.lit(":"), F.lit(""))
    given = F.concat(F.substring(digits, 1, 3), F.lit(":"), F.rpad(F.substring(digits, 4, 2), 2, "0"))
    return let(F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + clock), lambda local: F.concat(
        F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), fraction,
        F.when((part[8] == "") & (part[5] != ""), _offset(local, zone))
        .when((part[8] == "") | (F.upper(part[8]) == "Z"), "+00:00").otherwise(given)))


def _found(part: Column, zone: Column, date_only: bool) -> Column:
    """Year, month, day and the rest of the text as ISO text; NULL for a day that does not exist."""
    day = _day(part["y"], part["m"], part["d"])
    if date_only:
        return F.date_format(day, "yyyy-MM-dd")

    def with_clock(d: Column) -> Column:
        midnight = d.cast("timestamp")
        timed = let(F.timestamp_seconds(F.unix_seconds(midnight) + _clock(part["rest"]) * 60),
                    lambda local: F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), _offset(local, zone)))
        return F.coalesce(F.when(part["rest"].rlike(r"\d"), timed), _instant(midnight, False))

    return let(day, with_clock)


def datetime_text(text: Column, country: Column | None = None, now: Column | None = None, date_only: bool = False,
                  given: Column | None = None) -> Column:
    """A date or date-time as ISO text.  `given` holds an epoch (seconds or milliseconds) when the raw value was a number."""
    country = F.lit(None).cast("string") if country is None else country
    now = F.current_timestamp() if now is None else now
    given = F.lit(None).cast("double") if given is None else given
    zone = look_up(_ZONES, F.upper(country))
    epoch = F.timestamp_micros((given / F.when(given > 1e11, 1000).otherwise(1) * 1000000).cast("bigint"))

    def parsed(t: Column) -> Column:
        low = F.lower(t)
        year_first, cjk = ([F.regexp_extract(t, p, i) for i in (1, 2, 3)] for p in (K.DATE_YEAR_FIRST, K.DATE_CJK))
        return let(_kind(t, low), lambda kind: (
            F.when(kind == "iso", _iso(t, zone, date_only))
            .when(kind == "today", _instant(now, date_only))
            .when(kind == "yesterday", _instant(F.timestamp_seconds(F.unix_seconds(now) - 86400), date_only))
            .when(kind == "ago", _instant(_ago(low, now), date_only))
            .otherwise(let(F.when(kind == "ymd", _part(*year_first, _tail(t, K.DATE_YEAR_FIRST)))
                           .when(kind == "dmy", _numeric_last(t, country))
                           .when(kind == "cjk", _part(*cjk, _tail(t, K.DATE_CJK)))
                           .when(kind == "named", _worded(t, now)),
                           lambda part: F.when(part.isNotNull(), _found(part, zone, date_only))))))

    trimmed = F.when(beyond_ascii(text), F.translate(text, K.ARABIC_FROM, K.ARABIC_TO)).otherwise(text)
    return F.when(given.isNotNull(), _instant(epoch, date_only)).when(text.isNotNull(), let(F.trim(trimmed), parsed))
