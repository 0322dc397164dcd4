"""Event time from text, as one struct-valued Column expression.

Absolute dates come first (day-month-year, month-day-year, month-year, year); relative
expressions need the time at which the text was said. An absolute date that the
calendar does not have resolves to nothing. Ranges are inclusive to the second.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions.text import col

# Month and weekday names, and number words (fixed values).
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
# Confidence of each kind of expression (fixed values).
DAY, MONTH, YEAR, NEAR_DAY, AGO = 0.95, 0.90, 0.85, 0.95, {"day": 0.90, "week": 0.80, "month": 0.75, "year": 0.70}
LAST, THIS, NEXT, WEEKDAY = {"week": 0.70, "month": 0.70, "year": 0.65}, 0.70, 0.55, 0.60

# Patterns of dates (fixed values).
DMY = r"\b(\d{1,2})\s+([a-z]+)\.?,?\s+(\d{4})\b"
MDY = r"\b([a-z]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"
MY = r"\b([a-z]+)\.?,?\s+(\d{4})\b"
YEAR_ALONE = r"\b(19\d{2}|20\d{2})\b"
AGO_RE = r"\b(\d+|a|an|one|two|three|four|five|six|seven|eight|nine|ten)\s+(day|week|month|year)s?\s+ago\b"


def month_number(name: Column) -> Column:
    """The month of a full or abbreviated name, else null."""
    names = {n: i + 1 for i, n in enumerate(MONTHS)} | {n[:3]: i + 1 for i, n in enumerate(MONTHS)} | {"sept": 9}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), name)


def _range(start: Column, unit: str, granularity: str, confidence: float, text: Column) -> Column:
    ends = {"day": "1 day", "week": "7 days", "month": "1 month", "year": "1 year"}
    start = start.cast("timestamp")
    return F.when(start.isNotNull(), F.struct(start.alias("start"), (start + F.expr(f"interval {ends[unit]}") - F.expr("interval 1 second")).alias("end"), F.lit(granularity).alias("granularity"), F.lit(confidence).alias("confidence"), text.alias("text")))


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def absolute(t: Column) -> Column:
    part = lambda p, i: F.regexp_extract(t, p, i)
    dmy, mdy, my = month_number(part(DMY, 2)), month_number(part(MDY, 1)), month_number(part(MY, 1))
    return (
        F.when(dmy.isNotNull(), _range(_date(part(DMY, 3), dmy, part(DMY, 1)), "day", "day", DAY, part(DMY, 0)))
        .when(mdy.isNotNull(), _range(_date(part(MDY, 3), mdy, part(MDY, 2)), "day", "day", DAY, part(MDY, 0)))
        .when(my.isNotNull(), _range(_date(part(MY, 2), my, F.lit("1")), "month", "month", MONTH, part(MY, 0)))
        .when(t.rlike(YEAR_ALONE), _range(_date(part(YEAR_ALONE, 1), F.lit("1"), F.lit("1")), "year", "year", YEAR, part(YEAR_ALONE, 1)))
    )


def is_absolute(t: Column) -> Column:
    """Whether an absolute pattern decides, be its date valid or not."""
    return month_number(F.regexp_extract(t, DMY, 2)).isNotNull() | month_number(F.regexp_extract(t, MDY, 1)).isNotNull() | month_number(F.regexp_extract(t, MY, 1)).isNotNull() | t.rlike(YEAR_ALONE)


def relative(t: Column, said: Column) -> Column:
    day = said.cast("date")
    monday, month, year = F.trunc(day, "week"), F.trunc(day, "month"), F.trunc(day, "year")
    raw = F.regexp_extract(t, AGO_RE, 1)
    n = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in NUMBERS.items() for x in p]), raw), raw.try_cast("int"))
    unit, ago = F.regexp_extract(t, AGO_RE, 2), F.regexp_extract(t, AGO_RE, 0)
    out = F.when(t.rlike(r"\byesterday\b"), _range(F.date_sub(day, 1), "day", "day", NEAR_DAY, F.lit("yesterday"))).when(t.rlike(r"\btoday\b"), _range(day, "day", "day", NEAR_DAY, F.lit("today")))
    starts = {"day": F.date_sub(day, n), "week": F.trunc(F.date_sub(day, n * 7), "week"), "month": F.add_months(month, -n), "year": F.add_months(year, n * -12)}
    for u, start in starts.items():
        out = out.when(unit == u, _range(start, u, u, AGO[u], ago))
    for word, shift, confidence in (("last", -1, LAST), ("this", 0, dict.fromkeys(LAST, THIS)), ("next", 1, dict.fromkeys(LAST, NEXT))):
        found = F.regexp_extract(t, rf"\b{word}\s+(week|month|year)\b", 1)
        for u, start in (("week", F.date_add(monday, 7 * shift)), ("month", F.add_months(month, shift)), ("year", F.add_months(year, 12 * shift))):
            out = out.when(found == u, _range(start, u, u, confidence[u], F.lit(f"{word} {u}")))
    names = "|".join(WEEKDAYS)
    last = F.regexp_extract(t, rf"\blast\s+({names})\b", 1)
    name = F.when(last != "", last).otherwise(F.regexp_extract(t, rf"\b({names})\b", 1))
    text = F.when(last != "", F.regexp_extract(t, rf"\blast\s+({names})\b", 0)).otherwise(name)
    index = F.try_element_at(F.create_map(*[F.lit(x) for i, w in enumerate(WEEKDAYS) for x in (w, i)]), name)
    back = F.pmod(F.weekday(day) - index, F.lit(7))
    return out.when(index.isNotNull(), _range(F.date_sub(day, F.when(back == 0, 7).otherwise(back)), "day", "day", WEEKDAY, text))


def event_time(text: Column | str, said: Column | str) -> Column:
    """struct(start, end, granularity, confidence, text), or null."""
    t, said = F.lower(col(text)), col(said)
    return F.when(is_absolute(t), absolute(t)).when(said.isNotNull(), relative(t, said))


def iso_time(x: Column | str) -> Column:
    """An ISO date or time, with T or a blank, with Z, an offset or none (UTC), in quotes or not; else null."""
    text = F.trim(F.btrim(F.trim(col(x)), F.lit("\"'")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"), F.try_to_timestamp(F.replace(text, F.lit(" "), F.lit("T"))))


def session_date(x: Column | str) -> Column:
    """The day of a session's title: day month year, else month day year; a first form of no known month gives way, one without such a day is null."""
    low = F.lower(col(x))

    def made(pattern: str, day: int, name: int) -> tuple[Column, Column]:
        part = lambda i: F.regexp_extract(low, pattern, i)
        month = month_number(part(name))
        date = F.try_to_timestamp(F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(day), 2, "0")), F.lit("yyyy-MM-dd"))
        return month.isNotNull(), date

    first, second = made(r"(\d{1,2})\s+([a-z]+),?\s+(\d{4})", 1, 2), made(r"([a-z]+)\s+(\d{1,2}),?\s+(\d{4})", 2, 1)
    return F.when(first[0], first[1]).when(second[0], second[1]).cast("date")


def unix_time(x: Column | str, now: Column) -> Column:
    """Seconds since 1970 as a time; nothing and zero are ``now``."""
    return F.when(F.coalesce(col(x), F.lit(0)) == 0, now).otherwise(F.timestamp_seconds(col(x)))
