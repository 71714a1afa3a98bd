"""Dates, weekdays and times in free text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import fixed_values as V
from lectern.functions.common import any_case, matches


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date from its parts, null when there is no such day. Compared, not parsed: a failed parse costs far more."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when(month.between(1, 12) & day.between(1, last), F.make_date(year, month, day))


def parse_date(text: Column, default_year: Column) -> Column:
    """The first date stated in a text: ISO, then US m/d[/y], then 'Mon d'."""
    text = F.coalesce(text, F.lit(""))

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, any_case(pattern), group).try_cast("int")

    iso = _date(*[number(V.ISO_DATE, i) for i in (1, 2, 3)])
    # an empty text is no number, but a cast finds that out by an exception
    given = F.regexp_extract(text, any_case(V.US_DATE), 3)
    year = F.coalesce(F.when(given != "", given.try_cast("int")), default_year)
    year = F.when(year < 100, year + 2000).otherwise(year)
    us = _date(year, number(V.US_DATE, 1), number(V.US_DATE, 2))
    months = F.create_map(*[F.lit(x) for i, name in enumerate(V.MONTHS, 1) for x in (name, i)])
    name = F.substring(F.lower(F.regexp_extract(text, any_case(V.MONTH_DAY), 1)), 1, 3)
    named = _date(default_year, F.try_element_at(months, name), number(V.MONTH_DAY, 2))
    return (
        F.when(F.contains(text, F.lit("-")) & matches(text, V.ISO_DATE), iso)
        .when(F.contains(text, F.lit("/")) & matches(text, V.US_DATE), us)
        .when(matches(text, V.MONTH_DAY), named)
    )


def expand_week(week: Column, term_start: Column, days: Column) -> Column:
    """Meeting dates of a numbered week, oldest first; week 1 holds the term start."""
    monday = F.date_add(F.date_trunc("week", term_start).cast("date"), (week - 1) * 7)
    index = F.create_map(*[F.lit(x) for pair in V.WEEKDAY_INDEX.items() for x in pair])
    dates = F.transform(
        days, lambda d: F.date_add(monday, F.try_element_at(index, F.substring(F.lower(F.trim(d)), 1, 9)))
    )
    return F.array_sort(F.filter(dates, lambda d: d.isNotNull() & (d >= term_start)))


def row_kind(text: Column) -> Column:
    return F.when(matches(text, V.EXAM), "exam").when(matches(text, V.DUE), "due").otherwise("lecture")


def is_holiday(text: Column) -> Column:
    return matches(text, V.HOLIDAY)


def meeting_days(raw: Column) -> Column:
    """'MW', 'Mon/Wed' or 'TR' as 'MO,WE' or 'TU,TH'."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    parts = F.split(F.lower(text), r"[\s/,&]+")
    names = F.create_map(*[F.lit(x) for pair in V.DAY_WORDS.items() for x in pair])

    def known(codes: Column) -> Column:
        return F.array_distinct(F.filter(codes, lambda c: c.isNotNull()))

    by_word = known(F.transform(parts, lambda p: F.try_element_at(names, p)))
    compact = F.upper(text)
    for pair, letter in (("TH", "R"), ("TU", "T"), ("SU", "U"), ("SA", "A")):
        compact = F.replace(compact, F.lit(pair), F.lit(letter))
    letters = F.create_map(*[F.lit(x) for pair in V.DAY_LETTERS.items() for x in pair])
    by_letter = known(F.transform(F.split(compact, ""), lambda c: F.try_element_at(letters, c)))
    worded = (F.size(parts) > 1) | F.map_contains_key(names, F.element_at(parts, 1))
    return F.when(text == "", "").otherwise(
        F.array_join(F.when(worded & (F.size(by_word) > 0), by_word).otherwise(by_letter), ",")
    )


def clock_time(raw: Column) -> Column:
    """'2:00 pm' or '14:00' as 'HH:MM'; anything else is empty."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    spoken, plain = r"(?i)^(\d{1,2}):?(\d{2})?\s*([ap])\.?m?\.?$", r"^(\d{1,2}):(\d{2})$"
    hour = F.regexp_extract(text, spoken, 1).try_cast("int") % 12
    hour = hour + F.when(F.lower(F.regexp_extract(text, spoken, 3)) == "p", 12).otherwise(0)
    minute = F.regexp_extract(text, spoken, 2)
    return (
        F.when(text.rlike(spoken), F.concat(F.format_string("%02d:", hour), F.when(minute == "", "00").otherwise(minute)))
        .when(
            text.rlike(plain),
            F.concat(
                F.format_string("%02d:", F.regexp_extract(text, plain, 1).try_cast("int")), F.regexp_extract(text, plain, 2)
            ),
        )
        .otherwise("")
    )
