"""Dates as sources write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of two scripts and month names (fixed values).
DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
MONTHS = {"يناير": "01", "فبراير": "02", "مارس": "03", "أبريل": "04", "ابريل": "04", "مايو": "05", "يونيو": "06", "يوليو": "07", "أغسطس": "08", "اغسطس": "08", "سبتمبر": "09", "أكتوبر": "10", "اكتوبر": "10", "نوفمبر": "11", "ديسمبر": "12"}
#: What stands between a date's parts, a time that may follow, and the zone of a time without one (fixed values).
BETWEEN, TIME, ZONE = r"[-/.\s]", r"(?:[ T\s–—-]+(\d{1,2}):(\d{2}))?", "+03:00"


#: English month names, as web and feed dates write them (fixed values).
ENGLISH = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def english_date(text: Column) -> Column:
    """``Tue, 02 Jan 2024 03:04:05 GMT``, ``2 January 2024`` or ``January 5, 2024 10:00``; a time without a zone counts as UTC."""
    clock, zone = r"(?:[,\s]+(\d{1,2}):(\d{2})(?::(\d{2}))?)?", r"\s*(?:(?:GMT|UTC|Z|UT)|([+-]\d{2}):?(\d{2}))?"
    weekday = r"^(?i:(?:sun|mon|tue|wed|thu|fri|sat)[a-z]*,?\s+)?"
    day_month = weekday + r"(\d{1,2})[\s-]+([A-Za-z]{3})[a-z]*\.?,?[\s-]+(\d{4})" + clock + zone + "$"
    month_day = weekday + r"([A-Za-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})" + clock + zone + "$"

    def moment(pattern: str, day: int, month: int) -> Column:
        part = lambda i: F.regexp_extract(text, pattern, i)
        or_zero = lambda i: F.lpad(F.when(part(i) == "", "00").otherwise(part(i)), 2, "0")
        number = F.array_position(F.array(*map(F.lit, ENGLISH)), F.lower(part(month)))
        offset = F.when(part(7) == "", "+00:00").otherwise(F.concat(part(7), F.lit(":"), part(8)))
        date = F.concat_ws("-", part(3), F.lpad(number.cast("string"), 2, "0"), F.lpad(part(day), 2, "0"))
        return F.concat(date, F.lit("T"), F.concat_ws(":", or_zero(4), or_zero(5), or_zero(6)), offset).try_cast("timestamp")

    return F.when(text.rlike(day_month), moment(day_month, 1, 2)).when(text.rlike(month_day), moment(month_day, 2, 1))


def source_date(value: Column) -> Column:
    """The moment that a source's text names (DT-5), null if it names none.

    Epoch seconds or milliseconds; a date with the year first, else with the day first, the zone and
    seconds of which don't count; else an English date, as feeds have it, or what a cast to a timestamp
    reads. A time alone names no moment.
    """
    text = F.trim(F.translate(value, DIGITS, "0123456789" * 2))
    named = text
    for name, number in MONTHS.items():
        named = F.replace(named, F.lit(name), F.lit(number))

    def moment(pattern: str, year: int, day: int) -> Column:
        part = lambda i: F.regexp_extract(named, pattern, i)
        two = lambda c: F.lpad(c, 2, "0")
        clock = F.concat(two(part(4)), F.lit(":"), F.when(part(5) == "", "00").otherwise(part(5)), F.lit(":00" + ZONE))
        return F.concat(part(year), F.lit("-"), two(part(2)), F.lit("-"), two(part(day)), F.lit("T"), clock).try_cast("timestamp")

    year_first = rf"(20\d{{2}}){BETWEEN}(\d{{1,2}}){BETWEEN}(\d{{1,2}}){TIME}"
    day_first = rf"(\d{{1,2}}){BETWEEN}(\d{{1,2}}){BETWEEN}(20\d{{2}}){TIME}"
    epoch = F.timestamp_millis(text.try_cast("long") * F.when(F.length(text) == 10, 1000).otherwise(1))
    return (
        F.when(text.rlike(r"^\d{10,13}$"), epoch)
        .when(named.rlike(year_first), moment(year_first, 1, 3))
        .when(named.rlike(day_first), moment(day_first, 3, 1))
        .when(named.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?$"), F.concat(named, F.when(F.length(named) == 16, ":00").otherwise(""), F.lit(ZONE)).try_cast("timestamp"))
        .when(named.rlike("[A-Za-z]{3}") & ~named.rlike(r"^\d{4}-"), english_date(named))
        .when(named.rlike(r"^\d{4}"), named.try_cast("timestamp"))
    )
