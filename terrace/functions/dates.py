"""Mixed-format date parsing and user date formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace.functions.text import let, strip

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH_WORD = (
    r"(?i)(?<![a-z])(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?"
    r"|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z])\.?"
)
_DAY = r"(0?[1-9]|[12]\d|3[01])"
_MONTH = r"(0?[1-9]|1[0-2])"
_END = r"(?=$|[T ,])"


# What every date starts with: digits and a digit or month, a month and a digit, or bare digits.
_NAMES = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_LOOKS = (
    r"(?i)^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
    rf"(?:\d{{1,4}}(?:st|nd|rd|th)?(?:[-/., ]+(?:\d|{_NAMES})|{_NAMES})"
    rf"|{_NAMES}[a-z]*[-/., ]*\d|\d{{8}}(?!\d)|\d{{4}}$)"
)


def _in_turn(value: Column, *steps: tuple[str, str]) -> Column:
    for pattern, replacement in steps:
        value = F.regexp_replace(value, pattern, replacement)
    return value


# Two-digit years, marked with Y until here: 00-68 are 20xx.
_CENTURY = ((r"^Y(?=[0-5]\d-|6[0-8]-)", "20"), (r"^Y(?=\d\d-)", "19"), (r"^Y", ""))


def _spelled_months(text: Column) -> Column:
    """Dates with a month name, put in year-month-day order."""
    bare = F.regexp_replace(text, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+", "")
    start = F.translate(
        F.substring(F.regexp_extract(text, _MONTH_WORD, 1), 1, 3), _UPPER, _UPPER.lower()
    )
    number = F.lpad((F.floor((F.instr(F.lit(_MONTHS), start) + 2) / 3)).cast("string"), 2, "0")
    marked = F.regexp_replace(bare, F.lit(_MONTH_WORD), F.concat(F.lit("M"), number))
    ordinal = r"(?:st|nd|rd|th)?"
    return _in_turn(
        marked,
        (rf"(?i)^{_DAY}{ordinal}[-/., ]*M(\d\d)[-/., ]*(\d{{4}}|\d\d){_END}", "Y$3-$2-$1"),
        (rf"(?i)^M(\d\d)[-/., ]*{_DAY}{ordinal}[-/., ]+(\d{{4}}|\d\d){_END}", "Y$3-$1-$2"),
        (rf"(?i)^(\d{{4}})[-/., ]*M(\d\d)[-/., ]*{_DAY}{ordinal}{_END}", "$1-$2-$3"),
        (r"^M(\d\d)[-/., ]*(\d{4})$", "$2-$1-01"),
        *_CENTURY,
    )


def parse_date(text: Column, day_first: bool = True) -> Column:
    """Text in mixed formats to a zone-less timestamp; null where it is no date.

    Reads year-first, day-first (month-first on request, and where day-first cannot be), spelled
    months, compact ``yyyyMMdd``, month or year alone, two-digit years, and an optional time with
    fraction, am/pm or zone. Zoned values are moved to the session zone.

    The first matching family rewrites the value in year-month-day order; Spark's own cast reads it.
    """
    return let(strip(text), lambda value: date_in(value, day_first))


def date_in(value: Column, day_first: bool = True) -> Column:
    """``parse_date`` for text that is already stripped and computed."""
    sides = [(rf"{_DAY}[-/. ]{_MONTH}", "$2-$1"), (rf"{_MONTH}[-/. ]{_DAY}", "$1-$2")]
    if not day_first:
        sides.reverse()
    ordered = F.when(~value.rlike(_LOOKS), F.lit(None))
    ordered = ordered.when(value.rlike(r"^\d{4}-\d\d?-\d\d?(?![^T ])"), value)
    for pair, order in sides:
        pattern = rf"^{pair}[-/. ](\d{{4}}){_END}"
        ordered = ordered.when(value.rlike(pattern), F.regexp_replace(value, pattern, f"$3-{order}"))
    for pair, order in sides:
        pattern = rf"^{pair}[-/. ](\d\d){_END}"
        ordered = ordered.when(
            value.rlike(pattern), _in_turn(value, (pattern, f"Y$3-{order}"), *_CENTURY)
        )
    ordered = ordered.when(value.rlike(_MONTH_WORD), _spelled_months(value)).otherwise(
        _in_turn(
            value,
            (rf"^(\d{{4}})[-/.]{_MONTH}[-/.]{_DAY}{_END}", "$1-$2-$3"),
            (rf"^(\d{{4}})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01]){_END}", "$1-$2-$3"),
            (rf"^{_MONTH}[-/.](\d{{4}})$", "$2-$1-01"),
            (r"^(\d{4})$", "$1-01-01"),
        )
    )
    iso = F.regexp_replace(
        ordered, r"^(\d{4}-\d+-\d+)[T ,]+(\d\d?:\d\d.*?)(?i: ?[ap]m)?$", "$1 $2"
    )
    half = F.when(
        value.rlike(r"(?i)\D(?:0?[1-9]|1[01]):[\d:.]+ ?pm$"), F.expr("interval 12 hours")
    ).when(value.rlike(r"(?i)\D12:[\d:.]+ ?am$"), F.expr("interval -12 hours"))
    none = F.expr("interval 0 hours")
    shift = F.when(F.upper(F.right(value, F.lit(1))) == "M", F.coalesce(half, none)).otherwise(none)
    return (iso.try_cast("timestamp") + shift).cast("timestamp_ntz")


def spark_format(user_format: str | None) -> str | None:
    """User date format (``DD/MM/YYYY``, any case) in Spark pattern letters.

    ``mm`` means minutes only next to hours or seconds; otherwise it is the month.
    """
    if not user_format:
        return None
    text = user_format.strip().strip("\"'")
    timed = re.search("hh|ss", text, re.I) is not None

    def letters(found: re.Match) -> str:
        token = found.group(0)
        kind = token[0].lower()
        if kind == "m":
            return "mm" if timed and token == "mm" else "MM"
        return {"y": token.lower(), "d": "dd", "h": "HH", "s": "ss"}[kind]

    return re.sub(r"yyyy|yy|dd|mm|hh|ss", letters, text, flags=re.I)


def parse_with_format(text: Column, user_format: str) -> Column:
    """Text in one given format to a zone-less timestamp; null where it does not match.

    Delimited two-letter fields also take one digit.
    """
    pattern = spark_format(user_format)
    loose = re.sub(
        r"(?<![A-Za-z])(dd|MM|HH)(?![A-Za-z])", lambda m: m.group(0)[0], pattern
    )
    return F.try_to_timestamp(text, F.lit(loose)).cast("timestamp_ntz")
