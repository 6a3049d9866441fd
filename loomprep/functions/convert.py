"""Conversions that turn what cannot be read into NULL instead of failing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomprep.functions.columns import col, field, is_numeric, is_string, is_temporal, with_column

# A cast alone would also take '1d', '1f', 'NaN' and hexadecimal floats.
NUMBER = r"^[+-]?(?=[.]?[0-9])[0-9]*[.]?[0-9]*([eE][+-]?[0-9]+)?$"
# A cast alone would also take 'now', 'epoch', '12:30' and a bare year.
CLOCK = r"(?:[ T](\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,9})?)?\s?(?:Z|[+-]\d{2}(?::?\d{2})?)?))?$"
YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + CLOCK
YEAR_LAST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + CLOCK
COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
SHORT_YEAR = r"^(\d{1,2}[-/.]\d{1,2}[-/.])(\d{2})(?=[ T]|$)"
HALF_DAY = r"(?i)[ T](1[0-2]|0?[1-9])(:\d{2})?(:\d{2})?\s?([ap])\.?m\.?$"
# The months by their first three letters.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH_NAME = (
    r"(?i)(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
    r"|nov(?:ember)?|dec(?:ember)?)\.?"
)
MONTH_FIRST = rf"^({MONTH_NAME})[ -](\d{{1,2}})(?:st|nd|rd|th)?,?[ -](\d{{4}})(?=[ T]|$)"
MONTH_SECOND = rf"^(\d{{1,2}})(?:st|nd|rd|th)?[ -]({MONTH_NAME}),?[ -](\d{{4}})(?=[ T]|$)"
# How every date begins, in one look: most texts are settled by it. None is longer than LONGEST_DATE.
POSSIBLE = r"^(?:\d{8}$|\d{1,4}[-/.]\d|\d{1,2}(?:st|nd|rd|th|ST|ND|RD|TH|St|Nd|Rd|Th|sT|nD|rD|tH)?[ -][A-Za-z]|[A-Za-z]{3,9}\.?[ -]\d)"
LONGEST_DATE = 64
# Two-digit years from this one on belong to the last century.
CENTURY = 69

# The words read as true and false, in lower case.
TRUE_WORDS = ("true", "1", "yes")
FALSE_WORDS = ("false", "0", "no")


def numeric_value(value: Column, data_type: T.DataType) -> Column:
    """``value`` as DOUBLE; NULL where it is not a number."""
    if is_numeric(data_type) or isinstance(data_type, T.BooleanType):
        return value.cast("double")
    if is_string(data_type):
        text = F.trim(value)
        return F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.lit(None).cast("double")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once and stands once in the plan, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _plain_day(text: Column) -> Column:
    """Month names, two-digit years and compact dates written as numbers; other texts as they are."""

    def named(pattern: str, month: int, day: int) -> Column:
        name = F.lower(F.substring(F.regexp_extract(text, pattern, month), 1, 3))
        number = ((F.position(name, F.lit(MONTHS)) + 2) / 3).cast("int").cast("string")
        rest = F.regexp_replace(text, pattern, "")
        return F.concat(F.regexp_extract(text, pattern, 3), F.lit("-"), number, F.lit("-"), F.regexp_extract(text, pattern, day), rest)

    year = F.regexp_extract(text, SHORT_YEAR, 2)
    century = F.when(year >= str(CENTURY), "19").otherwise("20")
    longer = F.concat(F.regexp_extract(text, SHORT_YEAR, 1), century, year, F.regexp_replace(text, SHORT_YEAR, ""))
    return (
        F.when(text.rlike(COMPACT), F.regexp_replace(text, COMPACT, "$1-$2-$3"))
        .when(text.rlike(SHORT_YEAR), longer)
        .when(text.rlike(MONTH_FIRST), named(MONTH_FIRST, 1, 2))
        .when(text.rlike(MONTH_SECOND), named(MONTH_SECOND, 2, 1))
        .otherwise(text)
    )


def _plain_clock(date: Column) -> Column:
    """A half-day clock at the end of a date written over the whole day."""
    hour = F.regexp_extract(date, HALF_DAY, 1).try_cast("int") % 12
    hour = hour + F.when(F.lower(F.regexp_extract(date, HALF_DAY, 4)) == "p", 12).otherwise(0)
    minutes = F.regexp_extract(date, HALF_DAY, 2)
    clock = F.concat(F.lit(" "), hour.cast("string"), F.when(minutes == "", ":00").otherwise(minutes), F.regexp_extract(date, HALF_DAY, 3))
    return F.when(date.rlike(HALF_DAY), F.concat(F.regexp_replace(date, HALF_DAY, ""), clock)).otherwise(date)


def datetime_value(value: Column, data_type: T.DataType) -> Column:
    """``value`` as TIMESTAMP; NULL where it is not a date."""
    if is_temporal(data_type):
        return value.cast("timestamp")
    if not is_string(data_type):
        return F.lit(None).cast("timestamp")

    def read(text: Column) -> Column:
        # A text of another shape fails at its first characters. With the year last, the month is tried first.
        def moment(pattern: str, order: str) -> Column:
            return F.regexp_replace(text, pattern, order).try_cast("timestamp")

        last = F.coalesce(moment(YEAR_LAST, "$3-$1-$2 $4"), moment(YEAR_LAST, "$3-$2-$1 $4"))
        return F.when(text.rlike(YEAR_FIRST), moment(YEAR_FIRST, "$1-$2-$3 $4")).when(text.rlike(YEAR_LAST), last)

    whole = F.trim(value)
    found = _bound(whole, lambda text: _bound(_plain_day(text), lambda date: _bound(_plain_clock(date), read)))
    return F.when((F.length(whole) <= LONGEST_DATE) & whole.rlike(POSSIBLE), found)


def boolean_value(value: Column) -> Column:
    """true / 1 / yes and false / 0 / no in any case; anything else is NULL."""
    word = F.lower(value.cast("string"))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def convert_column(df: DataFrame, column: str, target: str) -> DataFrame:
    """Replace ``column`` by its reading as numeric, datetime, boolean or categorical (text)."""
    data_type = field(df, column).dataType
    value = col(column)
    if target == "numeric":
        return with_column(df, column, numeric_value(value, data_type))
    if target == "datetime":
        return with_column(df, column, datetime_value(value, data_type))
    if target == "boolean":
        return with_column(df, column, boolean_value(value))
    if target == "categorical":
        return with_column(df, column, value.cast("string"))
    return df
