"""Column expressions that normalize ids, numbers and dates arriving as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.schema import MISSING_TEXT

WHITESPACE = " \t\n\r\x0b\x0c"

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

_SIGN = r"\s*[-/., ]\s*"
_CLOCK = r"(?:(?:T|\s)\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*(?:([AaPp])\.?[Mm]\.?)?)?"
# Three numbers, or the name of a month among two; then a time of day or nothing.
_IN_NUMBERS = rf"^(\d{{1,4}}){_SIGN}(\d{{1,2}}){_SIGN}(\d{{1,4}}){_CLOCK}$"
_WITH_NAME = rf"^(?:(\d{{1,4}}){_SIGN})?([A-Za-z]{{3,9}}){_SIGN}(\d{{1,4}})(?:{_SIGN}(\d{{4}}))?{_CLOCK}$"


def strip(text: Column) -> Column:
    return F.btrim(text.cast("string"), F.lit(WHITESPACE))


# The rules below look at their column once: an expression used twice is computed twice when a
# filter is moved below the projection that defines it.


def is_missing(value: Column, dtype: T.DataType, tokens: list[str] = MISSING_TEXT) -> Column:
    """Null, NaN, or one of the texts that stand for "no value"."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    spelled = value.cast("string").rlike(rf"(?i)^\s*({'|'.join(tokens)})\s*$")
    return F.coalesce(spelled, F.lit(True))


def clean_id(value: Column, dtype: T.DataType) -> Column:
    """Identifier text: ``1001.0`` becomes ``1001``; ``00123`` and ``1E5`` stay as they are."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = value == F.floor(value)
        text = F.when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(
            value.cast("string")
        )
    elif isinstance(dtype, T.StringType):
        text = F.regexp_replace(value, r"^\s+|\.0+\s*$|\s+$", "")
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def clean_number(value: Column, dtype: T.DataType) -> Column:
    """Number from text with currency signs, thousands separators or accounting brackets."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nullif(value.cast("double"), F.lit(float("nan")))
    if isinstance(dtype, T.NumericType):
        return value.cast("double")
    signed = F.regexp_replace(value, r"^\s*\(\s*(.*?)\s*\)\s*$", "-$1")
    return F.regexp_replace(signed, r"[^0-9.\-]", "").try_cast("double")


def parse_date(value: Column, dtype: T.DataType, day_first: bool = False) -> Column:
    """Wall-clock timestamp, or null for text that is not a date.

    Besides ISO forms: ``12/31/2010 8:26 PM`` and the like with ``/``, ``-`` or ``.``, the year first or last (of
    two digits, too), ``20101231``, ``Dec 31, 2010``, ``31-Dec-2010 08:26``. Of two numbers before a year the first is
    the month, with ``day_first`` the day; where only the other reading is a date, that one holds.
    The session's time zone plays no part."""
    if isinstance(dtype, T.TimestampNTZType):
        return value
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return value.cast("timestamp_ntz")
    text = strip(value)
    compact = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    iso = F.when(compact.rlike(r"^\d{4}(\D|$)"), compact.try_cast("timestamp_ntz"))

    def numbers(p: Column) -> Column:
        year_first = F.length(p[0]) == 4
        year = F.when(year_first, p[0]).otherwise(p[2])
        one, other = F.when(year_first, p[1]).otherwise(p[0]), F.when(year_first, p[2]).otherwise(p[1])
        usual, swapped = _timestamp(year, one, other, p, 3), _timestamp(year, other, one, p, 3)
        month_first = F.coalesce(usual, F.when(~year_first, swapped))
        return F.coalesce(F.when(~year_first, swapped), usual) if day_first else month_first

    def named(p: Column) -> Column:
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(p[1], 1, 3)))
        year = F.when(F.length(p[0]) == 4, p[0]).when(p[0] != "", p[2]).otherwise(p[3])
        day = F.when((p[0] == "") | (F.length(p[0]) == 4), p[2]).otherwise(p[0])
        return _timestamp(year, month.cast("string"), day, p, 4)

    return F.coalesce(iso, _matched(text, _IN_NUMBERS, 7, numbers), _matched(text, _WITH_NAME, 8, named))


def _matched(text: Column, pattern: str, groups: int, build) -> Column:
    """``build`` of the groups of ``pattern`` (empty where a group is absent); null if it does not match."""
    parts = F.split(F.regexp_replace(text, pattern, "|".join(f"${i + 1}" for i in range(groups))), r"\|", -1)
    # A lambda binds the parts, so that the pattern is applied once.
    return F.when(text.rlike(pattern), F.transform(F.array(parts), build)[0])


def _timestamp(year: Column, month: Column, day: Column, parts: Column, clock: int) -> Column:
    """Timestamp of a date and the time of day in four ``parts`` from ``clock`` on."""
    number = year.try_cast("int")
    # Two digits: 69 to 99 are of the last century, as in POSIX.
    full = F.when(F.length(year) == 4, number).when(
        F.length(year) == 2, number + F.when(number >= 69, 1900).otherwise(2000)
    )
    hour, minute, second = (F.coalesce(parts[clock + i].try_cast("int"), F.lit(0)) for i in range(3))
    half = F.lower(parts[clock + 3])
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    numbers = [full, month.try_cast("int"), day.try_cast("int"), hour, minute, second]
    known = numbers[0].isNotNull() & numbers[3].isNotNull()
    return F.when(known, F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *numbers).try_cast("timestamp_ntz"))


def is_cancellation(invoice_no: Column, trimmed: bool = False) -> Column:
    """Invoice starting with C; ``trimmed`` ignores leading whitespace."""
    pattern = r"^\s*[cC]" if trimmed else "^[cC]"
    return F.coalesce(invoice_no.cast("string").rlike(pattern), F.lit(False))


# Amounts are added up as decimals: exactly, and independent of row order. Eight digits after the point keep
# a millionth of a cent and leave out the noise that a product of doubles has beyond them.
AMOUNT = "decimal(38,8)"


def exact(amount: Column) -> Column:
    return amount.cast(AMOUNT)


def exact_sum(amount: Column) -> Column:
    """Sum of amounts; overflow is an error, not a wrap."""
    return F.sum(exact(amount)).cast("double")


def round_to(value: Column, digits: int) -> Column:
    """Round the scaled double half to even, as array libraries do."""
    return F.rint(value.cast("double") * float(10**digits)) / float(10**digits)


def exact_mean(value: Column) -> Column:
    """Mean of amounts from their exact sum."""
    return exact_sum(value) / F.count(value)
