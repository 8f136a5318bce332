"""Small column expressions on numbers, dates and categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def first_match(branches: Sequence[tuple[Column, object]], default=None) -> Column:
    """The value of the first branch (condition, value) that holds, else `default`."""
    out = F.lit(default)
    for condition, value in reversed(branches):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def hour_of(ts: ColumnOrName) -> Column:
    return F.hour(as_column(ts))


def days_between(earlier: ColumnOrName, later: ColumnOrName) -> Column:
    """Whole calendar days from `earlier` to `later`."""
    return F.datediff(as_column(later), as_column(earlier))


def month_start(as_of: Column | date | datetime | str | None = None) -> Column:
    """First day of the month of `as_of`; today when not given. Text is read as a date."""
    if as_of is None:
        moment = F.current_date()
    elif isinstance(as_of, Column):
        moment = as_of
    else:
        moment = F.lit(str(as_of)).cast("date")
    return F.trunc(moment, "month")


def parse_timestamp(text: ColumnOrName) -> Column:
    """Zone-less timestamp of a text, NULL when the text is not one."""
    return as_column(text).try_cast("timestamp_ntz")


def round2(x: ColumnOrName) -> Column:
    return F.round(as_column(x), 2)


def floor_div(x: ColumnOrName, divisor: int) -> Column:
    value, by = as_column(x), F.lit(divisor)
    return F.call_function("div", value - F.pmod(value, by), by)


def default_if_empty(x: ColumnOrName, value) -> Column:
    """`value` where a text is NULL or empty, or another column is NULL."""
    if isinstance(value, str):
        return F.coalesce(F.nullif(as_column(x), F.lit("")), F.lit(value))
    return F.coalesce(as_column(x), F.lit(value))


def map_labels(x: ColumnOrName, mapping: Mapping, default=None) -> Column:
    """Value by value replacement; values without an entry become `default`."""
    return first_match([(as_column(x) == F.lit(key), label) for key, label in mapping.items()], default)


def map_role(sender: ColumnOrName, other: str = "assistant") -> Column:
    """"user" for users, `other` ("assistant" or "ai") for every other sender."""
    return F.when(as_column(sender) == "user", F.lit("user")).otherwise(F.lit(other))


# Fixed bins of the age chart: label, lowest and highest age.
AGE_BINS = (
    ("18-25", 18, 25),
    ("26-35", 26, 35),
    ("36-45", 36, 45),
    ("46-55", 46, 55),
    ("56-65", 56, 65),
    ("66+", 66, None),
)
UNKNOWN_AGE = "Unknown"


def age_bin(age: ColumnOrName) -> Column:
    years = as_column(age)
    branches = [
        (years >= low if high is None else years.between(low, high), label) for label, low, high in AGE_BINS
    ]
    return first_match(branches, UNKNOWN_AGE)


def age_bin_rank(label: ColumnOrName) -> Column:
    """Place of an age label on the axis; labels off the axis give 0."""
    names = F.array(*[F.lit(b[0]) for b in AGE_BINS])
    return F.array_position(names, as_column(label)).cast("int")


def in_set(x: ColumnOrName, values: Sequence) -> Column:
    return as_column(x).isin(*values)


def length_between(x: ColumnOrName, low: int | None = None, high: int | None = None) -> Column:
    size = F.length(as_column(x))
    ok = F.lit(True)
    if low is not None:
        ok = ok & (size >= low)
    if high is not None:
        ok = ok & (size <= high)
    return ok


def axis_text(number: ColumnOrName) -> Column:
    return as_column(number).cast("string")


def fmt_number(x: ColumnOrName, digits: int = 3) -> Column:
    """Number with thousands separators and up to `digits` decimals, no trailing zeros."""
    text = F.format_number(as_column(x).cast("double"), digits)
    if digits == 0:
        return text
    return F.regexp_replace(text, r"\.?0+$", "")


def fmt_currency(x: ColumnOrName, symbol: str = "$") -> Column:
    return F.concat(F.lit(symbol), fmt_number(x))


def new_id() -> Column:
    return F.uuid()


def now() -> Column:
    return F.current_timestamp()
