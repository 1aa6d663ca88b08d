"""Scalar column expressions.  All are native Catalyst expressions (no UDF),
so they stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86400e6
# Julian day number of 1970-01-01 00:00 (noon-based day count).
UNIX_EPOCH_JULIAN_DAY = 2440587.5


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(start, end) -> Column:
    """Whole microseconds from ``start`` to ``end``.

    Zone-free timestamps are subtracted directly (a day-time interval of wall
    clock time); ``timestamp_diff`` would route them through the session
    time zone, which shifts values inside a daylight-saving gap."""
    iv = _c(end) - _c(start)
    return (iv.cast("interval second").cast("decimal(38,6)") * F.lit(1_000_000)).cast("long")


def days_between(start, end) -> Column:
    """Fractional days from ``start`` to ``end`` (negative if end is earlier)."""
    return micros_between(start, end) / F.lit(MICROS_PER_DAY)


def julian_day(ts) -> Column:
    """Timestamp as a (noon based) Julian day number, like SQLite julianday()."""
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return days_between(epoch, F.to_timestamp_ntz(_c(ts))) + F.lit(UNIX_EPOCH_JULIAN_DAY)


def parse_ts(c, fmt: str | None = None) -> Column:
    """String to zone-free timestamp.  Unparseable values become null.

    With a format, values that do not fit it fall back to the ISO form
    (a date-only pattern is used on full date-time strings in the source).
    The value is parsed straight to ``timestamp_ntz`` (no session time zone
    involved); the ``try_`` parse only decides which form applies, so bad
    input gives null instead of an error under ANSI mode."""
    s = _c(c).cast("string")

    def parsed(f):
        ok = (F.try_to_timestamp(s, F.lit(f)) if f else F.try_to_timestamp(s)).isNotNull()
        return F.when(ok, F.to_timestamp_ntz(s, F.lit(f)) if f else F.to_timestamp_ntz(s))

    return parsed(None) if fmt is None else F.coalesce(parsed(fmt), parsed(None))


def format_date(c) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd")


def hour_of_day(c) -> Column:
    return F.hour(_c(c))


def age_years(admit, dob, cap: float | None = None) -> Column:
    """Whole years between birth and admission: days/365 rounded half to even,
    sign removed.  ``cap`` optionally replaces ages above it."""
    age = F.abs(F.rint(days_between(dob, admit) / F.lit(365.0))).cast("int")
    if cap is not None:
        age = F.when(age > cap, F.lit(int(cap))).otherwise(age)
    return age


def ln0(c) -> Column:
    """Natural log where ln(0) is -inf (Spark's ln(0) is null)."""
    return F.when(_c(c) == 0, F.lit(float("-inf"))).otherwise(F.ln(_c(c)))


def hour_band(c) -> Column:
    """Hour of day to a named band; null hours fall into the last band."""
    h = _c(c)
    return (F.when(h <= 10, F.lit("EarlyMorning"))
            .when(h <= 12, F.lit("Morning"))
            .when(h <= 18, F.lit("Noon"))
            .otherwise(F.lit("Evening")))


def los_bin(c) -> Column:
    """Length of stay to 0..3.  Written as in the source: exactly 0.6 falls
    through to 3 (the first test is ``< 0.6``, the second ``> 0.6``)."""
    x = _c(c)
    return (F.when(x < 0.6, F.lit(0))
            .when((x > 0.6) & (x <= 1.3), F.lit(1))
            .when((x > 1.3) & (x <= 2.3), F.lit(2))
            .otherwise(F.lit(3)))


def label_within(c, n: float) -> Column:
    """1 if the gap is at most ``n`` days (negative gaps included), else 0;
    a missing gap is 0."""
    return F.when(_c(c) <= n, F.lit(1)).otherwise(F.lit(0))


def threshold_label(c, t: float = 0.5) -> Column:
    """0 below the threshold, 1 at or above it (null stays null)."""
    x = _c(c)
    return F.when(x < t, F.lit(0)).when(x >= t, F.lit(1))


def recode(c, mapping: Mapping[str, str]) -> Column:
    """Dictionary recode; values not in the mapping become null."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(m, _c(c))


def ordinal_levels(c, levels: Sequence) -> Column:
    """Position (0-based) of the value in a fixed list of levels; unknown → null."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), _c(c))
    return F.when(pos > 0, (pos - 1).cast("int"))


def ordinal_encode(c, labels: Sequence[str]) -> Column:
    """Labels to integers in alphabetical order.  A value outside ``labels``
    raises at run time (the fitted encoder in the source does the same)."""
    ordered = sorted(labels)
    expr = F.when(_c(c).isNull(), F.lit(None).cast("int"))
    for i, v in enumerate(ordered):
        expr = expr.when(_c(c) == v, F.lit(i))
    return expr.otherwise(F.raise_error(F.concat(F.lit("unseen label: "), _c(c).cast("string"))).cast("int"))


def to_string(c) -> Column:
    return _c(c).cast("string")


def cast_int(c) -> Column:
    """Whole-number cast that yields null instead of failing on bad input."""
    return _c(c).try_cast("bigint")
