"""Column expressions shared by the plans.

Every helper returns a ``Column`` built from built-in functions, so it stays
inside whole-stage codegen.  The semantics follow the source dialect:
signed sub-second time differences, integer division that truncates toward
zero, NULL-on-zero ratios, CASE labels where NULL falls through to ELSE.
"""

from __future__ import annotations

from decimal import Decimal
from typing import Iterable, Union

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Union[Column, str]

MICROS_PER_MINUTE = 60_000_000.0
MICROS_PER_HOUR = 3_600_000_000.0


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(start: ColumnLike, end: ColumnLike) -> Column:
    """``end - start`` in microseconds (long) for wall-clock TIMESTAMP_NTZ
    values, whatever the session time zone.

    Subtracting two NTZ values gives a day-time interval with no time zone
    involved; it is read as exact seconds (``INTERVAL SECOND`` ->
    ``DECIMAL``) and scaled.  ``timestamp_diff`` would cast NTZ values to
    session-zone timestamps first, which moves wall times that fall in a
    daylight-saving gap.
    """
    seconds = (col(end) - col(start)).cast("interval second").cast("decimal(24,6)")
    return (seconds * F.lit(1_000_000)).cast("long")


def minutes_between(start: ColumnLike, end: ColumnLike) -> Column:
    """``end - start`` in minutes (double, signed, sub-second exact)."""
    return micros_between(start, end) / F.lit(MICROS_PER_MINUTE)


def mean_minutes(micros: ColumnLike) -> Column:
    """Mean of microseconds in minutes (an aggregate; NULL over no value).  The sum
    is exact, so the result is the same to the last bit in whatever order and
    partitions the rows come."""
    micros = col(micros)
    return (F.sum(micros.cast("decimal(20,0)")).cast("double")
            / F.nullif(F.count(micros) * F.lit(MICROS_PER_MINUTE), F.lit(0.0)))


def hours_between(start: ColumnLike, end: ColumnLike) -> Column:
    """``end - start`` in hours (double)."""
    return micros_between(start, end) / F.lit(MICROS_PER_HOUR)


def count_where(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)``: 0 for a NULL condition,
    NULL over an empty input."""
    return F.sum(F.when(cond, 1).otherwise(0))


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """``num / NULLIF(den, 0)`` in double; NULL when ``den`` is 0 or NULL."""
    return col(num).cast("double") / F.nullif(col(den), F.lit(0))


def pct(num: ColumnLike, den: ColumnLike) -> Column:
    """``100.0 * num / den`` in double; NULL when ``den`` is 0 or NULL."""
    return F.lit(100.0) * col(num).cast("double") / F.nullif(col(den), F.lit(0))


def int_div(num: ColumnLike, den: ColumnLike) -> Column:
    """Integer division truncating toward zero (``-1 div 26 = 0``)."""
    return F.call_function("div", col(num), col(den) if not isinstance(den, int) else F.lit(den))


def span(lo, hi) -> float | None:
    """``hi - lo`` computed exactly in decimal, then as double (NULL if 0)."""
    d = Decimal(str(hi)) - Decimal(str(lo))
    return None if d == 0 else float(d)


def minmax_score(x: ColumnLike, lo, hi, invert: bool = False) -> Column:
    """``(x - lo) / NULLIF(hi - lo, 0)`` or, inverted, ``(hi - x) / ...``.
    Unclamped: values outside [lo, hi] give scores outside [0, 1]."""
    width = span(lo, hi)
    if width is None:
        return F.lit(None).cast("double")
    num = (F.lit(hi) - col(x)) if invert else (col(x) - F.lit(lo))
    return num.cast("double") / F.lit(width)


def tercile_label(rank: ColumnLike, total: ColumnLike) -> Column:
    """'Difficult' for rank <= n div 3, 'Medium' for rank <= 2n div 3, else 'Easy'."""
    r, n = col(rank), col(total)
    return (F.when(r <= int_div(n, 3), "Difficult")
            .when(r <= int_div(F.lit(2) * n, 3), "Medium")
            .otherwise("Easy"))


def padded_day_name(d: ColumnLike) -> Column:
    """Full English weekday name blank-padded to 9 characters ('Sunday   ')."""
    return F.rpad(F.date_format(col(d), "EEEE"), 9, " ")


def departure_bank(hour: ColumnLike) -> Column:
    h = col(hour)
    return (F.when(h < 7, "Early Morning")
            .when(h.between(7, 12), "Morning")
            .when(h.between(13, 18), "Afternoon")
            .otherwise("Evening/Night"))


def haul_category(hours: ColumnLike) -> Column:
    h = col(hours)
    return (F.when(h < 2, "Short Haul")
            .when(h.between(2, 5), "Medium Haul")
            .otherwise("Long Haul"))


def weighted_sum(terms: Iterable[tuple[float, ColumnLike]]) -> Column:
    """``w1*c1 + w2*c2 + ...`` left to right; NULL if any term is NULL."""
    out = None
    for w, c in terms:
        t = F.lit(float(w)) * col(c)
        out = t if out is None else out + t
    return out


def pct_round2(num: ColumnLike, den: ColumnLike) -> Column:
    """``ROUND(100.0 * num / den, 2)`` rounded half away from zero on the exact
    decimal value, for counts (num >= 0, den > 0), by integer arithmetic:
    ``(20000*num + den) div (2*den)`` hundredths.  NULL when den is 0."""
    n, d = col(num).cast("long"), F.nullif(col(den).cast("long"), F.lit(0))
    return int_div(F.lit(20000) * n + d, F.lit(2) * d).cast("double") / F.lit(100.0)


def round6(c: ColumnLike) -> Column:
    """Round a double to 6 decimals half away from zero on its binary value
    (``round(x * 1e6) / 1e6``), the form the SQL check uses too."""
    return F.round(col(c) * F.lit(1e6), 0) / F.lit(1e6)
