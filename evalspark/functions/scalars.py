"""Scalar rules as Column expressions.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values from the reference: page size default / cap, time zone used for
# the default due date, status range.
PAGE_DEFAULT = 50
PAGE_MAX = 200
DUE_DATE_TZ = "Asia/Bangkok"
STATUS_MIN, STATUS_MAX = 0, 2
PCT_DIGITS = 6


# The characters that Unicode calls White_Space.
WHITE_SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """``NULLIF(x, '')``."""
    return F.nullif(_c(c), F.lit(""))


def null_to(c, default) -> Column:
    """``ISNULL(x, d)``."""
    return F.coalesce(_c(c), F.lit(default))


def trim_space(c) -> Column:
    """``strings.TrimSpace``: Unicode white space off both ends."""
    return F.btrim(_c(c), F.lit(WHITE_SPACE))


def is_blank(c) -> Column:
    """``strings.TrimSpace(s) == ""`` (NULL counts as blank)."""
    return F.coalesce(trim_space(c) == "", F.lit(True))


def iso_date(c) -> Column:
    """``CONVERT(varchar(10), d, 23)`` -> ``yyyy-MM-dd`` text."""
    return F.date_format(_c(c), "yyyy-MM-dd")


def try_date(c) -> Column:
    """``TRY_CONVERT(date, NULLIF(x, ''))`` - NULL on blank or bad text."""
    return F.try_to_date(blank_to_null(trim_space(_c(c).cast("string"))), "yyyy-MM-dd")


def today_utc(as_of_ts: str) -> Column:
    """``CONVERT(date, SYSUTCDATETIME())`` with an explicit instant."""
    return F.to_date(F.lit(as_of_ts).cast("timestamp"))


def local_date(ts, tz: str = DUE_DATE_TZ) -> Column:
    """calendar date in ``tz`` of a UTC wall-clock instant (default due date).

    The instant is taken as a UTC wall clock (``timestamp_ntz``), so the
    result does not depend on the session time zone.
    """
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(ts).cast("timestamp_ntz")))


def int_or_zero(c) -> Column:
    """``strconv.Atoi`` with the error ignored -> 0."""
    s = _c(c).cast("string")
    return F.coalesce(F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("int")), F.lit(0))


def normalize_status(c) -> Column:
    """A save status outside 0..2 is stored as 0."""
    s = _c(c)
    return F.when(s.between(STATUS_MIN, STATUS_MAX), s).otherwise(F.lit(0)).cast("int")


def weight_fraction(w) -> Column:
    """competency weight NULL -> 0, <= 1 -> as fraction, > 1 -> percent / 100."""
    w = _c(w).cast("double")
    return F.when(w.isNull(), F.lit(0.0)).when(w <= 1, w).otherwise(w / 100.0)


def pct(c) -> Column:
    """Exposed percentages are rounded to 6 digits."""
    return F.round(_c(c), PCT_DIGITS)


def years_of_work(confirm_date, start_date, as_of) -> Column:
    """whole years since confirm (else start) date; 0 when neither or negative.

    The anniversary of 29 Feb falls on 1 Mar in common years, so the year is
    counted down while (month, day) of ``as_of`` is before that of the base,
    with 29 Feb compared as 1 Mar when ``as_of`` is in a common year.
    """
    base = F.coalesce(_c(confirm_date), _c(start_date))
    now = _c(as_of).cast("date")
    feb29 = (F.month(base) == 2) & (F.dayofmonth(base) == 29)
    now_leap = F.dayofmonth(F.last_day(F.make_date(F.year(now), F.lit(2), F.lit(1)))) == 29
    b_month = F.when(feb29 & ~now_leap, F.lit(3)).otherwise(F.month(base))
    b_day = F.when(feb29 & ~now_leap, F.lit(1)).otherwise(F.dayofmonth(base))
    before = (F.month(now) < b_month) | ((F.month(now) == b_month) & (F.dayofmonth(now) < b_day))
    years = F.year(now) - F.year(base) - before.cast("int")
    return F.when(base.isNull(), F.lit(0)).otherwise(F.greatest(years, F.lit(0))).cast("int")


def clamp_page(limit: int | None, offset: int | None) -> tuple[int, int]:
    """L1: limit outside 1..200 -> 50; negative offset -> 0."""
    lim = limit if limit is not None and 0 < limit <= PAGE_MAX else PAGE_DEFAULT
    off = offset if offset is not None and offset >= 0 else 0
    return lim, off
