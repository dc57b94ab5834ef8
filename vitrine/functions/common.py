"""Scalar helpers shared by the operators (SF1-SF21, PRP1-PRP3, FLT1).

All are plain ``pyspark.sql.functions`` compositions: no Python runs per row.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order statuses that do not count as real sales. The marketplace data spells
# the first one 'canceled'; pass ('cancelled', 'unavailable') to reproduce
# queries written with the other spelling (which then match nothing).
DEFAULT_EXCLUDED = ("canceled", "unavailable")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x, d: int) -> Column:
    """Round half-up at ``d`` decimals through DECIMAL(28,8), then DOUBLE.

    Rounding raw doubles differs between engines at ties (1.005); going through
    a decimal makes the result exact and engine-independent.
    """
    return F.round(_c(x).cast("decimal(28,8)"), d).cast("double")


def pct(num, den, d: int = 1) -> Column:
    """``round(100 * num / den, d)``; null when ``den`` is 0 (NULLIF guard)."""
    den_c = _c(den)
    ratio = F.lit(Decimal("100.0")) * _c(num) / F.when(den_c != 0, den_c)
    return rnd(ratio, d)


def active_status(status="order_status", excluded=DEFAULT_EXCLUDED, keep_null: bool = False) -> Column:
    """FLT1: ``status NOT IN excluded``. SQL drops a null status; the pandas
    ``~isin`` keeps it (``keep_null=True``)."""
    s = _c(status)
    cond = ~s.isin(*excluded)
    return (s.isNull() | cond) if keep_null else cond


def delay_days_calendar(delivered="order_delivered_customer_date",
                        estimated="order_estimated_delivery_date") -> Column:
    """PRP1/SF2: calendar-day difference, time of day ignored; null unless both set."""
    return F.datediff(F.to_date(_c(delivered)), F.to_date(_c(estimated)))


def delay_days_floor(later="order_delivered_customer_date",
                     earlier="order_estimated_delivery_date") -> Column:
    """PRP2/SF4: whole days of a timestamp difference, floored (timedelta.days)."""
    secs = F.timestamp_diff("SECOND", _c(earlier), _c(later))
    return F.floor(secs / F.lit(86400)).cast("int")


def month_label(ts="order_purchase_timestamp", fmt: str = "yyyy-MM") -> Column:
    """PRP3/SF1/SF8: month text of a timestamp ('yyyy-MM' or 'yyyyMM')."""
    return F.date_format(_c(ts), fmt)


def period_diff(later_yyyymm, earlier_yyyymm) -> Column:
    """SF3: months between two 'yyyyMM' labels."""
    a, b = _c(later_yyyymm).cast("int"), _c(earlier_yyyymm).cast("int")
    return (F.floor(a / 100) - F.floor(b / 100)).cast("int") * 12 + (a % 100 - b % 100).cast("int")


def category_label(english="product_category_name_english", native="product_category_name") -> Column:
    """SF10: translated category name, else the native one (null stays null)."""
    return F.coalesce(_c(english), _c(native))
