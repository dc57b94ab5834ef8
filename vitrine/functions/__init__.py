"""Column-expression builders (JVM-side, inside whole-stage codegen)."""

from vitrine.functions.common import (
    DEFAULT_EXCLUDED,
    active_status,
    category_label,
    delay_days_calendar,
    delay_days_floor,
    month_label,
    pct,
    period_diff,
    rnd,
)
from vitrine.functions.costs import CostModel

__all__ = [
    "DEFAULT_EXCLUDED", "CostModel", "active_status", "category_label", "delay_days_calendar",
    "delay_days_floor", "month_label", "pct", "period_diff", "rnd",
]
