"""

A: item revenue, flat fee per distinct order.   B: item revenue, fee per row.
C: order revenue = payment value, discount only on voucher orders.

All arithmetic stays in DECIMAL so sums are exact; outputs are rounded once.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CostModel:
    # Fixed business assumptions of the workload: 12% shipping, 8% discount,
    # 5.00 operating cost per order.
    shipping_rate: Decimal = Decimal("0.12")
    discount_rate: Decimal = Decimal("0.08")
    operational_cost: Decimal = Decimal("5.00")
    low_review: int = 3  # discount applies when review_score < low_review

    def lit(self, name: str) -> Column:
        return F.lit(getattr(self, name))

    # ---- item models (A/B)
    def item_shipping(self, price="price", freight="freight_value") -> Column:
        return F.col(price) * self.lit("shipping_rate") + F.col(freight)

    def item_discount(self, price="price", score="review_score") -> Column:
        return (F.when(F.col(score) < self.low_review, F.col(price) * self.lit("discount_rate"))
                .otherwise(F.lit(Decimal("0"))))

    def item_profit(self, price="price", freight="freight_value", score="review_score") -> Column:
        return (F.col(price) - self.item_shipping(price, freight) - self.item_discount(price, score)
                - self.lit("operational_cost"))

    # ---- order model (C)
    def order_shipping(self, payment="payment_value") -> Column:
        return F.col(payment) * self.lit("shipping_rate")

    def order_discount(self, price="price", voucher="voucher_used") -> Column:
        # np.where(voucher_used == True, ...): a null flag counts as False.
        return (F.when(F.coalesce(F.col(voucher), F.lit(False)), F.col(price) * self.lit("discount_rate"))
                .otherwise(F.lit(Decimal("0"))))
