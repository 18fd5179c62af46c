"""Registry of named queries and their SQL cross-checks."""
from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import features, history
from ..operators.labels import EXCLUDED_STATUSES, labels_as_of, scoring_eligibility, targets_as_of
from ..functions.times import calendar_days, day, month_label
from ..roles import PAYMENT_TYPES, Roles
from .oracle import sql as with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ITEM_ORDER = ["item_seq", "product_id", "seller_id", "price", "shipping_limit"]
RUN_DATE = "1998-06-02"
FIRST_MONTH, LAST_MONTH = "1995-02", "2001-06"


class Base(Roles):
    """Role views plus the derived tables that several queries start from."""

    @cached_property
    def features(self) -> DataFrame:
        return features.feature_table(self, PAYMENT_TYPES, FIRST_MONTH)

    @cached_property
    def order_table(self) -> DataFrame:
        return features.order_outcomes(self, self.features, ITEM_ORDER, FIRST_MONTH, LAST_MONTH)

    @cached_property
    def delivered(self) -> DataFrame:
        from ..operators.cubes import delivered_basis
        return delivered_basis(self.order_table)

    @cached_property
    def star(self) -> DataFrame:
        from ..operators.joins import items_star
        return items_star(self.items, self.products, self.sellers)

    @cached_property
    def seller_history(self) -> DataFrame:
        return history.seller_history(self.orders, self.items)

    @cached_property
    def scored(self) -> DataFrame:
        """Eligible scored orders with label and target at approval + 45 days."""
        rows = scoring_eligibility(self.orders).where(~F.col("order_status").isin(EXCLUDED_STATUSES)) \
            .join(self.scores.where("p IS NOT NULL"), "order_id") \
            .join(self.customers.select("customer_id", "customer_state"), "customer_id", "left")
        run = F.date_add(day("approved_at"), 46)
        return targets_as_of(labels_as_of(rows, run), run, 45).select(
            "order_id", "customer_state", day("approved_at").alias("approval_day"), month_label("approved_at").alias("month"),
            "p", "days", "label", "target", calendar_days("estimated_at", "approved_at").alias("promised_lead_days"))


def _rounded(c, digits: int):
    """Half away from zero on the scaled value, the same arithmetic as the SQL side."""
    scale = F.lit(float(10 ** digits))
    return F.when(F.abs(c) < 1e11, F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale).otherwise(c) + F.lit(0.0)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Report form: whole numbers as BIGINT, doubles rounded."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = _rounded(c.cast("double"), digits)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, oracle: str | None = None, digits: int = 6):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(Base(spark, sf_dir)), digits)
        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn
    return register
