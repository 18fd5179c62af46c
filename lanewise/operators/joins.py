"""Join shapes of the order star schema."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import ratio
from ..functions.times import day, month_start


def orders_with_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return orders.join(customers, "customer_id", "left")


def items_star(items: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    return items.join(products, "product_id", "left").join(sellers, "seller_id", "left")


def join_fanout(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Row inflation of a left join, measured from per-key counts instead of the joined rows."""
    per_key = children.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return parents.select(key).join(per_key, key, "left").agg(
        F.count(F.lit(1)).alias("parent_rows"),
        F.sum(F.coalesce("c", F.lit(1))).alias("joined_rows")).withColumn(
        "inflation", ratio("joined_rows", "parent_rows"))


def outer_compare(left: DataFrame, right: DataFrame, left_key: str, right_key: str, out_key: str) -> DataFrame:
    """Full outer join on differently named keys."""
    return (left.join(right, F.col(left_key) == F.col(right_key), "full_outer")
            .withColumn(out_key, F.coalesce(left_key, right_key)).drop(left_key, right_key))


def shifted_repeat(months: DataFrame, entity: str, month: str, horizon: int = 3) -> DataFrame:
    """Entity-months flagged when the entity returns within ``horizon`` months (equi join)."""
    own = months.select(entity, month).distinct()
    later = (own.select(entity, F.explode(F.array(*[F.lit(k) for k in range(1, horizon + 1)])).alias("_k"), month)
             .select(entity, F.expr(f"add_months({month}, -_k)").alias(month)).distinct()
             .withColumn("repeat", F.lit(1)))
    return own.join(later, [entity, month], "left").withColumn("repeat", F.coalesce("repeat", F.lit(0)))


def ranged_repeat(months: DataFrame, entity: str, month: str, horizon: int = 3) -> DataFrame:
    """Same flag through a range condition within the entity.

    A semi join tests existence only, so no pair of months is ever emitted.
    """
    own = months.select(entity, month).distinct()
    nxt = own.select(F.col(entity).alias("_e"), F.col(month).alias("_m"))
    hit = own.join(nxt, (F.col(entity) == F.col("_e"))
                   & F.col("_m").between(F.add_months(month, 1), F.add_months(month, horizon)), "left_semi") \
        .withColumn("repeat", F.lit(1))
    return own.join(hit, [entity, month], "left").withColumn("repeat", F.coalesce("repeat", F.lit(0)))


def repeat_monthly(flags: DataFrame, entity: str, month: str, last_month: str, horizon: int = 3) -> DataFrame:
    """Customers, repeaters and rate by month; the newest months cannot show a whole window."""
    limit = F.add_months(F.to_date(F.lit(f"{last_month}-01")), -horizon)
    return (flags.groupBy(month).agg(F.count(F.lit(1)).alias("customers"), F.sum("repeat").alias("repeat_customers"))
            .withColumn("repeat_rate", ratio("repeat_customers", "customers"))
            .withColumn("complete_window", F.col(month) <= limit))


def customer_months(orders: DataFrame, entity: str, ts: str) -> DataFrame:
    return orders.where(F.col(ts).isNotNull()).select(entity, month_start(ts).alias("month")).distinct()


def validated_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that fails the job when either side repeats a key.

    The check reads partially aggregated key counts, not the joined rows.
    """
    for name, side in (("left", left), ("right", right)):
        dup = side.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1)
        if not dup.isEmpty():
            raise ValueError(f"{key} is not unique on the {name} side")
    return left.join(right, key, "left")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key along an explicit order.

    ``min_by`` combines on the map side, so a key with many copies needs no sorted group.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def map_lookup(df: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """Adds the value of the key; a key with two values is an error, not a choice."""
    one = lookup.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(value)) \
        .select(key, F.when(F.col("_n") == 1, F.col(value)).otherwise(F.raise_error(F.lit(f"lookup repeats a {key}"))).alias(value))
    return df.join(one, key, "left")


def param_rows(rows: Sequence[dict]) -> Column:
    """A literal list of settings as an array of structs."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])


def cross_params(df: DataFrame, rows: Sequence[dict]) -> DataFrame:
    """Each row once per setting: a generator over a literal list, no join and no shuffle."""
    return df.withColumn("_p", F.explode(param_rows(rows))).select(*df.columns, "_p.*")


def interval_cohorts(df: DataFrame, day_expr: Column, rows: Sequence[dict], start: str = "start",
                     end: str = "end") -> DataFrame:
    """Rows once per setting whose inclusive date window holds them."""
    hits = F.filter(param_rows(rows), lambda p: day_expr.between(p[start], p[end]))
    return df.withColumn("_p", F.explode(hits)).select(*df.columns, "_p.*")
