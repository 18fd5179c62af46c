"""Role views: the order/delivery star schema over the sample tables.

Every operator takes DataFrames with role column names, so a real schema only
needs its own module like this one. All derived columns are integer arithmetic on
keys, and no view holds more than a projection or a dimension lookup.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.tables import read_table

PAYMENT_TYPES = ["AF", "AO", "NF", "NO", "RF", "RO"]


class Roles:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.path, name)

    @cached_property
    def orders(self) -> DataFrame:
        k = "o_orderkey"
        lead = (f"CASE WHEN {k} % 2500 = 17 THEN -1 WHEN {k} % 50 = 0 THEN 41 + {k} % 40 "
                f"ELSE 1 + (37 * {k} + 11 * o_custkey) % 30 END")
        gone = f"({k} % 90 = 13 OR {k} % 40 = 7)"
        return self.raw("orders").selectExpr(
            f"{k} AS order_id", "o_custkey AS customer_id", "o_orderdate AS purchase_ts",
            f"CASE WHEN {k} % 600 <> 5 THEN o_orderdate + make_dt_interval(0, CAST({k} % 3 AS INT)) END AS approved_at",
            f"CASE WHEN NOT {gone} THEN o_orderdate + make_dt_interval(CAST(greatest({lead}, 0) div 3 AS INT)) END AS carrier_at",
            f"CASE WHEN NOT {gone} THEN o_orderdate + make_dt_interval(CAST({lead} AS INT)) END AS delivered_at",
            f"o_orderdate + make_dt_interval(CAST(20 + 3 * ({k} % 5) AS INT)) AS estimated_at",
            f"CASE WHEN {k} % 90 = 13 THEN 'canceled' WHEN {k} % 40 = 7 THEN 'shipped' ELSE 'delivered' END AS order_status",
            "o_orderpriority AS priority")

    @cached_property
    def items(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS order_id", "l_linenumber AS item_seq", "l_partkey AS product_id",
            "l_suppkey AS seller_id", "l_extendedprice AS price",
            "floor(l_extendedprice * l_tax * 100 + 0.5D) / 100D AS freight_value", "l_shipdate AS shipping_limit")

    def _located(self, table: str, key: str, nation: str, prefix: str, extra=()) -> DataFrame:
        place = (self.raw("nation").join(self.raw("region"),
                                         F.col("n_regionkey") == F.col("r_regionkey"), "left")
                 .select("n_nationkey", F.col("n_name").alias(f"{prefix}_city"),
                         F.col("r_name").alias(f"{prefix}_state")))
        # One row per place: bounded by the map.
        return (self.raw(table).join(F.broadcast(place), F.col(nation) == F.col("n_nationkey"), "left")
                .select(F.col(key).alias(f"{prefix}_id"), F.col(nation).alias(f"{prefix}_zip"),
                        f"{prefix}_city", f"{prefix}_state", *extra))

    @cached_property
    def customers(self) -> DataFrame:
        return self._located("customer", "c_custkey", "c_nationkey", "customer",
                             [F.col("c_custkey").alias("customer_unique_id")])

    @cached_property
    def sellers(self) -> DataFrame:
        return self._located("supplier", "s_suppkey", "s_nationkey", "seller")

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey AS product_id", "CASE WHEN p_partkey % 50 <> 0 THEN p_type END AS category",
            "CASE WHEN p_partkey % 37 <> 0 THEN p_size * 100 END AS weight_g",
            "1 + p_size % 7 AS length_cm", "1 + p_size % 5 AS height_cm", "1 + p_size % 3 AS width_cm",
            "CAST(1 + p_partkey % 5 AS INT) AS photos")

    @cached_property
    def translation(self) -> DataFrame:
        return (self.raw("part").where("p_type <> 'PROMO'").select(F.col("p_type").alias("category")).distinct()
                .withColumn("category_english", F.lower("category")))

    @cached_property
    def payments(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS order_id", "l_linenumber AS payment_seq",
            "concat(l_returnflag, l_linestatus) AS payment_type",
            "floor(l_extendedprice * (1 - l_discount) * 100 + 0.5D) / 100D AS payment_value",
            "1 + l_linenumber % 6 AS installments")

    @cached_property
    def reviews(self) -> DataFrame:
        return (self.orders.where("order_id % 11 <> 0").selectExpr(
            "order_id AS review_id", "order_id", "CAST(1 + (order_id * 7) % 5 AS INT) AS score",
            "CASE WHEN order_id % 3 = 0 THEN 'text' END AS comment",
            "delivered_at + make_dt_interval(2) AS answered_at"))

    @cached_property
    def geolocation(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_nationkey AS zip",
            "-33D + 1.4D * c_nationkey + 0.01D * (c_custkey % 7) + CASE WHEN c_custkey % 100 = 0 THEN 60D ELSE 0D END AS lat",
            "-73D + 1.5D * c_nationkey + 0.01D * (c_custkey % 5) AS lng")

    @cached_property
    def scores(self) -> DataFrame:
        k = "o_orderkey"
        lead = (f"CASE WHEN {k} % 2500 = 17 THEN -1 WHEN {k} % 50 = 0 THEN 41 + {k} % 40 "
                f"ELSE 1 + (37 * {k} + 11 * o_custkey) % 30 END")
        return self.raw("orders").selectExpr(
            f"{k} AS order_id",
            f"CASE WHEN {k} % 400 <> 3 THEN (({k} * 7919) % 1009) / 1009.0D END AS p",
            f"CASE WHEN {k} % 400 <> 3 THEN CAST({lead} - (20 + 3 * ({k} % 5)) + {k} % 7 - 3 AS DOUBLE) END AS days")

    @cached_property
    def prediction_log(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id", "ts", "user_id", "value / 100D AS score", "event_type AS segment",
            "CAST(get_json_object(props, '$.k') AS DOUBLE) AS feature")

    @cached_property
    def doc_scores(self) -> DataFrame:
        """Binary label with an integer score, from two further tables."""
        return (self.raw("labels").join(self.raw("documents").select("doc_id", "n_chars"), "doc_id")
                .selectExpr("doc_id AS order_id", "quality AS label", "CAST(n_chars AS DOUBLE) AS score"))
