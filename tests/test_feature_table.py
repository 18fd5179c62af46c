"""Baskets per order: repeated and missing keys, and lines that cross the network narrow and unaggregated."""
import datetime as dt
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lanewise.functions.scalars import haversine_km
from lanewise.operators import features


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    return SimpleNamespace(
        items=make([(1, 10, 100, 5.0, 1.0), (1, 11, 100, 7.0, None), (1, 10, 101, 3.0, 1.0), (1, None, None, 2.0, 0.5), (2, 12, 100, 4.0, 1.0), (None, 10, 100, 9.0, 9.0)],
                   "order_id long, product_id long, seller_id long, price double, freight_value double"),
        products=make([(10, "a", 100, 1, 2, 2, 2), (11, "b", None, 3, 1, 1, 1), (12, None, 50, None, 1, 2, 3)],
                      "product_id long, category string, weight_g int, photos int, length_cm int, height_cm int, width_cm int"),
        # Seller 101 comes twice.
        sellers=make([(100, 7, "x", "S"), (101, 8, "y", "T"), (101, 8, "y", "T")], "seller_id long, seller_zip int, seller_city string, seller_state string"),
        geolocation=make([(7, 0.0, 0.0), (8, 0.0, 2.0), (8, 0.0, 4.0), (9, 0.0, 1.0)], "zip int, lat double, lng double"))


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame([(1, "S", 9), (2, "S", 6), (2, "S", 6), (3, "S", 9), (None, "S", 9)], "order_id long, customer_state string, customer_zip int")


@pytest.mark.parametrize("bound", [400_000, 0])
def test_basket_by_order(spark, tables, orders, monkeypatch, bound):
    monkeypatch.setattr(features, "DIMENSION_ROWS", bound)
    got = {r.order_id: r for r in features.basket_by_order(tables, orders).collect()}
    near, far = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), haversine_km(F.lit(0.0), F.lit(3.0), F.lit(0.0), F.lit(1.0))).first()
    assert set(got) == {1, 2}
    one, two = got[1], got[2]
    assert (one.order_item_count, one.order_seller_count, one.order_pdt_price_sum, one.order_frieght_value_sum, one.order_revenue_sum) == (4, 3, 20.0, 3.5, 16.5)
    assert (one.order_product_weight_g_sum, one.order_product_volume_cm3_sum, one.order_product_photos_mean) == (300, 25.0, 1.5)
    assert (one.seller_dist_km_max, one.seller_dist_km_min, one.seller_dist_km_median) == (far, near, far)
    assert one.seller_dist_km_mean == pytest.approx((near + 2 * far) / 3) and (one["_all"], one["_any"]) == (False, True)
    assert (one.seller_zips, one.seller_cities, one.seller_states, one.product_categories) == ([7, 8], ["x", "y"], ["S", "T"], ["a", "b"])
    # The order comes twice, and its buyer's place is unknown.
    assert (two.order_item_count, two.order_seller_count, two.order_pdt_price_sum) == (2, 2, 8.0) and two.order_product_photos_mean is None
    assert (two.seller_dist_km_max, two.seller_dist_km_median, two.seller_dist_km_mean, two["_all"], two["_any"]) == (None, None, None, False, False)
    assert (two.product_categories, two.order_product_category_count, two.seller_state_count) == ([], 0, 1)


def test_lines_are_not_dealt_by_place_nor_aggregated_before(tables, orders):
    plan = features.basket_by_order(tables, orders)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(customer_zip" not in plan and "hashpartitioning(seller_zip" not in plan
    # Lines are dealt by order alone, before they are aggregated: a partial aggregate of a whole split would spill.
    assert not re.search(r"hashpartitioning\(order_id#\w+, \w+#", plan) and "REPARTITION_BY_COL" in plan


def test_large_tables_are_dealt_in_parts_of_bounded_size(spark, tables, orders, monkeypatch):
    many = SimpleNamespace(**{**vars(tables), "items": tables.items.crossJoin(spark.range(10)).drop("id")})
    usual = {r.order_id: r for r in features.basket_by_order(many, orders).collect()}
    monkeypatch.setattr(features, "DEALT_ROWS", 5)  # 60 lines: 12 parts, though the session has 8 shuffle partitions
    made = features.basket_by_order(many, orders)
    plan = made._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(order_id#\w+, (\d+)\)", plan)
    assert dealt and set(dealt) == {"12"}
    assert {r.order_id: r for r in made.collect()} == usual


def test_rows_cross_the_network_without_what_a_small_table_adds(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 5, 2.0), (2, 6, 3.0), (2, None, 4.0), (None, 5, 1.0), (3, 7, 0.5)], "order_id long, customer_id long, v double")
    places = spark.createDataFrame([(5, "S", 1), (6, "T", 2), (6, "T", 3)], "customer_id long, customer_state string, customer_zip int")
    deal = features._by_order(rows)

    def looked_up(spent=()):
        made = features._look_up(rows, [(places, "customer_id")], deal, spent)
        return made._jdf.queryExecution().optimizedPlan().toString(), sorted(map(str, made.drop(*spent).collect()))
    small, want = looked_up()
    assert len(want) == 6 and small.index("Join") < small.index("RepartitionByExpression")  # joined after the deal
    monkeypatch.setattr(features, "DIMENSION_ROWS", 0)
    large, got = looked_up()
    assert got == want and large.index("Join") > large.index("RepartitionByExpression")
    assert looked_up(["customer_id"])[1] == sorted(str(r) for r in rows.join(places, "customer_id", "left").drop("customer_id").collect())
    held = features._look_up(rows, [(places, "customer_id")], deal, ["customer_id"]).select("order_id", "customer_id")
    assert sorted(map(str, held.collect())) == sorted(f"Row(order_id={i}, customer_id={c})" for i, c in [(1, 0), (2, 0), (2, 0), (2, None), (None, 0), (3, 0)])


def test_orders_cross_the_network_before_their_customers_are_known(spark):
    """The feature table joins customers to orders that lie by order: no shuffle on the customer."""
    day = dt.datetime(1998, 3, 2)
    tables = SimpleNamespace(
        items=spark.createDataFrame([(1, 10, 100, 5.0, 1.0)], "order_id long, product_id long, seller_id long, price double, freight_value double"),
        products=spark.createDataFrame([(10, "a", 100, 1, 2, 2, 2)], "product_id long, category string, weight_g int, photos int, length_cm int, height_cm int, width_cm int"),
        sellers=spark.createDataFrame([(100, 7, "x", "S")], "seller_id long, seller_zip int, seller_city string, seller_state string"),
        geolocation=spark.createDataFrame([(7, 0.0, 0.0)], "zip int, lat double, lng double"),
        customers=spark.createDataFrame([(5, 7, "x", "S"), (6, 7, "x", "S")], "customer_id long, customer_zip int, customer_city string, customer_state string"),
        payments=spark.createDataFrame([(1, "A", 6.0, 2)], "order_id long, payment_type string, payment_value double, installments int"),
        orders=spark.createDataFrame([(1, 5, day, day, day, day, day), (2, None, day, day, day, day, day), (None, 6, day, day, day, day, day)],
                                     "order_id long, customer_id long, purchase_ts timestamp_ntz, approved_at timestamp_ntz, carrier_at timestamp_ntz, delivered_at timestamp_ntz, estimated_at timestamp_ntz"))
    table = features.feature_table(tables, ["A"])
    assert "hashpartitioning(customer_id" not in table._jdf.queryExecution().executedPlan().toString()
    got = {r.order_id: (r.customer_state, r.route_type, r.order_item_count, r.payment_value_sum) for r in table.collect()}
    assert got == {1: ("S", "2. All same-state", 1, 6.0), 2: (None, "1. All interstate", None, None), None: ("S", "1. All interstate", None, None)}
