"""The ``sales`` view over the driver's star schema, and its binding to business concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAPPING = {
    "order_id": "l_orderkey", "customer_id": "o_custkey", "order_date": "o_orderdate", "delivery_date": "l_shipdate", "revenue": "l_extendedprice",
    "quantity": "l_quantity", "unit_price": "p_retailprice", "discount": "l_discount", "order_total": "o_totalprice", "product_id": "p_name",
    "product_category": "p_type", "region": "n_name", "order_status": "o_orderstatus", "channel": "c_mktsegment",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How each table joins those before it; columns begin with its letter.
_JOINS = {"o": ("orders", "l_orderkey", "o_orderkey"), "c": ("customer", "o_custkey", "c_custkey"), "n": ("nation", "c_nationkey", "n_nationkey"), "p": ("part", "l_partkey", "p_partkey")}
_NEEDS = {"l": "", "o": "o", "c": "oc", "n": "ocn", "p": "p"}


def sales(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Lines with their order, customer, nation and part, or only with the tables of ``columns``.

    Every line has one of each, so a table that is not asked for changes no
    row. Join sides are left to Spark, which broadcasts those it finds small.
    """
    wanted = "ocnp" if columns is None else "".join(_NEEDS[c[0]] for c in columns)
    d = table(spark, sf_dir, "lineitem")
    for letter, (name, left, right) in _JOINS.items():
        if letter in wanted:
            d = d.join(table(spark, sf_dir, name), F.col(left) == F.col(right))
    return d


SQL = """(SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""
