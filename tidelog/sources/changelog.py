"""Change logs ``(key, seq, type, value)`` derived from event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import DELETION, VALUE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(events: DataFrame) -> DataFrame:
    """One change for each event; an error deletes the user's entry."""
    return events.select(
        F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("seq"), F.when(F.col("event_type") == "error", DELETION).otherwise(VALUE).alias("type"), F.col("event_type").alias("value")
    )


def from_orders(orders: DataFrame) -> DataFrame:
    """One change for each order; a finished order deletes the customer's entry."""
    return orders.select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", DELETION).otherwise(VALUE).alias("type"), F.col("o_orderpriority").alias("value")
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_orders(table(spark, sf_dir, "orders"))
