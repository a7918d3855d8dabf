"""Queries that go through the store and the stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tidelog.operators import read
from tidelog.plans.read_queries import O_LOG
from tidelog.sources.changelog import from_orders, orders_log, table
from tidelog.sources.store import Store
from tidelog.streaming.tail import LatestState, change_stream


def folder(spark, name: str) -> str:
    """A new path under the folder that driver and executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tidelog-") if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kv_stream_tail(spark, d):
    """The order log replayed as a stream, eight files a batch; the last state's live keys."""
    orders = table(spark, d, "orders")
    src = folder(spark, "feed")
    orders.repartitionByRange(16, "o_orderkey").write.parquet(src)
    state = LatestState(spark, folder(spark, "tail")).run(from_orders(change_stream(spark, src, orders.schema)))
    return state.rows().where("type = 1").select("key", "seq", "value")


def _filled(spark, d) -> Store:
    """The order log in four batches, keys and values as bytes, in batch order."""
    store = Store.open(spark, folder(spark, "store"))
    log = orders_log(spark, d)
    for part in range(4):
        ops = log.where(F.col("seq") % 4 == part).select(F.col("seq").alias("ord"), F.lpad(F.col("key").cast("string"), 9, "0").cast("binary").alias("key"), "type", F.col("value").cast("binary").alias("value"))
        store.write(ops)
    return store


def kv_store_scan(spark, d):
    """Written in four batches, the fourth starts a compaction of level 0."""
    rows = _filled(spark, d).scan()
    return rows.select(F.col("key").cast("string").cast("long").alias("key"), "seq", F.col("value").cast("string").alias("value"))


def kv_store_levels(spark, d):
    store = _filled(spark, d)
    return spark.createDataFrame([(k, store.get_property(f"files-at-level{k}")) for k in range(7)], "level int, n_files int")


def kv_store_repair(spark, d):
    """The manifest is made anew from the data; reads stay as they were."""
    store = Store.repair(spark, _filled(spark, d).root)
    rows = read.resolve(store.log())
    return rows.select(F.col("key").cast("string").cast("long").alias("key"), "seq", F.col("value").cast("string").alias("value"))


_STORED = "WITH w AS (SELECT o_custkey AS key, row_number() OVER (ORDER BY o_orderkey % 4, o_orderkey) AS seq, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS type, o_orderpriority AS value FROM orders) SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM w GROUP BY key HAVING arg_max(type, seq) = 1"
SQL = {
    "kv_stream_tail": f"WITH {O_LOG} SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM log GROUP BY key HAVING arg_max(type, seq) = 1",
    "kv_store_scan": _STORED,
    "kv_store_repair": _STORED,
    "kv_store_levels": "SELECT CAST(range AS INTEGER) AS level, CASE WHEN range = 1 THEN 1 ELSE 0 END AS n_files FROM range(7)",
}
QUERIES = {name: globals()[name] for name in SQL}
