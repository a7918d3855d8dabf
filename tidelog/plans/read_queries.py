"""Queries on reads, writes and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import merge, read, write
from tidelog.operators.ranks import position, totals_before
from tidelog.sources.changelog import events_log, orders_log, table

#: The change logs, the snapshot (seven tenths of the last sequence number) and version resolution, in SQL.
E_LOG = "log AS (SELECT user_id AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS type, event_type AS value FROM events), snap AS (SELECT max(seq) * 7 // 10 AS s FROM log)"
O_LOG = "log AS (SELECT o_custkey AS key, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS type, o_orderpriority AS value FROM orders), snap AS (SELECT max(seq) * 7 // 10 AS s FROM log)"
NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log, snap WHERE seq <= s) WHERE rn = 1)"


def snapshot(log, tenths: int = 7) -> int:
    return read.last_sequence(log) * tenths // 10


def kv_snapshot_scan(spark, d):
    log = events_log(spark, d)
    return read.scan(log, snapshot(log))


def kv_scan_latest(spark, d):
    return read.scan(orders_log(spark, d))


def kv_scan_include_tombstones(spark, d):
    log = events_log(spark, d)
    return read.scan(log, snapshot(log), include_tombstones=True)


def kv_tombstones(spark, d):
    log = events_log(spark, d)
    return read.newest(read.visible(log, snapshot(log))).where("type = 0").select("key", "seq")


def kv_get_point(spark, d):
    log = orders_log(spark, d)
    return read.get(log, 7, snapshot(log))


def kv_get_missing(spark, d):
    return read.get(orders_log(spark, d), -1)


def kv_get_deleted(spark, d):
    """The largest key that is deleted at the end."""
    log = events_log(spark, d)
    key = read.newest(log).where("type = 0").agg(F.max("key")).first()[0]
    return read.get(log, key).agg(F.count("*").alias("n_found"), F.lit(key).alias("key"))


def kv_multi_get(spark, d):
    """Every customer key, whether the log has it or not."""
    log = orders_log(spark, d)
    return read.multi_get(log, table(spark, d, "customer").select(F.col("c_custkey").alias("key")), snapshot(log))


def kv_range_scan(spark, d):
    log = orders_log(spark, d)
    return read.scan(log, snapshot(log), 100, 900)


def kv_range_unbounded_low(spark, d):
    return read.scan(orders_log(spark, d), None, None, 500)


def kv_range_unbounded_high(spark, d):
    return read.scan(orders_log(spark, d), None, 500, None)


def kv_reverse_range(spark, d):
    rows = read.resolve(orders_log(spark, d).where(read.key_between(100, 900)))
    return position(rows.withColumn("back", -F.col("key")), "back", "place").select("place", "key", "value")


def kv_seek(spark, d):
    """The first entry at or above each of ten keys."""
    live = position(read.resolve(orders_log(spark, d)).select("key"), "key", "place")
    targets = spark.range(10).select((F.col("id") * 97).alias("target"))
    before = totals_before(targets.withColumn("at", F.col("target")), live.select(F.col("key").alias("at")), "at", {"n": F.lit(1)})
    return before.join(live, before["n"] + 1 == live["place"]).select("target", F.col("key").alias("found"))


def kv_key_history(spark, d):
    return read.history(events_log(spark, d))


def kv_version_count(spark, d):
    return read.history(orders_log(spark, d)).groupBy("n_versions").agg(F.count("*").alias("n_keys"))


def kv_asof_lookup(spark, d):
    """Every event's user is looked up as of 500 changes before the event."""
    log = events_log(spark, d)
    probes = table(spark, d, "events").select(F.col("user_id").alias("key"), (F.col("event_id") - 500).alias("at"), "event_id")
    return read.as_of(log, probes).select("event_id", "key", "found_seq", "value")


def kv_snapshot_diff(spark, d):
    log = events_log(spark, d)
    return read.diff(log, snapshot(log, 4), snapshot(log, 9))


def kv_visible_prefix(spark, d):
    log = events_log(spark, d)
    return read.visible(log, snapshot(log)).groupBy("type").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def kv_valid_internal_keys(spark, d):
    log = table(spark, d, "pages").select(F.col("url").alias("key"), F.col("page_id").alias("seq"), (F.col("page_id") % 3).alias("type"))
    return log.select("seq", ((F.octet_length("key") > 0) & (F.col("type") <= 1)).alias("valid"))


def kv_oldest_snapshot(spark, d):
    from tidelog.operators.compact import oldest_snapshot

    log = events_log(spark, d)
    snaps = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("seq"))
    last = read.last_sequence(log)
    return spark.createDataFrame([(oldest_snapshot(snaps, last), oldest_snapshot(snaps.limit(0), last))], "with_snapshots long, without long")


def kv_batch_sequence(spark, d):
    """All orders as one batch after the events."""
    last = read.last_sequence(events_log(spark, d))
    batch = table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("key"))
    return write.sequence(batch, last)


def kv_last_op_wins(spark, d):
    """One batch with many operations on a key: the last one stays."""
    batch = table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("key"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("type"), F.col("o_orderpriority").alias("value"))
    return read.resolve(write.sequence(batch, 0))


def kv_memtable_usage(spark, d):
    log = events_log(spark, d)
    return log.groupBy((F.col("seq") % 10).alias("part")).agg(F.sum(write.memory_bytes(F.col("key").cast("string"), F.col("value"))).alias("bytes"))


def kv_batch_bytes(spark, d):
    log = events_log(spark, d)
    size = write.batch_bytes(F.col("key").cast("string"), F.col("type"), F.col("value"))
    return log.groupBy("key").agg((F.sum(size) + write.BATCH_HEADER).alias("bytes"))


def kv_group_commit(spark, d):
    """Each user's events queue up as writers."""
    w = table(spark, d, "events").select(F.col("user_id").alias("queue"), F.col("event_id").alias("ord"), (F.length("props").cast("long") * 4000 + F.col("event_id") % 7 * 1000).alias("bytes"), (F.col("event_type") == "purchase").alias("sync"))
    return write.commit_groups(w).groupBy("queue", "group_no").agg(F.count("*").alias("n_writers"), F.min("ord").alias("first_ord"))


def kv_admission(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", write.admission(k % 97 == 0, k % 15, k % 2 == 0, k % 11 * 500_000, F.lit(4 << 20), k % 5 == 0).alias("action"))


def kv_merge_runs(spark, d):
    """Ten overlapping runs of the event log, merged: as many changes as the runs have together."""
    log = events_log(spark, d)
    runs = [log.where(F.col("seq") % 10 == k) for k in range(10)]
    return merge.merge(*runs, ordered=False).groupBy("key").agg(F.count("*").alias("n"), F.max("seq").alias("max_seq"), F.min("seq").alias("min_seq"))


_MEM = "octet_length(encode(CAST(key AS VARCHAR))) + octet_length(encode(value)) + 13"
SQL = {
    "kv_snapshot_scan": f"WITH {E_LOG}, {NEWEST} SELECT key, seq, value FROM newest WHERE type = 1",
    "kv_scan_latest": f"WITH {O_LOG} SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND type = 1",
    "kv_scan_include_tombstones": f"WITH {E_LOG}, {NEWEST} SELECT key, seq, CASE WHEN type = 1 THEN value END AS value FROM newest",
    "kv_tombstones": f"WITH {E_LOG}, {NEWEST} SELECT key, seq FROM newest WHERE type = 0",
    "kv_get_point": f"WITH {O_LOG}, {NEWEST} SELECT key, seq, value FROM newest WHERE type = 1 AND key = 7",
    "kv_get_missing": f"WITH {O_LOG} SELECT key, seq, value FROM log WHERE key = -1",
    "kv_get_deleted": f"WITH {E_LOG}, last AS (SELECT key, arg_max(type, seq) AS type FROM log GROUP BY key), k AS (SELECT max(key) AS key FROM last WHERE type = 0) SELECT (SELECT count(*) FROM last JOIN k USING (key) WHERE type = 1) AS n_found, key FROM k",
    "kv_multi_get": f"WITH {O_LOG}, {NEWEST} SELECT c_custkey AS key, value FROM customer LEFT JOIN (SELECT * FROM newest WHERE type = 1) n ON n.key = c_custkey",
    "kv_range_scan": f"WITH {O_LOG}, {NEWEST} SELECT key, seq, value FROM newest WHERE type = 1 AND key BETWEEN 100 AND 900",
    "kv_range_unbounded_low": f"WITH {O_LOG} SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM log WHERE key <= 500 GROUP BY key HAVING arg_max(type, seq) = 1",
    "kv_range_unbounded_high": f"WITH {O_LOG} SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM log WHERE key >= 500 GROUP BY key HAVING arg_max(type, seq) = 1",
    "kv_reverse_range": f"WITH {O_LOG}, r AS (SELECT key, arg_max(value, seq) AS value FROM log WHERE key BETWEEN 100 AND 900 GROUP BY key HAVING arg_max(type, seq) = 1) SELECT row_number() OVER (ORDER BY key DESC) AS place, key, value FROM r",
    "kv_seek": f"WITH {O_LOG}, r AS (SELECT key FROM log GROUP BY key HAVING arg_max(type, seq) = 1), t AS (SELECT range * 97 AS target FROM range(10)) SELECT target, (SELECT min(key) FROM r WHERE key >= target) AS found FROM t WHERE (SELECT min(key) FROM r WHERE key >= target) IS NOT NULL",
    "kv_key_history": f"WITH {E_LOG} SELECT key, count(*) AS n_versions, CAST(count(*) FILTER (type = 0) AS BIGINT) AS n_deletions, min(seq) AS first_seq, max(seq) AS last_seq FROM log GROUP BY key",
    "kv_version_count": f"WITH {O_LOG}, h AS (SELECT key, count(*) AS n_versions FROM log GROUP BY key) SELECT n_versions, count(*) AS n_keys FROM h GROUP BY n_versions",
    "kv_asof_lookup": f"""WITH {E_LOG}, p AS (SELECT event_id, user_id AS key, event_id - 500 AS at FROM events)
SELECT event_id, p.key, CASE WHEN l.type = 1 THEN l.seq END AS found_seq, CASE WHEN l.type = 1 THEN l.value END AS value FROM p ASOF LEFT JOIN log l ON p.key = l.key AND p.at >= l.seq""",
    "kv_snapshot_diff": f"""WITH {E_LOG}, m AS (SELECT max(seq) * 4 // 10 AS s1, max(seq) * 9 // 10 AS s2 FROM log),
a AS (SELECT key, max(seq) AS seq, arg_max(type, seq) AS type, arg_max(value, seq) AS value FROM log, m WHERE seq <= s1 GROUP BY key),
b AS (SELECT key, max(seq) AS seq, arg_max(type, seq) AS type, arg_max(value, seq) AS value FROM log, m WHERE seq <= s2 GROUP BY key),
j AS (SELECT coalesce(a.key, b.key) AS key, coalesce(a.type, 0) = 1 AS ha, coalesce(b.type, 0) = 1 AS hb, a.seq AS sa, b.seq AS sb, a.value AS va, b.value AS vb FROM a FULL JOIN b ON a.key = b.key)
SELECT key, CASE WHEN NOT ha THEN 'added' WHEN NOT hb THEN 'removed' ELSE 'changed' END AS change, CASE WHEN ha THEN va END AS old_value, CASE WHEN hb THEN vb END AS new_value
FROM j WHERE (ha OR hb) AND NOT (ha AND hb AND sa = sb)""",
    "kv_visible_prefix": f"WITH {E_LOG} SELECT type, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM log, snap WHERE seq <= s GROUP BY type",
    "kv_valid_internal_keys": "SELECT page_id AS seq, octet_length(encode(url)) > 0 AND page_id % 3 <= 1 AS valid FROM pages",
    "kv_oldest_snapshot": f"WITH {E_LOG} SELECT coalesce((SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P'), (SELECT max(seq) FROM log)) AS with_snapshots, (SELECT max(seq) FROM log) AS without",
    "kv_batch_sequence": "SELECT o_orderkey AS ord, o_custkey AS key, (SELECT max(event_id) + 1 FROM events) + row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders",
    "kv_last_op_wins": "WITH b AS (SELECT o_custkey AS key, row_number() OVER (ORDER BY o_orderkey) AS seq, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS type, o_orderpriority AS value FROM orders) SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM b GROUP BY key HAVING arg_max(type, seq) = 1",
    "kv_memtable_usage": f"WITH {E_LOG} SELECT seq % 10 AS part, CAST(sum({_MEM}) AS BIGINT) AS bytes FROM log GROUP BY seq % 10",
    "kv_batch_bytes": f"WITH {E_LOG} SELECT key, CAST(12 + sum(octet_length(encode(CAST(key AS VARCHAR))) + CASE WHEN type = 1 THEN 5 + octet_length(encode(value)) ELSE 3 END) AS BIGINT) AS bytes FROM log GROUP BY key",
    "kv_group_commit": """WITH RECURSIVE w AS (SELECT user_id AS queue, event_id AS ord, length(props) * 4000 + event_id % 7 * 1000 AS bytes, event_type = 'purchase' AS sync, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (
  SELECT queue, ord, rn, CAST(1 AS BIGINT) AS group_no, bytes AS size, CASE WHEN bytes <= 131072 THEN bytes + 131072 ELSE 1048576 END AS lim, sync AS synced FROM w WHERE rn = 1
  UNION ALL
  SELECT w.queue, w.ord, w.rn,
    CASE WHEN f.size + w.bytes <= f.lim AND NOT (w.sync AND NOT f.synced) THEN f.group_no ELSE f.group_no + 1 END,
    CASE WHEN f.size + w.bytes <= f.lim AND NOT (w.sync AND NOT f.synced) THEN f.size + w.bytes ELSE w.bytes END,
    CASE WHEN f.size + w.bytes <= f.lim AND NOT (w.sync AND NOT f.synced) THEN f.lim WHEN w.bytes <= 131072 THEN w.bytes + 131072 ELSE 1048576 END,
    CASE WHEN f.size + w.bytes <= f.lim AND NOT (w.sync AND NOT f.synced) THEN f.synced ELSE w.sync END
  FROM f JOIN w ON w.queue = f.queue AND w.rn = f.rn + 1)
SELECT queue, group_no, count(*) AS n_writers, min(ord) AS first_ord FROM f GROUP BY queue, group_no""",
    "kv_admission": """SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'fail' WHEN o_orderkey % 2 <> 0 AND o_orderkey % 15 >= 8 THEN 'delay' WHEN o_orderkey % 11 * 500000 <= 4194304 THEN 'write'
WHEN o_orderkey % 5 = 0 THEN 'wait for flush' WHEN o_orderkey % 15 >= 12 THEN 'wait for compaction' ELSE 'switch buffer' END AS action FROM orders""",
    "kv_merge_runs": f"WITH {E_LOG} SELECT key, count(*) AS n, max(seq) AS max_seq, min(seq) AS min_seq FROM log GROUP BY key",
}
QUERIES = {name: globals()[name] for name in SQL}
