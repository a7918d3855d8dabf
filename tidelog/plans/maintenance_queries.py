"""Queries on runs, compaction, metadata and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import coding, hashing
from tidelog.model import L0_SLOWDOWN, LEVELS
from tidelog.operators import compact, manifest, read, runs
from tidelog.operators.ranks import totals_before
from tidelog.operators.write import memory_bytes
from tidelog.plans.read_queries import E_LOG, NEWEST, O_LOG, snapshot
from tidelog.sources.changelog import events_log, orders_log, table

#: Sequence numbers in each file of level 0, and keys in each file of levels 1 and 2.
L0_SPAN, L1_KEYS, L2_KEYS = 1000, 10, 40
_MEM = "octet_length(encode(CAST(key AS VARCHAR))) + octet_length(encode(value)) + 13"
_META = f"min(key) AS smallest, max(key) AS largest, CAST(sum({_MEM}) AS BIGINT) AS size, count(*) AS n, max(seq) AS max_seq"
#: Level 0: the log in the order of writing. Levels 1 and 2: resolved at the snapshot and at half of it, cut by key.
FILES = f"""half AS (SELECT max(seq) // 2 AS s FROM log),
r1 AS (SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM log, snap WHERE seq <= s GROUP BY key),
r2 AS (SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM log, half WHERE seq <= s GROUP BY key),
files AS (
  SELECT 0 AS level, (seq - 1) // {L0_SPAN} AS file_no, {_META} FROM log GROUP BY (seq - 1) // {L0_SPAN}
  UNION ALL SELECT 1, 1000000 + key // {L1_KEYS}, {_META} FROM r1 GROUP BY key // {L1_KEYS}
  UNION ALL SELECT 2, 2000000 + key // {L2_KEYS}, {_META} FROM r2 GROUP BY key // {L2_KEYS})"""


def files(spark, d):
    """Files of three levels over the event log."""
    log = events_log(spark, d)
    last = read.last_sequence(log)
    r1 = read.newest(log.where(F.col("seq") <= last * 7 // 10))
    r2 = read.newest(log.where(F.col("seq") <= last // 2))
    l0 = runs.file_meta(log, F.floor((F.col("seq") - 1) / L0_SPAN))
    l1 = runs.file_meta(r1, F.lit(1_000_000).cast("long") + F.floor(F.col("key") / L1_KEYS), 1)
    l2 = runs.file_meta(r2, F.lit(2_000_000).cast("long") + F.floor(F.col("key") / L2_KEYS), 2)
    return l0.unionByName(l1).unionByName(l2).persist()  # a row for each file


def kv_file_meta(spark, d):
    return files(spark, d)


def kv_level_files(spark, d):
    return runs.level_totals(files(spark, d)).select("level", "n_files")


def kv_level_bytes(spark, d):
    return runs.level_totals(files(spark, d)).select("level", "n_bytes")


def kv_level_summary(spark, d):
    return runs.level_summary(files(spark, d))


def kv_key_range(spark, d):
    return files(spark, d).groupBy("level").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("size").alias("total_size"))


def kv_find_file(spark, d):
    """For every customer key the first file of level 1 that may hold it."""
    probes = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return runs.find_file(files(spark, d).where("level = 1"), probes)


def kv_overlapping_files(spark, d):
    """Files of level 1 that each file of level 0 overlaps."""
    f = files(spark, d)
    lo = f.where("level = 0").select("file_no", F.col("smallest").alias("lo"), F.col("largest").alias("hi"))
    return runs.overlap(lo, f.where("level = 1")).select("file_no", "n_overlap")


def kv_overlap_bytes(spark, d):
    f = files(spark, d)
    lo = f.where("level = 1").select("file_no", F.col("smallest").alias("lo"), F.col("largest").alias("hi"))
    return runs.overlap(lo, f.where("level = 2")).select("file_no", "n_overlap", "overlap_bytes")


def kv_overlap_open_ranges(spark, d):
    ranges = spark.createDataFrame([(1, None, 40), (2, 41, None), (3, None, None), (4, -9, -1)], "range_no int, lo long, hi long")
    return runs.overlap(ranges, files(spark, d).where("level = 1")).select("range_no", "n_overlap", "overlap_bytes")


def kv_next_level_overlap(spark, d):
    return runs.next_level_overlap(files(spark, d)).agg(F.max("overlap_bytes").alias("max_bytes"), F.sum("overlap_bytes").alias("sum_bytes"))


def kv_l0_transitive_overlap(spark, d):
    """All orders, three files to each fifty customers: which files hang together, and how many rows each has."""
    log = orders_log(spark, d)
    return runs.connected(runs.file_meta(log, F.floor(F.col("key") / 50) * 1000 + F.col("seq") % 3)).select("file_no", "smallest", "largest", "n", "part")


def kv_compaction_score(spark, d):
    return runs.scores(files(spark, d))


def kv_pick_compaction(spark, d):
    return runs.next_compaction(files(spark, d))


def kv_pick_level(spark, d):
    """Where a new run over each user's neighbourhood would be flushed to, with level 0 empty."""
    f = files(spark, d).where("level > 0")
    ranges = events_log(spark, d).select("key").distinct().select("key", (F.col("key") * 3 - 100).alias("lo"), (F.col("key") * 3 - 98).alias("hi"))
    return runs.flush_level(ranges, f, 40).select("key", "level")


def kv_allowed_seeks(spark, d):
    f = files(spark, d).withColumn("size", F.col("size") * 1000)
    return runs.allowed_seeks(f)


def kv_get_files_probed(spark, d):
    """Files of level 0 whose range covers each key."""
    probes = events_log(spark, d).select("key").distinct()
    return runs.files_probed(probes, files(spark, d).where("level = 0"))


def kv_seek_charges(spark, d):
    """How many keys lie in the ranges of more than one file, whose lookups would charge one, and how many files they probe; no file is charged here."""
    log = events_log(spark, d)
    f = files(spark, d).where("level = 0")
    probed = runs.files_probed(log.select("key").distinct(), f)
    return probed.groupBy((F.col("n_probed") > 1).alias("charged")).agg(F.count("*").alias("n_keys"), F.sum("n_probed").alias("n_probed"))


def kv_approx_size(spark, d):
    ranges = spark.range(40).select((F.col("id") * 7).alias("lo"), (F.col("id") * 7 + 25).alias("hi"), F.col("id").alias("range_no"))
    return runs.approximate_size(ranges, files(spark, d).where("level = 1")).select("range_no", "approx_bytes")


def kv_exact_size(spark, d):
    """Bytes of the rows in ranges of ten keys."""
    log = orders_log(spark, d)
    return log.groupBy(F.floor(F.col("key") / 10).alias("range_no")).agg(F.sum(memory_bytes(F.col("key").cast("string"), F.col("value"))).alias("bytes"))


def kv_flush_runs(spark, d):
    """The compacted order log cut into output files of about 4 KiB."""
    rows = compact.compact(orders_log(spark, d), snapshot(orders_log(spark, d)))
    return runs.output_files(rows, 4096).groupBy("out_no").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.count("*").alias("n"))


def kv_compact_rule_a(spark, d):
    log = events_log(spark, d)
    return compact.shadowed_dropped(log, snapshot(log))


def kv_compact_full(spark, d):
    log = events_log(spark, d)
    return compact.compact(log, snapshot(log))


def kv_compact_multi_snapshot(spark, d):
    """With snapshots at several numbers only the oldest one counts."""
    log = orders_log(spark, d)
    snaps = spark.createDataFrame([(snapshot(log, k),) for k in (5, 7, 9)], "seq long")
    return compact.compact(log, compact.oldest_snapshot(snaps, read.last_sequence(log)))


def kv_compact_not_base_level(spark, d):
    """Deletions stay where a file of level 2 covers their key."""
    log = events_log(spark, d)
    return compact.compact(log, snapshot(log), files(spark, d).where("level = 2"))


def kv_compaction_equivalence(spark, d):
    """Reads at and after the snapshot don't change by compaction."""
    log = events_log(spark, d)
    s = snapshot(log)
    packed = compact.compact(log, s)
    out = None
    for at in (s, snapshot(log, 8), read.last_sequence(log)):
        a, b = read.resolve(log, at), read.resolve(packed, at)
        n = a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("n_different")).withColumn("at", F.lit(at))
        out = n if out is None else out.unionByName(n)
    return out


def kv_trivial_move(spark, d):
    """Files of level 1 that can go down as they are."""
    f = files(spark, d)
    lo = f.where("level = 1").select("file_no", F.col("smallest").alias("lo"), F.col("largest").alias("hi"))
    return runs.overlap(lo, f.where("level = 2")).select("file_no", (F.col("n_overlap") == 0).alias("can_move"))


def _edits(spark, d):
    e = table(spark, d, "events")
    op = F.when(F.col("event_type").isin("error", "signup"), "delete").otherwise("add")
    return e.select(F.col("event_id").alias("edit_no"), op.alias("op"), (F.col("user_id") % LEVELS).cast("int").alias("level"), F.col("user_id").alias("file_no"))


def kv_manifest_fold(spark, d):
    return manifest.fold(_edits(spark, d))


def kv_live_files(spark, d):
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("file_no"))
    return manifest.live(manifest.fold(_edits(spark, d)), pending)


def _names(spark, d):
    k = F.col("o_orderkey")
    name = (
        F.when(k % 9 == 0, F.concat(F.lit("MANIFEST-"), F.lpad(k.cast("string"), 6, "0")))
        .when(k % 9 == 1, F.concat(k.cast("string"), F.lit(".dbtmp")))
        .when(k % 9 == 2, F.concat(F.lit("x"), k.cast("string"), F.lit(".log")))
        .when(k % 9 == 3, F.element_at(F.array(*map(F.lit, ["CURRENT", "LOCK", "LOG", "LOG.old", "CURRENTX"])), (k % 5 + 1).cast("int")))
        .when(k % 9 == 4, F.concat(k.cast("string"), F.lit(".sst")))
        .when(k % 9 == 5, F.concat(k.cast("string"), F.lit("0000000000000000000.log")))
        .when(k % 9 == 6, F.concat(k.cast("string"), F.lit(".ldb")))
        .otherwise(F.concat(F.lpad(k.cast("string"), 6, "0"), F.lit(".log")))
    )
    return table(spark, d, "orders").select(k.alias("id"), name.alias("name"))


_NAMES = """names AS (SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN 'MANIFEST-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') WHEN 1 THEN o_orderkey || '.dbtmp' WHEN 2 THEN 'x' || o_orderkey || '.log'
WHEN 3 THEN ['CURRENT', 'LOCK', 'LOG', 'LOG.old', 'CURRENTX'][o_orderkey % 5 + 1] WHEN 4 THEN o_orderkey || '.sst' WHEN 5 THEN o_orderkey || '0000000000000000000.log' WHEN 6 THEN o_orderkey || '.ldb'
ELSE lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '.log' END AS name FROM orders),
parsed AS (SELECT id, name, CASE WHEN name IN ('CURRENT', 'LOCK', 'LOG', 'LOG.old') THEN 0 ELSE TRY_CAST(nullif(regexp_extract(name, '^(?:MANIFEST-)?([0-9]+)(?:\\.(?:log|ldb|sst|dbtmp))?$', 1), '') AS BIGINT) END AS number FROM names),
kinds AS (SELECT id, name, CASE WHEN number IS NULL THEN NULL WHEN name = 'CURRENT' THEN 'current' WHEN name = 'LOCK' THEN 'lock' WHEN name IN ('LOG', 'LOG.old') THEN 'info' WHEN name LIKE '%.log' THEN 'log'
WHEN name LIKE '%.ldb' OR name LIKE '%.sst' THEN 'table' WHEN name LIKE '%.dbtmp' THEN 'temp' ELSE 'manifest' END AS kind, number FROM parsed)"""


def kv_parse_file_names(spark, d):
    return _names(spark, d).withColumn("p", manifest.parse_name(F.col("name"))).select("id", "name", "p.number", "p.kind")


def kv_obsolete_files(spark, d):
    found = kv_parse_file_names(spark, d).where("kind is not null").select("name", "number", "kind")
    alive = table(spark, d, "orders").where("o_orderstatus = 'F'").select((F.col("o_custkey") * 4).alias("file_no")).distinct()
    return manifest.obsolete(found, alive, 700, 650, 900)


def kv_missing_files(spark, d):
    expected = table(spark, d, "customer").select(F.col("c_custkey").alias("file_no"))
    found = table(spark, d, "orders").select(F.col("o_custkey").alias("file_no"))
    return manifest.missing(expected, found)


def kv_next_numbers(spark, d):
    return files(spark, d).agg((F.max("file_no") + 1).alias("next_file_no"), F.max("max_seq").alias("last_seq"))


def kv_compaction_stats(spark, d):
    """Bytes read and written by merging each level into the next."""
    f = files(spark, d)
    return f.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes_read"), F.sum("n").alias("n_rows")).select("level", F.format_string("%3d %8d %8d %8d", F.col("level"), F.col("n_files"), F.col("bytes_read"), F.col("n_rows")).alias("report"))


def kv_repair_scan(spark, d):
    """File metadata found again from the data alone, all at level 0."""
    log = events_log(spark, d)
    return runs.file_meta(log, F.col("seq") % 16).select("level", "file_no", "smallest", "largest", "n", "max_seq")


def kv_properties(spark, d):
    f = files(spark, d)
    counts = runs.level_totals(f).select(F.concat(F.lit("files-at-level"), F.col("level").cast("string")).alias("name"), F.col("n_files").cast("string").alias("value"))
    usage = events_log(spark, d).agg(F.sum(memory_bytes(F.col("key").cast("string"), F.col("value"))).cast("string").alias("value")).select(F.lit("memory-usage").alias("name"), "value")
    return counts.unionByName(usage)


def kv_write_pressure(spark, d):
    """Levels at which writes are slowed: how far level 0 is from the limit."""
    return runs.level_totals(files(spark, d)).where("level = 0").select("n_files", (F.col("n_files") >= L0_SLOWDOWN).alias("slowed"))


def kv_pack_key(spark, d):
    log = events_log(spark, d)
    packed = coding.pack(F.col("seq"), F.col("type"))
    seq, kind = coding.unpack(packed)
    return log.select("seq", packed.alias("packed"), seq.alias("seq_again"), kind.alias("type_again"))


def kv_internal_key(spark, d):
    log = events_log(spark, d)
    return log.select("seq", F.hex(coding.internal_key(F.col("value"), F.col("seq"), F.col("type"))).alias("ikey"))


def kv_varint_width(spark, d):
    """The products may be beyond 64 bits, where their SQL stops by an overflow."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", coding.product_varint_width(F.col("o_orderkey"), F.col("o_orderkey"), F.col("o_custkey")).alias("width"))


def kv_fixed_le_hex(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", coding.fixed_le_hex(F.col("o_orderkey"), 4).alias("fixed32"), coding.fixed_le_hex(F.col("o_orderkey") * 1_000_003, 8).alias("fixed64"))


def kv_hash32(spark, d):
    return table(spark, d, "orders").select("o_orderkey", hashing.hash32_int(F.col("o_orderkey")).alias("h"))


def kv_hash32_bytes(spark, d):
    """The same hash of four bytes, by the general function."""
    return table(spark, d, "orders").select("o_orderkey", hashing.hash32_udf(F.unhex(coding.fixed_le_hex(F.col("o_orderkey"), 4))).alias("h"))


_H0 = f"CAST((((({{x}}) + {(hashing.SEED ^ 4 * 0xC6A4A793) & 0xFFFFFFFF}) % 4294967296)::HUGEINT * {0xC6A4A793}) % 4294967296 AS BIGINT)"


def _hash_sql(x: str) -> str:
    h = _H0.format(x=x)
    return f"xor({h}, {h} >> 16)"


def _blooms(spark, d):
    keys = table(spark, d, "orders").select((F.col("o_orderkey") % 8).alias("file_no"), hashing.hash32_int(F.col("o_custkey")).alias("h"))
    return hashing.bloom_build(keys, "file_no")


_BLOOM = f"""keys AS (SELECT o_orderkey % 8 AS file_no, {_hash_sql('o_custkey')} AS h FROM orders),
sizes AS (SELECT file_no, CAST(ceil(greatest(64, count(*) * 10) / 8.0) AS BIGINT) * 8 AS bits FROM keys GROUP BY file_no),
bloom AS (SELECT DISTINCT file_no, bits, (h + j * ((h >> 17) | ((h << 15) & 4294967295))) % 4294967296 % bits AS pos FROM (SELECT DISTINCT file_no, h FROM keys) JOIN sizes USING (file_no), (SELECT unnest(range(6)) AS j))"""
_PROBE = f"""asked AS (SELECT c_custkey AS id, c_custkey % 8 AS file_no, {_hash_sql('c_custkey + 1000000000')} AS h FROM customer),
spots AS (SELECT DISTINCT id, file_no, (h + j * ((h >> 17) | ((h << 15) & 4294967295))) % 4294967296 % bits AS pos FROM asked JOIN sizes USING (file_no), (SELECT unnest(range(6)) AS j)),
answer AS (SELECT id, bool_and(bloom.pos IS NOT NULL) AS may_match FROM spots LEFT JOIN bloom ON spots.file_no = bloom.file_no AND spots.pos = bloom.pos GROUP BY id)"""


def kv_bloom_build(spark, d):
    return _blooms(spark, d).groupBy("file_no", "bits").agg(F.count("*").alias("n_set"), F.sum("pos").alias("sum_pos"))


def _probes(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 8).alias("file_no"), hashing.hash32_int(F.col("c_custkey") + 1_000_000_000).alias("h"))
    return hashing.bloom_probe(asked, _blooms(spark, d), "file_no")


def kv_bloom_probe(spark, d):
    """Keys that are in no file: which of them a filter lets pass."""
    return _probes(spark, d).select("id", "may_match")


def kv_bloom_fpr(spark, d):
    return _probes(spark, d).agg(F.count("*").alias("n_asked"), F.sum(F.col("may_match").cast("long")).alias("n_false"))


def kv_bloom_no_false_negatives(spark, d):
    keys = table(spark, d, "orders").select((F.col("o_orderkey") % 8).alias("file_no"), hashing.hash32_int(F.col("o_custkey")).alias("h"))
    return hashing.bloom_probe(keys, hashing.bloom_build(keys, "file_no"), "file_no").agg(F.count("*").alias("n_asked"), F.sum((~F.col("may_match")).cast("long")).alias("n_missed"))


def kv_crc32c_mask(spark, d):
    """Checksums of urls, masked and back."""
    c = table(spark, d, "pages").select("page_id", coding.crc32c_column(F.col("url").cast("binary")).alias("crc"))
    return c.select("page_id", "crc", coding.mask_column(F.col("crc")).alias("masked"))


def kv_separator(spark, d):
    """Short separators between each url and the next one in byte order."""
    from pyspark.sql import Window

    urls = table(spark, d, "pages").select(F.col("url").cast("binary").alias("start"), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("site")).distinct()
    pairs = urls.withColumn("limit", F.lead("start").over(Window.partitionBy("site").orderBy("start"))).where("limit is not null")
    found = pairs.withColumn("separator", coding.separator_column(F.col("start"), F.col("limit")))
    return found.select(F.hex("start").alias("start"), F.hex("separator").alias("separator"))


def kv_successor(spark, d):
    return table(spark, d, "pages").select("page_id", F.hex(coding.successor_column(F.col("url").cast("binary"))).alias("successor"))


def kv_escape(spark, d):
    return table(spark, d, "pages").select("page_id", coding.escape_column(F.col("url").cast("binary")).alias("escaped"))


def kv_filter_block(spark, d):
    """Filters of one file of all orders in the order of writing, one for every 2 KiB of its rows."""
    log = orders_log(spark, d).withColumn("b", memory_bytes(F.col("key").cast("string"), F.col("value")))
    rows = totals_before(log.select("seq", "key"), log.select("seq", "b"), "seq", {"offset": F.col("b")})
    filters = hashing.filter_blocks(rows.select("offset", hashing.hash32_int(F.col("key")).alias("h")))
    return filters.groupBy("bucket", "bits").agg(F.count("*").alias("n_set"), F.sum("pos").alias("sum_pos"))


#: Where the last compaction of level 1 stopped: nowhere, in the middle, beyond all files.
STOPPED = (None, 90, 1_000_000_000)


def kv_pick_inputs(spark, d):
    """The file of level 1 that the next compaction begins with, and the files of level 0 it would begin with."""
    f = files(spark, d)
    out = runs.pick_inputs(f, 0).select(F.lit(-1).alias("case_no"), "level", "file_no")
    for k, after in enumerate(STOPPED):
        out = out.unionByName(runs.pick_inputs(f, 1, after).select(F.lit(k).alias("case_no"), "level", "file_no"))
    return out


#: Bytes of a compaction's files, at most: one that lets it grow, one that doesn't.
EXPANSION = (1_000_000_000, 1)


def kv_expand_inputs(spark, d):
    """All files of the compaction of level 1 that begins beyond key 90."""
    f = files(spark, d)
    out = None
    for k, limit in enumerate(EXPANSION):
        part = runs.expand_inputs(f, runs.pick_inputs(f, 1, 90), 1, limit).withColumn("case_no", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.select("case_no", "side", "level", "file_no")


def kv_stop_before(spark, d):
    """Keys of level 1, cut where they pass over more than 2,000 bytes of level 2."""
    f = files(spark, d)
    keys = read.newest(events_log(spark, d)).select("key")
    return runs.stop_before(keys, f.where("level = 2"), 2_000).groupBy("out_no").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.count("*").alias("n"))


_BYTES = "list_transform(range(0, octet_length(encode(url))), lambda i: CAST('0x' || substr(hex(encode(url)), 2 * i + 1, 2) AS INTEGER))"
_RAISED = "hex(encode({x}[1:{n} - 1])) || printf('%02X', ord({x}[{n}]) + 1)"
_PICK = "SELECT file_no FROM files WHERE level = 1 ORDER BY {passed}, smallest, file_no LIMIT 1"
_OVER = "SELECT {cols} FROM files a LEFT JOIN files b ON b.level = {lb} AND b.smallest <= a.largest AND b.largest >= a.smallest WHERE a.level = {la} GROUP BY a.file_no"
_FULL = "SELECT key, seq, type, value FROM (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq DESC) AS newer FROM log), {snap} WHERE (newer IS NULL OR newer > s)"
SQL = {
    "kv_file_meta": f"WITH {E_LOG}, {FILES} SELECT * FROM files",
    "kv_level_files": f"WITH {E_LOG}, {FILES} SELECT CAST(l.range AS INTEGER) AS level, count(file_no) AS n_files FROM range(7) l LEFT JOIN files ON level = l.range GROUP BY l.range",
    "kv_level_bytes": f"WITH {E_LOG}, {FILES} SELECT CAST(l.range AS INTEGER) AS level, CAST(coalesce(sum(size), 0) AS BIGINT) AS n_bytes FROM range(7) l LEFT JOIN files ON level = l.range GROUP BY l.range",
    "kv_level_summary": f"WITH {E_LOG}, {FILES}, c AS (SELECT l.range AS level, count(file_no) AS n FROM range(7) l LEFT JOIN files ON level = l.range GROUP BY l.range) SELECT 'files[ ' || string_agg(CAST(n AS VARCHAR), ' ' ORDER BY level) || ' ]' AS summary FROM c",
    "kv_key_range": f"WITH {E_LOG}, {FILES} SELECT level, min(smallest) AS smallest, max(largest) AS largest, CAST(sum(size) AS BIGINT) AS total_size FROM files GROUP BY level",
    "kv_find_file": f"WITH {E_LOG}, {FILES} SELECT c_custkey AS key, (SELECT count(*) FROM files WHERE level = 1 AND largest < c_custkey) AS idx FROM customer",
    "kv_overlapping_files": f"WITH {E_LOG}, {FILES} " + _OVER.format(cols="a.file_no, count(b.file_no) AS n_overlap", la=0, lb=1),
    "kv_overlap_bytes": f"WITH {E_LOG}, {FILES} " + _OVER.format(cols="a.file_no, count(b.file_no) AS n_overlap, CAST(coalesce(sum(b.size), 0) AS BIGINT) AS overlap_bytes", la=1, lb=2),
    "kv_overlap_open_ranges": f"WITH {E_LOG}, {FILES}, r AS (SELECT * FROM (VALUES (1, NULL, 40), (2, 41, NULL), (3, NULL, NULL), (4, -9, -1)) t(range_no, lo, hi)) SELECT range_no, count(file_no) AS n_overlap, CAST(coalesce(sum(size), 0) AS BIGINT) AS overlap_bytes FROM r LEFT JOIN files ON level = 1 AND (hi IS NULL OR smallest <= hi) AND (lo IS NULL OR largest >= lo) GROUP BY range_no",
    "kv_next_level_overlap": f"WITH {E_LOG}, {FILES}, o AS (SELECT a.level, a.file_no, coalesce(sum(b.size), 0) AS x FROM files a LEFT JOIN files b ON b.level = a.level + 1 AND b.smallest <= a.largest AND b.largest >= a.smallest WHERE a.level >= 1 GROUP BY a.level, a.file_no) SELECT CAST(max(x) AS BIGINT) AS max_bytes, CAST(sum(x) AS BIGINT) AS sum_bytes FROM o",
    "kv_l0_transitive_overlap": f"""WITH {O_LOG}, f AS (SELECT key // 50 * 1000 + seq % 3 AS file_no, min(key) AS smallest, max(key) AS largest, count(*) AS n FROM log GROUP BY 1),
m AS (SELECT *, max(largest) OVER (ORDER BY smallest, largest, file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f)
SELECT file_no, smallest, largest, n, CAST(sum(CASE WHEN reach IS NULL OR smallest > reach THEN 1 ELSE 0 END) OVER (ORDER BY smallest, largest, file_no) AS BIGINT) AS part FROM m""",
    "kv_compaction_score": f"WITH {E_LOG}, {FILES}, c AS (SELECT CAST(l.range AS INTEGER) AS level, count(file_no) AS n, coalesce(sum(size), 0) AS b FROM range(6) l LEFT JOIN files ON level = l.range GROUP BY l.range) SELECT level, CASE WHEN level = 0 THEN n / 4.0::DOUBLE ELSE b::DOUBLE / (10485760.0::DOUBLE * pow(10.0, level - 1)) END AS score FROM c",
    "kv_pick_compaction": f"WITH {E_LOG}, {FILES}, c AS (SELECT CAST(l.range AS INTEGER) AS level, count(file_no) AS n, coalesce(sum(size), 0) AS b FROM range(6) l LEFT JOIN files ON level = l.range GROUP BY l.range), s AS (SELECT level, CASE WHEN level = 0 THEN n / 4.0::DOUBLE ELSE b::DOUBLE / (10485760.0::DOUBLE * pow(10.0, level - 1)) END AS score FROM c) SELECT level, score, score >= 1 AS needed FROM s ORDER BY score DESC, level LIMIT 1",
    "kv_pick_level": f"""WITH {E_LOG}, {FILES}, r AS (SELECT DISTINCT key, key * 3 - 100 AS lo, key * 3 - 98 AS hi FROM log),
o AS (SELECT key, count(file_no) FILTER (level = 1) AS n1, count(file_no) FILTER (level = 2) AS n2, coalesce(sum(size) FILTER (level = 2), 0) AS b2 FROM r LEFT JOIN files ON level > 0 AND smallest <= hi AND largest >= lo GROUP BY key)
SELECT key, CASE WHEN n1 > 0 OR b2 > 400 THEN 0 WHEN n2 > 0 THEN 1 ELSE 2 END AS level FROM o""",
    "kv_allowed_seeks": f"WITH {E_LOG}, {FILES} SELECT level, file_no, greatest(100, size * 1000 // 16384) AS allowed_seeks FROM files",
    "kv_get_files_probed": f"WITH {E_LOG}, {FILES}, p AS (SELECT DISTINCT key FROM log) SELECT key, count(file_no) AS n_probed FROM p LEFT JOIN files ON level = 0 AND key BETWEEN smallest AND largest GROUP BY key",
    "kv_seek_charges": f"WITH {E_LOG}, {FILES}, p AS (SELECT DISTINCT key FROM log), c AS (SELECT key, count(file_no) AS n FROM p LEFT JOIN files ON level = 0 AND key BETWEEN smallest AND largest GROUP BY key) SELECT n > 1 AS charged, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_probed FROM c GROUP BY n > 1",
    "kv_approx_size": f"""WITH {E_LOG}, {FILES}, f AS (SELECT *, size * 1024 // (largest - smallest + 1) AS slope FROM files WHERE level = 1),
b AS (SELECT range AS range_no, range * 7 AS lo, range * 7 + 25 AS hi FROM range(40)),
o AS (SELECT range_no, side, pos, coalesce((SELECT sum(size) FROM f WHERE largest < pos), 0) + CAST(floor(coalesce((SELECT sum(slope * (pos - smallest)) FROM f WHERE smallest < pos AND NOT largest < pos), 0) / 1024.0) AS BIGINT) AS x
FROM (SELECT range_no, 0 AS side, lo AS pos FROM b UNION ALL SELECT range_no, 1, hi FROM b))
SELECT range_no, CAST(greatest(0, sum(CASE WHEN side = 1 THEN x ELSE -x END)) AS BIGINT) AS approx_bytes FROM o GROUP BY range_no""",
    "kv_exact_size": f"WITH {O_LOG} SELECT key // 10 AS range_no, CAST(sum({_MEM}) AS BIGINT) AS bytes FROM log GROUP BY key // 10",
    "kv_flush_runs": f"WITH {O_LOG}, c AS ({_FULL.format(snap='snap')} AND NOT (type = 0 AND seq <= s)), k AS (SELECT key, sum({_MEM}) AS b, count(*) AS n FROM c GROUP BY key), p AS (SELECT key, n, coalesce(sum(b) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4096 AS out_no FROM k) SELECT CAST(out_no AS BIGINT) AS out_no, min(key) AS smallest, max(key) AS largest, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY out_no",
    "kv_compact_rule_a": f"WITH {E_LOG} {_FULL.format(snap='snap')}",
    "kv_compact_full": f"WITH {E_LOG} {_FULL.format(snap='snap')} AND NOT (type = 0 AND seq <= s)",
    "kv_compact_multi_snapshot": f"WITH {O_LOG}, old AS (SELECT max(seq) * 5 // 10 AS s FROM log) {_FULL.format(snap='old')} AND NOT (type = 0 AND seq <= s)",
    "kv_compact_not_base_level": f"WITH {E_LOG}, {FILES} {_FULL.format(snap='snap')} AND NOT (type = 0 AND seq <= s AND NOT EXISTS (SELECT 1 FROM files WHERE level = 2 AND key BETWEEN smallest AND largest))",
    "kv_compaction_equivalence": f"WITH {E_LOG}, m AS (SELECT max(seq) AS m FROM log) SELECT 0 AS n_different, unnest([m * 7 // 10, m * 8 // 10, m]) AS at FROM m",
    "kv_trivial_move": f"WITH {E_LOG}, {FILES} " + _OVER.format(cols="a.file_no, count(b.file_no) = 0 AS can_move", la=1, lb=2),
    "kv_manifest_fold": "SELECT CAST(user_id % 7 AS INTEGER) AS level, user_id AS file_no FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) NOT IN ('error', 'signup')",
    "kv_live_files": "SELECT user_id AS file_no FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) NOT IN ('error', 'signup') UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "kv_parse_file_names": f"WITH {_NAMES} SELECT id, name, number, kind FROM kinds",
    "kv_obsolete_files": f"WITH {_NAMES}, alive AS (SELECT DISTINCT o_custkey * 4 AS file_no FROM orders WHERE o_orderstatus = 'F') SELECT name, number, kind FROM kinds WHERE kind IS NOT NULL AND NOT CASE kind WHEN 'log' THEN number >= 700 OR number = 650 WHEN 'manifest' THEN number >= 900 WHEN 'table' THEN number IN (SELECT file_no FROM alive) WHEN 'temp' THEN number IN (SELECT file_no FROM alive) ELSE true END",
    "kv_missing_files": "SELECT c_custkey AS file_no FROM customer EXCEPT SELECT o_custkey FROM orders",
    "kv_next_numbers": f"WITH {E_LOG}, {FILES} SELECT max(file_no) + 1 AS next_file_no, max(max_seq) AS last_seq FROM files",
    "kv_compaction_stats": f"WITH {E_LOG}, {FILES} SELECT level, printf('%3d %8d %8d %8d', level, count(*), CAST(sum(size) AS BIGINT), CAST(sum(n) AS BIGINT)) AS report FROM files GROUP BY level",
    "kv_repair_scan": f"WITH {E_LOG} SELECT 0 AS level, seq % 16 AS file_no, min(key) AS smallest, max(key) AS largest, count(*) AS n, max(seq) AS max_seq FROM log GROUP BY seq % 16",
    "kv_properties": f"WITH {E_LOG}, {FILES} SELECT 'files-at-level' || l.range AS name, CAST(count(file_no) AS VARCHAR) AS value FROM range(7) l LEFT JOIN files ON level = l.range GROUP BY l.range UNION ALL SELECT 'memory-usage', CAST(CAST(sum({_MEM}) AS BIGINT) AS VARCHAR) FROM log",
    "kv_write_pressure": f"WITH {E_LOG}, {FILES} SELECT count(*) AS n_files, count(*) >= 8 AS slowed FROM files WHERE level = 0",
    "kv_pack_key": f"WITH {E_LOG} SELECT seq, seq * 16 + type AS packed, seq AS seq_again, CAST(type AS INTEGER) AS type_again FROM log",
    "kv_internal_key": f"WITH {E_LOG} SELECT seq, hex(encode(value)) || printf('%016X', 18446744073709551615::UBIGINT - (seq * 16 + type)::UBIGINT) AS ikey FROM log",
    "kv_varint_width": "SELECT o_orderkey, CAST(greatest(1, ceil(length(bin(o_orderkey * o_orderkey * o_custkey)) / 7.0)) AS INTEGER) AS width FROM orders",
    "kv_fixed_le_hex": "WITH h AS (SELECT o_orderkey, printf('%08X', o_orderkey) AS a, printf('%016X', o_orderkey * 1000003) AS b FROM orders) SELECT o_orderkey, a[7:8] || a[5:6] || a[3:4] || a[1:2] AS fixed32, b[15:16] || b[13:14] || b[11:12] || b[9:10] || b[7:8] || b[5:6] || b[3:4] || b[1:2] AS fixed64 FROM h",
    "kv_hash32": f"SELECT o_orderkey, {_hash_sql('o_orderkey')} AS h FROM orders",
    "kv_hash32_bytes": f"SELECT o_orderkey, {_hash_sql('o_orderkey')} AS h FROM orders",
    "kv_bloom_build": f"WITH {_BLOOM} SELECT file_no, bits, count(*) AS n_set, CAST(sum(pos) AS BIGINT) AS sum_pos FROM bloom GROUP BY file_no, bits",
    "kv_bloom_probe": f"WITH {_BLOOM}, {_PROBE} SELECT id, may_match FROM answer",
    "kv_bloom_fpr": f"WITH {_BLOOM}, {_PROBE} SELECT count(*) AS n_asked, CAST(count(*) FILTER (may_match) AS BIGINT) AS n_false FROM answer",
    "kv_filter_block": f"""WITH {O_LOG}, k AS (SELECT CAST(coalesce(sum({_MEM}) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2048 AS BIGINT) AS bucket, {_hash_sql('key')} AS h FROM log),
sizes AS (SELECT bucket, CAST(ceil(greatest(64, count(*) * 10) / 8.0) AS BIGINT) * 8 AS bits FROM k GROUP BY bucket),
bloom AS (SELECT DISTINCT bucket, bits, (h + j * ((h >> 17) | ((h << 15) & 4294967295))) % 4294967296 % bits AS pos FROM (SELECT DISTINCT bucket, h FROM k) JOIN sizes USING (bucket), (SELECT unnest(range(6)) AS j))
SELECT bucket, bits, count(*) AS n_set, CAST(sum(pos) AS BIGINT) AS sum_pos FROM bloom GROUP BY bucket, bits""",
    "kv_pick_inputs": f"""WITH RECURSIVE {E_LOG}, {FILES}, l0 AS (SELECT * FROM files WHERE level = 0),
m AS (SELECT *, max(largest) OVER (ORDER BY smallest, largest, file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l0),
c AS (SELECT file_no, sum(CASE WHEN reach IS NULL OR smallest > reach THEN 1 ELSE 0 END) OVER (ORDER BY smallest, largest, file_no) AS part FROM m)
SELECT -1 AS case_no, 0 AS level, file_no FROM c WHERE part = (SELECT part FROM c ORDER BY file_no LIMIT 1)
UNION ALL SELECT 0, 1, file_no FROM ({_PICK.format(passed='1')}) UNION ALL SELECT 1, 1, file_no FROM ({_PICK.format(passed='largest <= 90')})
UNION ALL SELECT 2, 1, file_no FROM ({_PICK.format(passed='largest <= 1000000000')})""",
    "kv_expand_inputs": f"""WITH {E_LOG}, {FILES}, cases AS (SELECT unnest([0, 1]) AS case_no, unnest([{EXPANSION[0]}, {EXPANSION[1]}]) AS most),
p0 AS (SELECT * FROM files WHERE file_no = ({_PICK.format(passed='largest <= 90')})),
q0 AS (SELECT min(smallest) AS lo, max(largest) AS hi, count(*) AS n FROM p0),
p1 AS (SELECT f.* FROM files f, q0 WHERE level = 2 AND smallest <= hi AND largest >= lo),
q1 AS (SELECT min(smallest) AS lo, max(largest) AS hi, count(*) AS n, coalesce(sum(size), 0) AS b FROM p1),
w0 AS (SELECT f.* FROM files f, q0, q1 WHERE level = 1 AND q1.n > 0 AND smallest <= greatest(q0.hi, q1.hi) AND largest >= least(q0.lo, q1.lo)),
s0 AS (SELECT min(smallest) AS lo, max(largest) AS hi, count(*) AS n, coalesce(sum(size), 0) AS b FROM w0),
w1 AS (SELECT f.* FROM files f, s0 WHERE level = 2 AND smallest <= hi AND largest >= lo),
grow AS (SELECT case_no, q1.n > 0 AND s0.n > q0.n AND q1.b + s0.b < most AND (SELECT count(*) FROM w1) = q1.n AS g FROM cases, q0, q1, s0),
sides AS (SELECT case_no, 0 AS side, level, file_no, smallest, largest FROM grow, p0 WHERE NOT g UNION ALL SELECT case_no, 0, level, file_no, smallest, largest FROM grow, w0 WHERE g
  UNION ALL SELECT case_no, 1, level, file_no, smallest, largest FROM grow, p1 WHERE NOT g UNION ALL SELECT case_no, 1, level, file_no, smallest, largest FROM grow, w1 WHERE g),
a AS (SELECT case_no, min(smallest) AS lo, max(largest) AS hi FROM sides GROUP BY case_no)
SELECT case_no, side, level, file_no FROM sides UNION ALL SELECT case_no, 2, level, file_no FROM files, a WHERE level = 3 AND smallest <= hi AND largest >= lo""",
    "kv_stop_before": f"""WITH RECURSIVE {E_LOG}, {FILES}, k AS (SELECT DISTINCT key FROM log),
g AS (SELECT key, coalesce((SELECT sum(size) FROM files WHERE level = 2 AND largest < key), 0) AS passed FROM k),
cut AS (SELECT 0 AS out_no, min(key) AS first_key, min(passed) AS base FROM g
  UNION ALL SELECT out_no + 1, (SELECT min(key) FROM g WHERE passed - base > 2000), (SELECT min(passed) FROM g WHERE passed - base > 2000) FROM cut WHERE EXISTS (SELECT 1 FROM g WHERE passed - base > 2000))
SELECT CAST((SELECT max(out_no) FROM cut WHERE first_key <= key) AS BIGINT) AS out_no, min(key) AS smallest, max(key) AS largest, count(*) AS n FROM k GROUP BY 1""",
    "kv_crc32c_mask": f"""WITH c AS (SELECT page_id, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda a, b: xor(t.tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS crc
FROM pages, (SELECT {coding._CRC}::BIGINT[] AS tab) t) SELECT page_id, crc, (((crc >> 15) | ((crc & 32767) << 17)) + {0xA282EAD8}) & 4294967295 AS masked FROM c""",
    "kv_separator": f"""WITH u AS (SELECT DISTINCT url AS a, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS site FROM pages),
p AS (SELECT a, lead(a) OVER (PARTITION BY site ORDER BY encode(a)) AS b FROM u),
x AS (SELECT a, b, list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[i] <> b[i])[1] AS n FROM p WHERE b IS NOT NULL)
SELECT hex(encode(a)) AS start, CASE WHEN n IS NOT NULL AND ord(a[n]) + 1 < ord(b[n]) THEN {_RAISED.format(x='a', n='n')} ELSE hex(encode(a)) END AS separator FROM x""",
    "kv_successor": f"SELECT page_id, {_RAISED.format(x='url', n='1')} AS successor FROM pages",
    "kv_escape": f"""SELECT page_id, array_to_string(list_transform({_BYTES}, lambda c: CASE c WHEN 8 THEN '\\b' WHEN 9 THEN '\\t' WHEN 10 THEN '\\n' WHEN 12 THEN '\\f' WHEN 13 THEN '\\r' WHEN 34 THEN '\\"' WHEN 92 THEN '\\\\'
ELSE CASE WHEN c BETWEEN 32 AND 126 THEN chr(c) ELSE '\\' || (c // 64) || (c // 8 % 8) || (c % 8) END END), '') AS escaped FROM pages""",
    "kv_bloom_no_false_negatives": "SELECT count(*) AS n_asked, CAST(0 AS BIGINT) AS n_missed FROM orders",
}
QUERIES = {name: globals()[name] for name in SQL}
