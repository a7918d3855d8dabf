"""Invariants of reads, compaction, run metadata, manifests and positions."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import compact, manifest, merge, ranks, read, runs, write

LOG = "key long, seq long, type int, value string"


@pytest.fixture(scope="module")
def log(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(30) if rnd.random() < 0.7 else 7, s, 0 if rnd.random() < 0.3 else 1, f"v{s}") for s in range(1, 401)]
    return spark.createDataFrame(rows, LOG).persist()


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def brute(log, s):
    out = {}
    for r in sorted(log.collect(), key=lambda r: r["seq"]):
        if r["seq"] <= s:
            out[r["key"]] = r
    return {k: r["value"] for k, r in out.items() if r["type"]}


@pytest.mark.parametrize("s", [0, 1, 57, 399, 400])
def test_scan_and_get(log, s):
    want = brute(log, s)
    got = read.scan(log, s).collect()
    assert {r["key"]: r["value"] for r in got} == want
    assert [r["key"] for r in got] == sorted(want)
    for k in (7, 3, 99):
        found = read.get(log, k, s).collect()
        assert [r["value"] for r in found] == ([want[k]] if k in want else [])


def test_tombstones_multi_get_and_ranges(spark, log):
    want = brute(log, 300)
    keys = spark.createDataFrame([(k,) for k in (1, 1, 7, 50)], "key long")
    assert rows(read.multi_get(log, keys, 300), "key", "value") == sorted([(k, want.get(k)) for k in (1, 1, 7, 50)], key=str)
    full = read.resolve(log, 300, include_tombstones=True).collect()
    assert {r["key"] for r in full if r["value"] is not None} == set(want)
    assert [r["key"] for r in read.scan(log, 300, 5, 9, reverse=True).collect()] == sorted((k for k in want if 5 <= k <= 9), reverse=True)


def test_as_of_and_diff(spark, log):
    probes = spark.createDataFrame([(k, at) for k in (7, 3, 40) for at in (0, 50, 200, 500)], "key long, at long")
    for r in read.as_of(log, probes).collect():
        assert r["value"] == brute(log, r["at"]).get(r["key"])
    a, b = brute(log, 150), brute(log, 380)
    got = {r["key"]: (r["change"], r["old_value"], r["new_value"]) for r in read.diff(log, 150, 380).collect()}
    want = {k: ("added" if k not in a else "removed" if k not in b else "changed", a.get(k), b.get(k)) for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    assert got == want


def test_compaction(log):
    packed = compact.compact(log, 250).persist()
    for s in (250, 300, 400):
        assert rows(read.resolve(log, s), "key", "seq", "value") == rows(read.resolve(packed, s), "key", "seq", "value")
    assert rows(compact.compact(packed, 250), "key", "seq") == rows(packed, "key", "seq")
    assert packed.count() < log.count()


def test_deletion_over_deeper_file(spark):
    log = spark.createDataFrame([(1, 5, 0, None), (2, 6, 0, None), (9, 7, 0, None)], LOG)
    deeper = spark.createDataFrame([(2, 4), (8, 8)], "smallest long, largest long")
    assert rows(compact.compact(log, 10, deeper), "key") == [(2,)]


def test_merge_keeps_all(log):
    parts = [log.where(F.col("seq") % 3 == k) for k in range(3)]
    got = merge.merge(*parts).collect()
    assert len(got) == 400
    assert [(r["key"], -r["seq"]) for r in got] == sorted((r["key"], -r["seq"]) for r in got)


def test_positions_and_totals(spark):
    rnd = random.Random(1)
    marks = [(rnd.randrange(-50, 50), rnd.randrange(9)) for _ in range(80)]
    points = [rnd.randrange(-500, 500) for _ in range(60)] + [3, 3]
    m = spark.createDataFrame(marks, "at long, w long")
    p = spark.createDataFrame([(x,) for x in points], "at long")
    for inclusive in (False, True):
        got = rows(ranks.totals_before(p, m, "at", {"s": F.col("w")}, inclusive, buckets=7), "at", "s")
        want = sorted(((x, sum(w for a, w in marks if a < x or inclusive and a == x)) for x in points), key=str)
        assert got == want
    d = spark.createDataFrame([(x,) for x in range(0, 1000, 7)], "ord long")
    assert [r["seq"] for r in write.sequence(d, 100).orderBy("ord").collect()] == list(range(101, 101 + 143))
    assert ranks.totals_before(p, m.limit(0), "at", {"s": F.col("w")}).agg(F.sum("s")).first()[0] == 0
    assert write.sequence(d.limit(0), 0).count() == 0


FILES = "level int, file_no long, smallest long, largest long, size long"


@pytest.mark.parametrize(("files", "disjoint"), [([], True), ([(150, 200), (200, 250), (300, 350), (400, 450)], True), ([(150, 600), (400, 500)], False), ([(5, 5)], True)])
def test_overlap_and_find(spark, files, disjoint):
    f = spark.createDataFrame([(1, i, a, b, 10 + i) for i, (a, b) in enumerate(files)], FILES)
    asked = [(100, 149), (251, 299), (451, 500), (100, 150), (375, 400), (450, 500), (None, 149), (451, None), (None, None), (None, 150), (450, None), (200, 200)]
    r = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(asked)], "id int, lo long, hi long")
    for x in runs.overlap(r, f).collect():
        a, b = asked[x["id"]]
        hit = [k for k, (s, l) in enumerate(files) if (a is None or l >= a) and (b is None or s <= b)]
        assert (x["n_overlap"], x["overlap_bytes"]) == (len(hit), sum(10 + k for k in hit)), (a, b)
    if disjoint and files:
        keys = spark.createDataFrame([(k,) for k in (99, 150, 199, 200, 201, 250, 251, 351, 451)], "key long")
        for x in runs.find_file(f, keys).collect():
            assert x["idx"] == sum(l < x["key"] for _, l in files)


def test_connected_and_scores(spark):
    f = spark.createDataFrame([(0, 1, 1, 4, 5), (0, 2, 4, 8, 5), (0, 3, 9, 9, 5), (0, 4, 2, 3, 5), (2, 9, 0, 99, 300 << 20)], FILES)
    got = {r["file_no"]: r["part"] for r in runs.connected(f.where("level = 0")).collect()}
    assert got[1] == got[2] == got[4] != got[3]
    assert tuple(runs.next_compaction(f).first()) == (2, 3.0, True)
    assert runs.level_summary(f).first()[0] == "files[ 4 0 1 0 0 0 0 ]"


def test_manifest(spark):
    edits = spark.createDataFrame([(1, "add", 1, 5), (2, "delete", 1, 5), (3, "add", 2, 5), (4, "add", 1, 6), (5, "delete", 1, 6), (6, "add", 1, 6)], "edit_no long, op string, level int, file_no long")
    assert rows(manifest.fold(edits), "level", "file_no") == [(1, 6), (2, 5)]
    with pytest.raises(Exception, match=r"missing files: \[7\]"):
        manifest.require_present(spark.createDataFrame([(5,), (7,)], "file_no long"), spark.createDataFrame([(5,)], "file_no long"))


def test_commit_groups(spark):
    w = spark.createDataFrame([(1, 1, 1000, False), (1, 2, 1000, False), (1, 3, 200_000, False), (1, 4, 10, True), (1, 5, 10, False)], "queue long, ord long, bytes long, sync boolean")
    assert [r["group_no"] for r in write.commit_groups(w).orderBy("ord").collect()] == [1, 1, 2, 3, 3]
