"""Queries that must take whole tables: every row reaches the operator."""

import os

import __spark_entry__ as entry
from tidelog.sources.changelog import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_l0_transitive_overlap_takes_all_orders(spark):
    rows = entry.queries()["kv_l0_transitive_overlap"](spark, SF).collect()
    assert sum(r["n"] for r in rows) == table(spark, SF, "orders").count()
    assert 1 < len({r["part"] for r in rows}) < len(rows)  # islands of several files


def test_multi_get_looks_up_all_customers(spark):
    keys = [r["key"] for r in entry.queries()["kv_multi_get"](spark, SF).collect()]
    assert sorted(keys) == sorted(r["c_custkey"] for r in table(spark, SF, "customer").collect())


def test_varint_width_takes_products_beyond_64_bits(spark, tmp_path):
    keys = [(0, 0), (7, 5), (149_999, 14_999), (4_500_002, 459_822), (8_999_999, 899_999), (2**63 - 1, 2**63 - 1)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    rows = entry.queries()["kv_varint_width"](spark, str(tmp_path)).collect()
    assert {r["o_orderkey"]: r["width"] for r in rows} == {a: max(1, -(-(a * a * c).bit_length() // 7)) for a, c in keys}
