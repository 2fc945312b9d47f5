"""Queries over whole tables beside those with id prefixes."""

from __future__ import annotations

import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't there")
def test_whole_tables(spark):
    queries = __spark_entry__.queries()
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderdate")
    found = queries["q89_timestamp_whole"](spark, SF)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, orders.collect()))
    parts = spark.read.parquet(f"{SF}/part.parquet").where("p_size = 7").select("p_partkey")
    assert sorted(map(tuple, queries["q88_merged_equality_whole"](spark, SF).collect())) == sorted(map(tuple, parts.collect()))
