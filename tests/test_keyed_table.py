"""Stored tables: merges rewrite their own buckets, retries change nothing, reads touch few files."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from riskspark.sources.keyed_table import ClusteredTable, KeyedTable
from tests.conftest import rows

SCHEMA = "k long, v string, n int"


def stored_files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{root}/data") for f in fs if f.endswith(".parquet")}


@pytest.fixture()
def stored(spark, tmp_path):
    base = spark.range(2000).selectExpr("id as k", "concat('v', id) as v", "cast(id % 7 as int) as n")
    found = KeyedTable(spark, str(tmp_path / "t"), base.schema, ["k"], buckets=16)
    found.create(base)
    return found


def test_merges_equal_a_dictionary(spark, stored):
    rng, expected = random.Random(4), {k: (f"v{k}", k % 7) for k in range(2000)}
    for version in (1, 2, 3):
        updates = [(rng.choice([5, rng.randrange(2500)]), f"w{version}-{i}", i) for i in range(60)]  # key 5 is hot
        for k, v, n in updates:
            expected[k] = (v, n)
        stored.merge(spark.createDataFrame(updates, SCHEMA).selectExpr("*", "1 as extra"), version, F.col("n"))
    assert {r["k"]: (r["v"], r["n"]) for r in stored.read().collect()} == expected
    assert stored.read(0).count() == 2000 and stored.read(0).where("v like 'w%'").isEmpty()  # older versions stay readable


def test_a_small_update_rewrites_its_own_bucket_and_a_retry_changes_nothing(spark, stored):
    before = stored_files(stored.root)
    update = spark.createDataFrame([(17, "new", 1), (17, "newer", 2)], SCHEMA)
    touched = stored.merge(update, 1, F.col("n"))
    after = stored_files(stored.root)
    assert len(touched) == 1 and {f: after[f] for f in before} == before and len(after) == len(before) + 1
    once = rows(stored.read(), "k")
    assert stored.merge(update, 1, F.col("n")) == touched
    assert rows(stored.read(), "k") == once and len(stored.read().inputFiles()) == len(before)
    assert len(stored.superseded()) == 1


def test_lookup_reads_one_bucket_and_pushes_the_key_down(stored):
    found = stored.lookup([(42,)])
    assert rows(found) == [{"k": 42, "v": "v42", "n": 0}]
    assert len(found.inputFiles()) == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,42)" in plan or "In(k, [42])" in plan
    assert stored.lookup([(9999,), (None,)]).isEmpty()


def test_awkward_tables(spark, tmp_path):
    base = spark.createDataFrame([(None, "a", "x", 1), (None, "a", "y", 2), (1, None, "z", 3)], "k long, `_order` string, `_row` string, n int")
    table = KeyedTable(spark, str(tmp_path / "odd"), base.schema, ["k"], buckets=4)
    table.create(base.limit(0))
    assert table.read().count() == 0 and table.merge(base.limit(0), 1) == set() and table.lookup([(1,)]).isEmpty()
    pair = KeyedTable(spark, str(tmp_path / "pair"), spark.createDataFrame([], SCHEMA).schema, ["k", "v"], buckets=4)
    pair.create(spark.createDataFrame([(None, "a", 1), (None, "a", 2), (1, None, 3), (1, None, 3)], SCHEMA), F.col("n"))
    assert {(r["k"], r["v"], r["n"]) for r in pair.read().collect()} == {(None, "a", 2), (1, None, 3)}
    assert rows(pair.lookup([(1, None), (2, "b")])) == [{"k": 1, "v": None, "n": 3}]
    pair.merge(spark.createDataFrame([("1", None, "9")], "k string, v string, n string"), 1)  # cast to the table's types, same bucket
    assert {r["n"] for r in pair.read().collect()} == {2, 9}


def test_pages_equal_a_sort_and_read_few_files(spark, tmp_path):
    rng = random.Random(2)
    data = [(rng.randrange(900), i) for i in range(3000)] + [(450, 10_000 + i) for i in range(700)]  # many equal ids
    table = ClusteredTable(spark, str(tmp_path / "c"), "id")
    table.write(spark.createDataFrame(data, "id long, other long"), files=12)
    ordered = sorted(data)
    for after, size in [(None, 5), (-5, 40), (449, 100), (450, 7), (700, 900), (899, 10), (10**6, 3)]:
        page = table.page(after, size)
        assert [tuple(r) for r in page.collect()] == [d for d in ordered if after is None or d[0] > after][:size], (after, size)
    assert len(table.page(600, 20).inputFiles()) <= 3 and len(table.page(None, 20).inputFiles()) <= 2
    with pytest.raises(SparkRuntimeException):
        ClusteredTable(spark, str(tmp_path / "n"), "id").write(spark.createDataFrame([(None, 1)], "id long, other long"))
    ClusteredTable(spark, str(tmp_path / "e"), "id").write(spark.createDataFrame([], "id int, other long"))
    assert ClusteredTable(spark, str(tmp_path / "e"), "id").page(3, 5).count() == 0
