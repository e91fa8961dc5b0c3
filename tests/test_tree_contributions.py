"""Contributions of boosted trees against Shapley values by their definition, and their sums in SQL."""

from __future__ import annotations

import itertools
import math

import duckdb
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskspark.plans import staged, tree_contributions
from tests.conftest import rows

GROUPS = {"numeric": ["TransactionAmt", "D1"], "low_cardinality": ["ProductCD"], "high_cardinality": ["card1"]}


@pytest.fixture(scope="module")
def data(spark):
    base = spark.range(1, 601).select(
        F.col("id").alias("TransactionID"), F.col("id").alias("TransactionDT"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 7 % 97).cast("double")).alias("TransactionAmt"), (F.col("id") * 13 % 41).cast("double").alias("D1"),
        F.concat(F.lit("p"), F.pmod(F.xxhash64("id"), F.lit(7))).alias("ProductCD"), (F.col("id") % 90).alias("card1"))
    noise = F.pmod(F.xxhash64("TransactionID", F.lit(5)), F.lit(10)) < 2
    hit = F.col("ProductCD").isin("p1", "p4", "p6") & (F.coalesce("TransactionAmt", F.lit(0.0)) > 30) | (F.col("D1") > 35)
    return base.withColumn("isFraud", (hit != noise).cast("int")).persist()


@pytest.fixture(scope="module")
def fitted(data):
    return staged.train_staged(data.where("TransactionID <= 420"), data.where("TransactionID > 420"), groups=GROUPS, max_iter=5, max_depth=4, min_rows=5, patience=None)


def expectation(nodes, tree, x, known, at=0):
    """Of a tree, over branches by their share where the feature is not known."""
    node = nodes[tree, at]
    if node["leftChild"] < 0:
        return node["prediction"]
    split, children = node["split"], (node["leftChild"], node["rightChild"])
    f, limits = split["featureIndex"], split["leftCategoriesOrThreshold"]
    if f in known:
        left = x[f] in limits if split["numCategories"] > 0 else x[f] <= limits[0]
        return expectation(nodes, tree, x, known, children[0 if left else 1])
    return sum(nodes[tree, c]["rawCount"] / node["rawCount"] * expectation(nodes, tree, x, known, c) for c in children)


def test_equal_to_the_definition(spark, data, fitted, tmp_path):
    fitted.model.write().overwrite().save(f"{tmp_path}/model")
    nodes = {(r["treeID"], r["nodeData"]["id"]): r["nodeData"] for r in spark.read.parquet(f"{tmp_path}/model/data").collect()}
    assert any(n["split"]["numCategories"] > 0 for n in nodes.values()) and max(n["leftChild"] for n in nodes.values()) > 3
    asked = data.where("TransactionID % 29 = 0")
    got = {(r["TransactionID"], r["feature"]): r["contribution"] for r in tree_contributions.contributions(asked, fitted).collect()}
    vectors, names, _ = staged.apply_native(asked, fitted.state)
    everyone = range(len(names))
    for r in vectors.select("TransactionID", vector_to_array("_features").alias("x")).collect():
        def margin(known):
            return sum(w * expectation(nodes, t, r["x"], known) for t, w in enumerate(fitted.model.treeWeights[: fitted.rounds]))
        worth = {s: margin(set(s)) for n in range(len(names) + 1) for s in itertools.combinations(everyone, n)}
        for f in everyone:
            others = [j for j in everyone if j != f]
            value = sum(
                math.factorial(n) * math.factorial(len(others) - n) / math.factorial(len(names)) * (worth[tuple(sorted((*s, f)))] - worth[s])
                for n in range(len(names)) for s in itertools.combinations(others, n))
            assert math.isclose(got.get((r["TransactionID"], names[f]), 0.0), value, rel_tol=1e-9, abs_tol=1e-12)


def test_sums_to_margin_less_base_in_sql(data, fitted, tmp_path):
    leaf = tree_contributions.leaves(fitted)
    tree_contributions.contributions(data, fitted, leaf).write.parquet(f"{tmp_path}/c")
    vectors, _, _ = staged.apply_native(data, fitted.state)
    staged.staged_margins(vectors, fitted.model, fitted.rounds).select("TransactionID", F.element_at("margins", -1).alias("margin"), tree_contributions.base(leaf).alias("base")).write.parquet(f"{tmp_path}/m")
    n, worst = duckdb.sql(f"""select count(*), max(abs(total - (margin - base))) from '{tmp_path}/m/*.parquet'
        join (select TransactionID, sum(contribution) as total from '{tmp_path}/c/*.parquet' group by 1) using (TransactionID)""").fetchall()[0]
    assert n == 600 and worst < 1e-9


def test_only_narrow_sums_are_shuffled(data, fitted):
    wide = data.selectExpr("*", "1 as feature", "2 as f", "3 as _value")
    found = tree_contributions.contributions(wide, fitted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") <= 3 and "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert found.count() == tree_contributions.contributions(data, fitted).count()


def test_top_features_and_awkward_rows(spark, data, fitted):
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (2, float("nan"), float("inf"), "new", 10**9)], "TransactionID long, TransactionAmt double, D1 double, ProductCD string, card1 long")
    top = rows(tree_contributions.explain_trees(odd, fitted, top_k=2), "TransactionID", "rank")
    assert [(r["TransactionID"], r["rank"]) for r in top] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    everything = rows(tree_contributions.contributions(odd, fitted))
    for i in (1, 2):
        own = sorted((-abs(r["contribution"]), r["feature"]) for r in everything if r["TransactionID"] == i)
        assert [r["feature"] for r in top if r["TransactionID"] == i] == [f for _, f in own[:2]]
    assert tree_contributions.explain_trees(odd.limit(0), fitted).count() == 0
