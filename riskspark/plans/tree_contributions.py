"""Exact contributions of features to the margin of boosted trees.

Path-dependent Shapley values: a feature outside the coalition sends a row down both branches of its splits, in the shares of the
training rows that went there. Every leaf is one entry of a small relation with, for each feature on its path, what the path asks of it and
the product of those shares. With o = 1 where the row meets what is asked and r the share, a feature's value is the sum over leaves of

    leaf value * (o - r) * integral over t in (0, 1) of the product over the path's other features of (o t + r (1 - t)),

and Gauss-Legendre nodes give the integral of that polynomial exactly. The relation is as large as the model, rows meet it inside their own
tasks, and only (id, feature, partial sum) is shuffled. Values of a row sum to its margin less ``base``; log-odds are twice the margin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.operators.contributions import TOP_K, rank_contributions
from riskspark.plans.staged import StagedModel, apply_native
from riskspark.schema import ID
from riskspark.session import scratch_path, single_row, write_through

_PART = T.StructType([
    T.StructField("feature", T.IntegerType()), T.StructField("share", T.DoubleType()), T.StructField("above", T.DoubleType()),
    T.StructField("upto", T.DoubleType()), T.StructField("among", T.ArrayType(T.DoubleType()))])
_LEAF = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("parts", T.ArrayType(_PART))])


@dataclass(frozen=True)
class Asked:
    """What a path asks of one feature: above a number, up to a number, among levels (None: anything), and the share that gets there."""

    share: float = 1.0
    above: float | None = None
    upto: float | None = None
    among: frozenset[float] | None = None

    def left(self, split, share: float) -> Asked:
        if split["numCategories"] > 0:
            return Asked(self.share * share, among=self._levels(split) & frozenset(split["leftCategoriesOrThreshold"]))
        limit = split["leftCategoriesOrThreshold"][0]
        return Asked(self.share * share, self.above, limit if self.upto is None else min(limit, self.upto))

    def right(self, split, share: float) -> Asked:
        if split["numCategories"] > 0:
            return Asked(self.share * share, among=self._levels(split) - frozenset(split["leftCategoriesOrThreshold"]))
        limit = split["leftCategoriesOrThreshold"][0]
        return Asked(self.share * share, limit if self.above is None else max(limit, self.above), self.upto)

    def _levels(self, split) -> frozenset[float]:
        return frozenset(map(float, range(split["numCategories"]))) if self.among is None else self.among


def leaves(fitted: StagedModel) -> DataFrame:
    """(value, parts) of every leaf of the first ``rounds`` trees, the tree's weight in the value.

    Read from the saved node table; what passes the driver is the model, which the driver holds already.
    """
    spark = fitted.state["levels"].sparkSession
    path = scratch_path(spark, "trees")
    fitted.model.write().save(path)
    nodes = {(r["treeID"], r["nodeData"]["id"]): r["nodeData"] for r in spark.read.parquet(f"{path}/data").where(F.col("treeID") < fitted.rounds).collect()}
    found = []
    for tree, weight in enumerate(fitted.model.treeWeights[: fitted.rounds]):
        open_: list[tuple[int, dict[int, Asked]]] = [(0, {})]
        while open_:
            at, asked = open_.pop()
            node = nodes[tree, at]
            if node["leftChild"] < 0:
                parts = [(f, a.share, a.above, a.upto, None if a.among is None else sorted(a.among)) for f, a in sorted(asked.items())]
                found.append((float(node["prediction"] * weight), parts))
                continue
            split = node["split"]
            before = asked.get(split["featureIndex"], Asked())
            for child, step in ((node["leftChild"], before.left), (node["rightChild"], before.right)):
                share = nodes[tree, child]["rawCount"] / node["rawCount"]
                open_.append((child, asked | {split["featureIndex"]: step(split, share)}))
    return write_through(spark.createDataFrame(found, _LEAF), "leaves")


def base(leaf: DataFrame) -> Column:
    """The margin of an empty coalition, as a constant of another query."""
    reached = F.aggregate("parts", F.lit(1.0), lambda product, part: product * part["share"])
    return single_row(leaf.agg(F.coalesce(F.sum(F.col("value") * reached), F.lit(0.0)).alias("base")))["base"]


def _meets(part: Column, x: Column) -> Column:
    """1 if the row's value is what the path asks for, else 0; a value that is no number is larger than any other."""
    value = F.get(x, part["feature"])
    ranged = (part["above"].isNull() | (value > part["above"])) & (part["upto"].isNull() | (value <= part["upto"]))
    return F.when(part["among"].isNull(), ranged).otherwise(F.array_contains(part["among"], value)).cast("double")


def contributions(rows: DataFrame, fitted: StagedModel, leaf: DataFrame | None = None) -> DataFrame:
    """(id, feature, contribution) for every row and every feature that a tree splits by. Ids name rows, so they must be unique.

    No rows give no rows; a model whose trees never split gives none either.
    """
    leaf = leaves(fitted) if leaf is None else leaf
    deepest = leaf.agg(F.coalesce(F.max(F.size("parts")), F.lit(0))).first()[0]
    at, weight = np.polynomial.legendre.leggauss(max(1, math.ceil(deepest / 2)))
    nodes = [(float((t + 1) / 2), float(w / 2)) for t, w in zip(at, weight)]
    vectors, names, _ = apply_native(rows, fitted.state)
    model = single_row(leaf.where(F.size("parts") > 0).agg(F.collect_list(F.struct("value", "parts")).alias("all")))["all"]  # the model's size
    met = vectors.select(ID, vector_to_array("_features").alias("_x"), F.explode(model).alias("_leaf")).select(
        ID, F.col("_leaf.value").alias("_value"),
        F.transform("_leaf.parts", lambda p: F.struct(p["feature"].alias("f"), p["share"].alias("r"), _meets(p, F.col("_x")).alias("o"))).alias("_met"))

    def factor(p: Column, t: float) -> Column:
        return p["o"] * t + p["r"] * (1 - t)

    def product(t: float) -> Column:
        return F.aggregate("_met", F.lit(1.0), lambda so_far, p: so_far * factor(p, t))

    met = met.withColumns({f"_p{i}": product(t) for i, (t, _) in enumerate(nodes)})

    def value(p: Column) -> Column:
        integral = F.lit(0.0)
        for i, (t, w) in enumerate(nodes):
            integral = integral + F.col(f"_p{i}") / factor(p, t) * w
        return F.struct(p["f"].alias("f"), (F.col("_value") * (p["o"] - p["r"]) * integral).alias("v"))

    summed = met.select(ID, F.inline(F.transform("_met", value))).groupBy(ID, "f").agg(F.sum("v").alias("contribution"))
    return summed.select(ID, F.get(F.array(*map(F.lit, names)), F.col("f")).alias("feature"), "contribution")


def explain_trees(flagged: DataFrame, fitted: StagedModel, *, top_k: int = TOP_K) -> DataFrame:
    """The features of largest contribution of each flagged row, with rank and direction."""
    return rank_contributions(contributions(flagged, fitted), [ID], top_k=top_k)
