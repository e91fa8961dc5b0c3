"""Boosted trees with categorical splits, judged after every round.

Categories enter the vector as level numbers with nominal attributes, so trees split them by sets of levels; columns with many
levels enter as training frequencies. A fit runs once; the margins after each round come from the trees' own predictions in one pass
over the rows, and the average precision of all rounds (folds, candidates) from one curve. The model is cut at the best round.
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.row_features import number
from riskspark.operators import encoders, evaluation
from riskspark.operators.profiling import positive_weight
from riskspark.operators.sampling import split_expanding_folds
from riskspark.plans.training import BOOSTED_CANDIDATES, SEED, FittedModel, fit_state, load_model, weighted
from riskspark.schema import ID, LABEL
from riskspark.session import at_once, scratch_path, shared_dir, write_through

OTHER = "(other)"  # first level of every category: rare, unseen or missing values


def apply_native(df: DataFrame, state: dict) -> tuple[DataFrame, list[str], int]:
    """Add ``_features`` for trees; also the names of its places and the largest number of levels.

    Numbers are filled by the training median, with a missing flag where training rows lacked values. A category's levels are those kept by
    the encoder (at most its low-cardinality bound), so the expression that numbers them is bounded too.
    """
    groups = state["groups"]
    df = encoders.apply_frequency(df, state["levels"], groups["high_cardinality"])
    added: dict[str, Column] = {}
    levels: dict[str, list[str]] = {}
    for c in groups["numeric"]:
        fitted = state["numeric"][c]
        added[f"num__{c}"] = F.coalesce(number(c), F.lit(fitted["median"]))
        if fitted["missing_share"] > 0:
            added[f"num__{c}__missing"] = number(c).isNull().cast("double")
    for c in groups["low_cardinality"]:
        kept = state["one_hot"][c]["kept"]
        place = F.array_position(F.array(*map(F.lit, kept)), encoders.clean(c)) if kept else F.lit(0)
        added[f"cat__{c}"] = F.coalesce(place, F.lit(0)).cast("double")
        levels[f"cat__{c}"] = [OTHER, *kept]
    for c in groups["high_cardinality"]:
        added[f"freq__{c}"] = F.col(f"{c}__frequency")
    names = list(added)
    columns = {name: f"_x{i}" for i, name in enumerate(names)}
    encoded = df.withColumns({columns[n]: value for n, value in added.items()}).drop(*[f"{c}__frequency" for c in groups["high_cardinality"]])
    for name, held in levels.items():  # a single level can't be split, so it stays a number
        if len(held) > 1:
            encoded = encoded.withMetadata(columns[name], {"ml_attr": {"type": "nominal", "name": columns[name], "vals": held}})
    vectors = VectorAssembler(inputCols=list(columns.values()), outputCol="_features", handleInvalid="keep").transform(encoded)
    return vectors.drop(*columns.values()), names, max([2, *map(len, levels.values())])


def _leaf_values(spark: SparkSession, model: GBTClassificationModel, rounds: int | None) -> np.ndarray:
    """Weighted predictions of the first trees by tree and leaf, leaves counted from left to right; of the saved node table only the leaves are read."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    weights = list(model.treeWeights)[:rounds]
    held: list[list[float]] = [[] for _ in weights]
    leaves = spark.read.parquet(f"{path}/data").where((F.col("treeID") < len(weights)) & (F.col("nodeData.leftChild") < 0))
    for r in sorted(leaves.select("treeID", "nodeData.id", "nodeData.prediction").collect()):  # nodes are numbered left before right
        held[r["treeID"]].append(r["prediction"] * weights[r["treeID"]])
    values = np.zeros((len(held), max(map(len, held))))
    for tree, row in enumerate(held):
        values[tree, : len(row)] = row
    return values


def _with_parts(vectors: DataFrame, model: GBTClassificationModel, rounds: int | None) -> tuple[DataFrame, list[Column]]:
    """Rows with the predictions of the first trees, and these predictions weighted."""
    out, trees = vectors, model.trees[:rounds]
    for number_, tree in enumerate(trees):
        out = tree.setFeaturesCol("_features").setPredictionCol(f"_t{number_}").transform(out)
    return out, [F.col(f"_t{n}") * F.lit(float(w)) for n, w in enumerate(model.treeWeights[: len(trees)])]


def staged_margins(vectors: DataFrame, model: GBTClassificationModel, rounds: int | None = None) -> DataFrame:
    """Add ``margins``: the summed, weighted predictions of the first 1, 2, ... trees (all of them, or ``rounds``).

    The model names the leaves of all trees at once, so the plan doesn't grow with the rounds.
    """
    values = _leaf_values(vectors.sparkSession, model, rounds)

    def running(places: pd.Series) -> pd.Series:
        at = np.stack(places.to_list())[:, : len(values)].astype(np.int64)
        return pd.Series(list(np.cumsum(values[np.arange(len(values)), at], axis=1)))

    named = model.transform(vectors, {model.featuresCol: "_features", model.leafCol: "_leaves", model.predictionCol: "", model.probabilityCol: "", model.rawPredictionCol: ""})
    return named.select(*vectors.columns, F.pandas_udf(running, "array<double>")(vector_to_array("_leaves")).alias("margins"))


def last_margin(vectors: DataFrame, model: GBTClassificationModel, rounds: int | None = None) -> DataFrame:
    """Add ``margin``, the last of ``margins``, added up in the same order without leaving the JVM."""
    out, parts = _with_parts(vectors, model, rounds)
    return out.select(*vectors.columns, functools.reduce(Column.__add__, parts).alias("margin"))


def probability_of(margin: Column) -> Column:
    """The learner's link between margin and probability."""
    return 1 / (1 + F.exp(-2 * margin))


def staged_precision(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, round, average_precision) of rows with ``margins`` and the label; rounds count from 1."""
    by = by or []
    long = scored.select(*by, LABEL, F.posexplode("margins").alias("_at", "margin")).withColumn("round", F.col("_at") + 1)
    curve = evaluation.pr_curve(long, score="margin", by=[*by, "round"])
    found = evaluation.ranking_metrics(curve, by=[*by, "round"])
    return found.select(*by, "round", F.coalesce("average_precision", F.lit(0.0)).alias("average_precision"))


def best_round(values: list[float], patience: int | None = None) -> int:
    """The first round of highest value before ``patience`` rounds in a row bring no gain."""
    best = 0
    for at, value in enumerate(values):
        if value > values[best]:
            best = at
        elif patience is not None and at - best >= patience:
            break
    return best + 1


@dataclass
class StagedModel(FittedModel):
    """Boosted trees cut at ``rounds``."""

    rounds: int = 0

    def score(self, df: DataFrame) -> DataFrame:
        vectors, _, _ = apply_native(df, self.state)
        margins = last_margin(vectors, self.model, self.rounds)
        return margins.withColumn("probability", probability_of(F.col("margin"))).select(*df.columns, "probability")


def fit_trees(
    train: DataFrame, state: dict, *, weight_mode: str = "balanced", max_iter: int = 300, max_depth: int = 6, min_rows: int = 50, step: float = 0.1
) -> tuple[GBTClassificationModel, list[str]]:
    rows, names, most = apply_native(weighted(train, positive_weight(train, weight_mode)), state)
    learner = GBTClassifier(
        weightCol="_weight", maxIter=max_iter, maxDepth=max_depth, stepSize=step, minInstancesPerNode=min_rows, subsamplingRate=0.8, seed=SEED,
        maxBins=max(32, most), featuresCol="_features", labelCol=LABEL, predictionCol="_prediction")
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # without one, the learner's lineage grows with every round
        context.setCheckpointDir(f"{shared_dir(train.sparkSession)}/checkpoints")
    # Written first: the learner passes over its rows several times, which would repeat the joins of the encoding.
    return learner.fit(write_through(rows.select("_features", "_weight", F.col(LABEL).cast("double").alias(LABEL)), "tree-rows")), names


def train_staged(train: DataFrame, valid: DataFrame, *, groups: dict | None = None, state: dict | None = None, patience: int | None = 50, **options) -> StagedModel:
    """Fit on ``train``, cut at the round of highest average precision on ``valid``."""
    state = state or fit_state(train, groups)
    model, names = fit_trees(train, state, **options)
    curve = staged_precision(staged_margins(apply_native(valid, state)[0].select(LABEL, "_features"), model))
    values = [r["average_precision"] for r in curve.orderBy("round").collect()]  # one row per round
    return StagedModel("lightgbm.v2", state, model, names, best_round(values, patience))


def staged_folds(development: DataFrame, *, groups: dict, candidates: list[dict] | None = None, max_iter: int = 300) -> DataFrame:
    """(name, fold, id, label, margins): validation rows of every expanding fold with their margins after each round.

    Encoders are fitted per fold. One written table; each (fold, candidate) fills a folder of its own. The fits are independent and
    each is a long row of small jobs, so they run side by side.
    """
    folded = write_through(split_expanding_folds(development), "folds")
    parts: dict[tuple[int, str], DataFrame] = {}
    jobs = []

    def fitted(fold: int, c: dict, train: DataFrame, state: dict, vectors: DataFrame) -> None:
        model, _ = fit_trees(train, state, weight_mode=c["weight_mode"], max_depth=c["max_depth"], min_rows=c["min_rows"], max_iter=max_iter)
        scored = staged_margins(vectors, model).select(F.lit(c["name"]).alias("name"), F.lit(fold).alias("fold"), ID, LABEL, "margins")
        parts[fold, c["name"]] = write_through(scored, "staged-fold")

    for fold in (1, 2, 3):
        rows = folded.where(F.col("fold") == fold)
        train, valid = (rows.where(F.col("role") == role).drop("fold", "role") for role in ("train", "validation"))
        state = fit_state(train, groups)
        vectors = write_through(apply_native(valid, state)[0].select(ID, LABEL, "_features"), "fold-vectors")
        jobs += [functools.partial(fitted, fold, c, train, state, vectors) for c in candidates or BOOSTED_CANDIDATES]
    at_once(development.sparkSession, jobs)
    return functools.reduce(DataFrame.unionByName, [parts[key] for key in sorted(parts)])


def fold_results(staged: DataFrame, patience: int | None = None) -> DataFrame:
    """(name, fold, best_round, validation_pr_auc) from the margins of all folds, in one curve."""
    values: dict[tuple[str, int], list[float]] = {}
    for r in staged_precision(staged, ["name", "fold"]).orderBy("name", "fold", "round").collect():  # folds x candidates x rounds
        values.setdefault((r["name"], r["fold"]), []).append(r["average_precision"])
    rows = [(name, fold, at := best_round(v, patience), v[at - 1]) for (name, fold), v in values.items()]
    return staged.sparkSession.createDataFrame(rows, "name string, fold int, best_round int, validation_pr_auc double")


def refit_best(train: DataFrame, results: DataFrame, *, groups: dict, candidates: list[dict] | None = None) -> StagedModel:
    """The candidate of highest mean precision, fitted to ``train`` for the median of its best rounds."""
    chosen = results.groupBy("name").agg(F.avg("validation_pr_auc").alias("mean"), F.percentile_approx("best_round", 0.5).alias("rounds"))
    best = chosen.orderBy(F.desc("mean"), "name").first()
    settings = next(c for c in candidates or BOOSTED_CANDIDATES if c["name"] == best["name"])
    state = fit_state(train, groups)
    model, names = fit_trees(train, state, weight_mode=settings["weight_mode"], max_depth=settings["max_depth"], min_rows=settings["min_rows"], max_iter=best["rounds"])
    return StagedModel("lightgbm.v2", state, model, names, best["rounds"])


def load(spark: SparkSession, path: str) -> StagedModel:
    """What ``save_model`` wrote, cut at the same round."""
    fitted = load_model(spark, path)
    record = json.loads(spark.read.text(f"{path}/record", wholetext=True).first()[0])  # one small document
    return StagedModel(fitted.identifier, fitted.state, fitted.model, fitted.features, record["rounds"])
