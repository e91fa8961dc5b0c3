"""Ranking quality, thresholds, review capacity and blending of two scores.

Everything is read from one curve: rows counted per distinct score, then cumulated from
the highest score down. Scores are grouped before the global sort, ties share one point,
and curves of several models or splits are computed together with ``by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.operators.ordering import CHUNK_ROWS, ordered, running_totals
from riskspark.schema import ID, LABEL
from riskspark.session import single_row, write_through

# Review shares, precision floor and clipping of blended scores.
CAPACITY_SHARES = {"top_1_percent": 0.01, "top_5_percent": 0.05, "top_10_percent": 0.10}
PRECISION_FLOOR = 0.10
LOGIT_EPSILON = 1e-6
LOGIT_LIMIT = 40.0
GRID = 101


def score_counts(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives")
    )


def pr_curve(
    df: DataFrame, *, score: str = "probability", label: str = LABEL, by: list[str] | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """One row per distinct score: counts at or above it, precision and recall."""
    by = by or []
    order = [*[F.col(c) for c in by], F.col("score").desc()]
    counts = ordered(score_counts(df, score, label, by), order, "scores")
    curve = running_totals(
        counts, order, {"tp": F.col("positives"), "fp": F.col("negatives")}, by=by, chunk_rows=chunk_rows, presorted=True
    )
    joined = _with_totals(curve, _totals(counts, by), by)
    return joined.select(
        *by, "score", "positives", "negatives", "tp", "fp", "p_total", "n_total",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("p_total")), F.lit(1.0)).alias("recall"),
    )


def _totals(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("positives").alias("p_total"), F.sum("negatives").alias("n_total"))


def _with_totals(curve: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    if by:
        return curve.join(totals, by)
    return curve.withColumn("_t", single_row(totals)).select(*curve.columns, "_t.*")


def ranking_metrics(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Average precision (sum of recall steps times precision) and tie-aware ROC AUC."""
    by = by or []
    p, n = F.col("p_total"), F.col("n_total")
    step = F.col("positives") * F.col("precision")
    # Negatives ranked below a positive count fully, tied ones by half.
    below = n - F.col("fp") + F.col("negatives") / F.lit(2.0)
    return curve.groupBy(*by).agg(
        F.try_divide(F.sum(step), F.max(p)).alias("average_precision"),
        F.try_divide(F.sum(F.col("positives") * below), F.max(p * n)).alias("roc_auc"),
    )


def operating_threshold(curve: DataFrame, *, floor: float = PRECISION_FLOOR, by: list[str] | None = None) -> DataFrame:
    """Highest recall at a precision of at least ``floor``; else best F1; else 0.5.

    Recall grows as the score falls, so the lowest qualifying score wins.
    """
    by = by or []
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))
    point = F.struct("score", "precision", "recall")
    ok = F.col("precision") >= floor
    picked = curve.groupBy(*by).agg(
        F.min_by(F.when(ok, point), F.when(ok, F.col("score"))).alias("_best"),
        # Equal F1 values go to the lowest score, the first point of an ascending curve.
        F.max_by(point, F.struct(f1, -F.col("score"))).alias("_f1"),
    )
    best = F.coalesce("_best", "_f1")
    return picked.select(
        *by, F.coalesce(best["score"], F.lit(0.5)).alias("threshold"),
        F.when(F.col("_best").isNotNull(), f"maximum_recall_with_precision_at_least_{floor:.2f}")
        .when(F.col("_f1").isNotNull(), "maximum_f1_fallback").otherwise("fallback_0.5").alias("method"),
        F.coalesce(best["precision"], F.lit(0.0)).alias("precision"), F.coalesce(best["recall"], F.lit(0.0)).alias("recall"),
    )


def confusion(df: DataFrame, threshold: float | Column, *, score: str = "probability", label: str = LABEL, by: list[str] | None = None) -> DataFrame:
    """2x2 counts, precision, recall, F1, Brier score and base rate."""
    cut = F.lit(threshold) if isinstance(threshold, float) else threshold
    hit, pos = F.col(score) >= cut, F.col(label) == 1
    counts = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col(label).cast("double")).alias("fraud_rate"),
        F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"),
        F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("brier_score"),
    )
    zero_safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": zero_safe(tp, tp + fp), "recall": zero_safe(tp, tp + fn), "f1": zero_safe(2 * tp, 2 * tp + fp + fn),
    })


def capacity(
    df: DataFrame, *, score: str = "probability", label: str = LABEL, by: list[str] | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Positives among the highest scores for each review share, ties broken by id."""
    by = by or []
    narrow = df.select(*by, F.col(score).alias("score"), F.col(label).cast("bigint").alias("label"), ID)
    order = [*[F.col(c) for c in by], F.col("score").desc(), F.col(ID)]
    rows = ordered(narrow, order, "capacity")
    ranked = running_totals(
        rows, order, {"rank": F.lit(1), "captured": F.col("label")}, by=by, chunk_rows=chunk_rows, presorted=True
    )
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"))
    shares = F.explode(F.array(*[
        F.struct(F.lit(n).alias("share"), F.greatest(F.ceil(F.col("rows") * F.lit(f)), F.lit(1)).alias("rank"))
        for n, f in CAPACITY_SHARES.items()
    ])).alias("s")
    wanted = totals.select("*", shares).select(*by, "positives", "s.share", "s.rank")
    hits = ranked.select(*by, "rank", "captured").join(wanted, [*by, "rank"])
    return hits.select(
        *by, "share", F.col("rank").alias("reviewed_rows"), F.col("captured").alias("fraud_captured"),
        F.coalesce(F.try_divide(F.col("captured"), F.col("positives")), F.lit(0.0)).alias("recall"),
        (F.col("captured") / F.col("rank")).alias("precision"),
    )


def evaluate(df: DataFrame, threshold: float | Column, *, score: str = "probability", label: str = LABEL, by: list[str]) -> DataFrame:
    """All scalar metrics per group (split, model, ...)."""
    curve = pr_curve(df, score=score, label=label, by=by)
    return confusion(df, threshold, score=score, label=label, by=by).join(ranking_metrics(curve, by), by)


def logit(p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(LOGIT_EPSILON)), F.lit(1 - LOGIT_EPSILON))
    return F.ln(clipped / (1 - clipped))


def blend_fit(
    df: DataFrame, first: str, second: str, *, label: str = LABEL, grid: int = GRID, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Average precision of every first-model weight on the grid, best first.

    Equal score pairs are grouped before they are multiplied by the grid, and equal blends before they are sorted; totals are
    carried over chunks of the order, at any number of pairs.
    """
    pairs = df.groupBy(first, second).agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives")
    )
    pairs = write_through(pairs, "score-pairs").withColumns({"_a": logit(F.col(first)), "_b": logit(F.col(second))})
    # The weight is step * position, the last one exactly 1, as a linear grid gives it.
    step = 1.0 / (grid - 1)
    # Every pair turns into ``grid`` rows; the counts after it combine before they are shuffled.
    gridded = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("grid"))
    weight = F.when(F.col("grid") == grid - 1, F.lit(1.0)).otherwise(F.col("grid") * F.lit(step))
    scored = gridded.withColumn("w", weight).select(
        "grid", "w", (F.col("w") * F.col("_a") + (1 - F.col("w")) * F.col("_b")).alias("score"), "positives", "negatives"
    )
    counts = scored.groupBy("grid", "w", "score").agg(F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives"))
    curve = running_totals(
        counts, [F.col("score").desc()], {"tp": F.col("positives"), "fp": F.col("negatives")}, by=["grid"], chunk_rows=chunk_rows)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return curve.groupBy("grid").agg(
        F.max("w").alias("first_weight"), (1 - F.max("w")).alias("second_weight"),
        F.try_divide(F.sum(F.col("positives") * precision), F.sum("positives")).alias("average_precision"),
    ).orderBy(F.desc("average_precision"), "grid")


def best_weight(fitted: DataFrame) -> float:
    return float(fitted.orderBy(F.desc("average_precision"), "grid").first()["first_weight"])  # one row


def blend(first: Column, second: Column, weight: float) -> Column:
    mixed = F.lit(weight) * logit(first) + F.lit(1 - weight) * logit(second)
    limited = F.least(F.greatest(mixed, F.lit(-LOGIT_LIMIT)), F.lit(LOGIT_LIMIT))
    return 1.0 / (1.0 + F.exp(-limited))


def cv_summary(folds: DataFrame, name: str = "name", score: str = "validation_pr_auc") -> DataFrame:
    """Mean and sample deviation per candidate, best mean first."""
    return folds.groupBy(name).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std")).orderBy(F.desc("mean"), name)
