"""Encoders fitted on training rows only.

``fit_*`` returns state tables; ``apply_*`` uses them on any rows. The level table of all
categorical columns comes from one grouped pass. Level tables are joined,
and Catalyst broadcasts those that are small; only the one-hot columns of columns with few levels are literals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.row_features import number
from riskspark.operators.ordering import exact_quantiles, running_totals
from riskspark.operators.profiling import value_counts
from riskspark.schema import MISSING, OTHER, UNKNOWN
from riskspark.session import write_through

# Encoder parameters and reserved vocabulary numbers.
RARE_MIN_COUNT = 20
LOW_CARDINALITY_MAX = 100
RESERVED = {MISSING: 0, UNKNOWN: 1, OTHER: 2}
SCALE_EPSILON = 1e-8
CLAMP = 10.0


def clean(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def fit_levels(train: DataFrame, columns: list[str], *, rare_min_count: int = RARE_MIN_COUNT) -> DataFrame:
    """(column, value, n, share, kept): every value seen in training, NULL as MISSING.

    Written as the fitted artefact, so later joins are planned from its real size.
    """
    counts = value_counts(train.select(*[clean(c).alias(c) for c in columns]), columns)
    total = counts.groupBy("column").agg(F.sum("n").alias("_total"))
    levels = counts.join(F.broadcast(total), "column").select(  # one row per column
        "column", "value", "n", (F.col("n") / F.col("_total")).alias("share"), (F.col("n") >= rare_min_count).alias("kept")
    )
    return write_through(levels, "levels")


def apply_frequency(df: DataFrame, levels: DataFrame, columns: list[str]) -> DataFrame:
    """Training share of each value as ``<column>__frequency``; unseen values get 0."""
    for c in columns:
        mine = levels.where(F.col("column") == c).select(F.col("value").alias("_k"), F.col("share").alias("_s"))
        df = df.withColumn("_k", clean(c)).join(mine, "_k", "left")
        df = df.withColumn(f"{c}__frequency", F.coalesce("_s", F.lit(0.0))).drop("_k", "_s")
    return df


def _few_levels(levels: DataFrame, columns: list[str]) -> dict[str, list]:
    """Levels of columns that have at most LOW_CARDINALITY_MAX of them (besides MISSING), which is why they are one-hot encoded.

    A group given by the caller is checked: a column with more levels is refused before anything is collected.
    """
    sizes = levels.where(F.col("column").isin(columns) & (F.col("value") != MISSING)).groupBy("column").count()
    wide = sorted(r["column"] for r in sizes.where(F.col("count") > LOW_CARDINALITY_MAX).collect())  # one row per column at most
    if wide:
        raise ValueError(f"too many levels for one-hot encoding, use frequencies: {', '.join(wide)}")
    rows = levels.where(F.col("column").isin(columns)).orderBy("column", "value").collect()
    return {c: [r for r in rows if r["column"] == c] for c in columns}


def _rare_level(seen: Column, kept: Column, value: Column) -> Column:
    # The unseen test comes last, so a NULL that training never had becomes UNKNOWN.
    return F.when(seen.isNull(), F.lit(UNKNOWN)).when(kept | (value == MISSING), value).otherwise(F.lit(OTHER))


def apply_rare_levels(df: DataFrame, levels: DataFrame, columns: list[str]) -> DataFrame:
    """Keep frequent levels, group rare ones as OTHER and unseen ones as UNKNOWN, at any number of levels."""
    for c in columns:
        mine = levels.where(F.col("column") == c).select(F.col("value").alias("_k"), F.col("kept").alias("_kept"))
        df = df.withColumn("_k", clean(c)).join(mine, "_k", "left")
        df = df.withColumn(c, _rare_level(F.col("_kept"), F.coalesce("_kept", F.lit(False)), F.col("_k"))).drop("_k", "_kept")
    return df


def apply_levels_once(df: DataFrame, levels: DataFrame, *, frequency: list[str] = (), rare: list[str] = ()) -> DataFrame:
    """What ``apply_frequency`` and ``apply_rare_levels`` give for any number of columns, by one join with the level table.

    Rows are written once with a number; of them only (number, place of the column, value) meets the level table, and each row gets one
    array of findings back, at most an entry a column. So wide rows are shuffled once instead of once a column. Missing values, the
    hottest key of most columns, are answered from one row a column; other hot values are split by AQE.
    """
    columns = list(dict.fromkeys([*frequency, *rare]))
    if not columns:
        return df
    numbered = write_through(df.withColumn("_number", F.monotonically_increasing_id()), "encoding-rows")
    each = [F.struct(F.lit(i).alias("at"), F.lit(c).alias("column"), clean(c).alias("value")) for i, c in enumerate(columns)]
    cells = numbered.select("_number", F.inline(F.array(*each)))
    known = levels.where(F.col("column").isin(columns)).select("column", "value", "share", "kept")
    missing = known.where(F.col("value") == MISSING)  # one row a column
    found = cells.where(F.col("value") != MISSING).join(known.where(F.col("value") != MISSING), ["column", "value"], "left").unionByName(
        cells.where(F.col("value") == MISSING).join(F.broadcast(missing), ["column", "value"], "left"))
    listed = F.sort_array(F.collect_list(F.struct("at", "share", "kept"))).alias("_found")
    joined = numbered.join(found.groupBy("_number").agg(listed), "_number")
    at = {c: F.get("_found", F.lit(i)) for i, c in enumerate(columns)}
    added = {f"{c}__frequency": F.coalesce(at[c]["share"], F.lit(0.0)) for c in frequency}
    added |= {c: _rare_level(at[c]["kept"], F.coalesce(at[c]["kept"], F.lit(False)), clean(c)) for c in rare}
    return joined.withColumns(added).drop("_number", "_found")


def fit_vocabulary(levels: DataFrame) -> DataFrame:
    """(column, value, index): reserved numbers first, kept values in order, rare ones as OTHER.

    Written as the fitted artefact, so later joins are planned from its real size.
    """
    kept = levels.where(F.col("kept") & ~F.col("value").isin(list(RESERVED))).select("column", "value")
    # A column may keep many values, so the ranks come from the distributed cumulative sum.
    ranked = running_totals(kept, [F.col("value")], {"_rank": F.lit(1)}, by=["column"]).select(
        "column", "value", (F.col("_rank") + len(RESERVED) - 1).cast("int").alias("index")
    )
    reserved = levels.select("column").distinct().select(
        "column", F.explode(F.create_map(*[F.lit(x) for pair in RESERVED.items() for x in pair])).alias("value", "index")
    )
    rare = levels.where(~F.col("kept") & ~F.col("value").isin(list(RESERVED))).select(
        "column", "value", F.lit(RESERVED[OTHER]).alias("index"))
    return write_through(reserved.unionByName(ranked).unionByName(rare), "vocabulary")


def apply_vocabulary(df: DataFrame, vocabulary: DataFrame, columns: list[str]) -> DataFrame:
    """Vocabulary number of each value; rare training values are OTHER, unseen UNKNOWN."""
    for c in columns:
        mine = vocabulary.where(F.col("column") == c).select(F.col("value").alias("_k"), F.col("index").alias("_index"))
        df = df.withColumn("_k", clean(c)).join(mine, "_k", "left")
        df = df.withColumn(f"{c}__index", F.coalesce("_index", F.lit(RESERVED[UNKNOWN]))).drop("_k", "_index")
    return df


def fit_scaling(train: DataFrame, columns: list[str]) -> DataFrame:
    """(column, median, mean, std, population_std, missing_share) of median-filled values, exact medians."""
    medians = exact_quantiles(train, columns, 0.5)
    known = {r["column"]: r["quantile"] for r in medians.collect()}  # one row per column
    measures = []
    for c in columns:
        filled = F.coalesce(number(c), F.lit(float(known.get(c, 0.0))))
        measures.append(F.struct(
            F.lit(c).alias("column"), F.lit(float(known.get(c, 0.0))).alias("median"), F.avg(filled).alias("mean"),
            F.stddev_samp(filled).alias("std"), F.stddev_pop(filled).alias("population_std"),
            (1 - F.count(number(c)) / F.count(F.lit(1))).alias("missing_share"),
        ))
    rows = train.agg(F.array(*measures).alias("m")).select(F.explode("m").alias("r")).select("r.*")
    usable = lambda s: F.when(s.isNotNull() & ~F.isnan(s) & (s > SCALE_EPSILON), s).otherwise(1.0)
    return rows.withColumns({"std": usable(F.col("std")), "population_std": F.when(F.col("population_std") > 0, F.col("population_std")).otherwise(1.0)})


def scaling_values(fitted: DataFrame) -> dict[str, dict]:
    """The fitted numbers as literals; one row per column."""
    return {r["column"]: r.asDict() for r in fitted.collect()}


def apply_scaling(df: DataFrame, fitted: DataFrame | dict[str, dict], columns: list[str]) -> DataFrame:
    """Standardised value and missing flag per column; infinite results are clamped."""
    values = fitted if isinstance(fitted, dict) else scaling_values(fitted)
    added = {}
    for c in columns:
        v = values[c]
        scaled = (F.coalesce(number(c), F.lit(v["median"])) - F.lit(v["mean"])) / F.lit(v["std"])
        infinite = F.abs(scaled) == F.lit(float("inf"))
        added[f"{c}__scaled"] = F.when(F.isnan(scaled), 0.0).when(infinite, F.signum(scaled) * CLAMP).otherwise(scaled)
        added[f"{c}__missing"] = number(c).isNull().cast("double")
    return df.withColumns(added)


def passthrough(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Numbers as they are, categories as text with MISSING, in a fixed column order."""
    categories = groups["low_cardinality"] + groups["high_cardinality"]
    return df.select(*[number(c).alias(c) for c in groups["numeric"]], *[clean(c).alias(c) for c in categories])


def fit_linear(train: DataFrame, groups: dict[str, list[str]], *, rare_min_count: int = RARE_MIN_COUNT) -> dict:
    """State of the linear encoding: scales without centring, one-hot levels, frequencies."""
    low, high = groups["low_cardinality"], groups["high_cardinality"]
    levels = fit_levels(train, low + high, rare_min_count=rare_min_count)
    values = scaling_values(fit_scaling(train, groups["numeric"])) if groups["numeric"] else {}
    found = _few_levels(levels, low) if low else {}
    one_hot = {
        c: {"kept": [r["value"] for r in rows if r["kept"]], "has_rare": any(not r["kept"] for r in rows)}
        for c, rows in found.items()
    }
    frequency_std = {}
    if high:
        spread = levels.where(F.col("column").isin(high)).groupBy("column").agg(
            # Deviation of the encoded training column, from its level counts.
            F.sqrt(F.greatest(F.sum(F.col("n") * F.col("share") * F.col("share")) / F.sum("n")
                              - F.pow(F.sum(F.col("n") * F.col("share")) / F.sum("n"), F.lit(2)), F.lit(0.0))).alias("s")
        )
        frequency_std = {r["column"]: r["s"] or 1.0 for r in spread.collect()}  # one row per column
    return {"groups": groups, "levels": levels, "numeric": values, "one_hot": one_hot, "frequency_std": frequency_std}


def apply_linear(df: DataFrame, state: dict) -> tuple[DataFrame, list[str]]:
    """Add the encoded columns and return their names in order.

    Missing flags are scaled like the numbers, by the deviation of a 0/1 column.
    """
    groups = state["groups"]
    df = apply_frequency(df, state["levels"], groups["high_cardinality"])
    added: dict[str, Column] = {}
    for c in groups["numeric"]:
        v = state["numeric"][c]
        added[f"num__{c}"] = F.coalesce(number(c), F.lit(v["median"])) / F.lit(v["population_std"])
        share = v["missing_share"]
        if share > 0:
            flag_std = math.sqrt(share * (1 - share)) or 1.0
            added[f"num__{c}__missing"] = number(c).isNull().cast("double") / F.lit(flag_std)
    for c in groups["low_cardinality"]:
        kept, value = state["one_hot"][c]["kept"], clean(c)
        for level in kept:
            added[f"cat__{c}__{level}"] = (value == F.lit(level)).cast("double")
        if state["one_hot"][c]["has_rare"]:
            added[f"cat__{c}__infrequent"] = (~value.isin(kept)).cast("double") if kept else F.lit(1.0)
    for c in groups["high_cardinality"]:
        added[f"freq__{c}"] = F.col(f"{c}__frequency") / F.lit(state["frequency_std"].get(c, 1.0))
    # Dots in level names would read as struct access, so columns get positional names.
    names = {name: f"x{i}" for i, name in enumerate(added)}
    encoded = df.withColumns({names[n]: value for n, value in added.items()})
    return encoded.drop(*[f"{c}__frequency" for c in groups["high_cardinality"]]), list(added)
