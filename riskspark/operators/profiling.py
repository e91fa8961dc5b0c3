"""Profiles and rates: one pass per table, distinct values counted in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.operators.contract import duplicate_row_count
from riskspark.operators.ordering import EVENT_ORDER, exact_quantiles
from riskspark.schema import (
    AMOUNT, CODE_COLUMNS, ID, LABEL, TIME, is_category, is_text,
)
from riskspark.session import single_row

DAY = 86_400


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for several columns; NULL is a value here.

    Counts combine on the map side and travel by (column, value), so neither a frequent
    value nor a wide table lands in one task. Distinct counts, missing shares, category
    levels and examples all read this one table.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("p")
    return df.select(pairs).select("p.column", "p.value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, missing, distinct_values), distinct without NULL."""
    counts = value_counts(df, columns)
    return counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("value").alias("distinct_values"),
    )


def type_name(data_type: T.DataType) -> str:
    return data_type.simpleString()


def _types(df: DataFrame) -> Column:
    pairs = [F.lit(x) for f in df.schema for x in (f.name, type_name(f.dataType))]
    return F.create_map(*pairs)[F.col("column")]


def profile_table(df: DataFrame, name: str) -> DataFrame:
    """Shape, missing cells, constant columns and exact duplicate rows of a table."""
    columns = df.columns
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    text = lambda c: F.col(c).cast("string")
    # One pass and one row: a column is constant when its least and greatest text are the same, or it has none.
    cells = F.array(*[
        F.struct(F.count(c).alias("present"), F.coalesce(F.min(text(c)) == F.max(text(c)), F.lit(True)).alias("same")) for c in columns
    ])
    one = df.agg(F.count(F.lit(1)).alias("rows"), cells.alias("_c"))
    present = F.aggregate("_c", F.lit(0).cast("bigint"), lambda a, x: a + x["present"])
    missing = F.col("rows") * F.lit(len(columns)) - present
    summary = one.select(
        "rows", F.size(F.filter("_c", lambda x: x["present"] == 0)).cast("bigint").alias("all_missing"),
        F.size(F.filter("_c", lambda x: x["same"])).cast("bigint").alias("constant"),
        missing.alias("missing_cells"), F.try_divide(missing, F.col("rows") * F.lit(len(columns))).alias("missing_rate"),
    )
    counted = summary.withColumns({
        "name": F.lit(name), "columns": F.lit(len(columns)), "numeric": F.lit(len(numeric)),
        "categorical": F.lit(len(columns) - len(numeric)),
    })
    return counted.withColumn("_d", single_row(duplicate_row_count(df))).select(*counted.columns, "_d.*")


def profile_missing(df: DataFrame, top: int = 25) -> DataFrame:
    summary = column_summary(df, df.columns)
    return summary.where("missing > 0").select(
        "column", (F.col("missing") / F.col("rows") * 100).alias("missing_pct"), _types(df).alias("dtype"),
        F.col("distinct_values").alias("unique_values"),
    ).orderBy(F.desc("missing_pct"), "column").limit(top)


def profile_cardinality(df: DataFrame) -> DataFrame:
    names = [f.name for f in df.schema if is_text(f.dataType)]
    return column_summary(df, names).select(
        "column", F.col("distinct_values").alias("unique_values"), (F.col("missing") / F.col("rows") * 100).alias("missing_pct")
    ).orderBy(F.desc("unique_values"), "column")


def rate_by(df: DataFrame, group: str | Column, name: str, label: str = LABEL) -> DataFrame:
    """Rows, positives and positive share per group, highest share first."""
    key = (F.col(group) if isinstance(group, str) else group).alias(name)
    return df.groupBy(key).agg(
        F.count(label).alias("count"), F.sum(label).cast("bigint").alias("sum"), F.avg(label).alias("mean")
    ).orderBy(F.desc("mean"), name)


def rate_by_day(df: DataFrame, label: str = LABEL) -> DataFrame:
    day = F.floor(F.col(TIME) / DAY).cast("int").alias("day")
    return df.groupBy(day).agg(F.count(label).alias("count"), F.avg(label).alias("mean"))


def amount_by_label(df: DataFrame) -> DataFrame:
    """Amount statistics per class with an exact, distributed median."""
    base = df.groupBy(LABEL).agg(
        F.count(AMOUNT).alias("count"), F.avg(AMOUNT).alias("mean"), F.min(AMOUNT).alias("min"), F.max(AMOUNT).alias("max")
    )
    medians = exact_quantiles(df, [AMOUNT], 0.5, by=[LABEL]).select(LABEL, F.col("quantile").alias("median"))
    return base.join(medians, LABEL, "left")


def class_balance(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Count and share per class and the negative-to-positive ratio, from one aggregate."""
    totals = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    ratio = F.try_divide(F.col("n0"), F.col("n1"))
    total = F.col("n0") + F.col("n1")
    rows = F.explode(F.array(
        F.struct(F.lit(0).alias("label"), F.col("n0").alias("rows"), F.try_divide(F.col("n0"), total).alias("share"), ratio.alias("ratio")),
        F.struct(F.lit(1).alias("label"), F.col("n1").alias("rows"), F.try_divide(F.col("n1"), total).alias("share"), ratio.alias("ratio")),
    )).alias("r")
    return totals.select(rows).select("r.*")


def positive_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Class weight per mode; ``raise_error`` fires when there is no positive row."""
    totals = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    ratio = F.when(F.col("n1") == 0, F.raise_error(F.lit("Training partition contains no fraud examples")).cast("double")) \
        .otherwise(F.try_divide(F.col("n0"), F.col("n1")))
    modes = F.explode(F.array(*[
        F.struct(F.lit(mode).alias("mode"), value.alias("weight"))
        for mode, value in (("none", F.when(ratio.isNotNull(), F.lit(1.0))), ("balanced", ratio), ("sqrt_balanced", F.sqrt(ratio)))
    ])).alias("w")
    return totals.select(modes).select("w.*")


def positive_weight(df: DataFrame, mode: str, label: str = LABEL) -> float:
    found = positive_weights(df, label).where(F.col("mode") == mode).collect()  # one row
    if not found:
        raise ValueError(f"no weight mode has the name {mode}")
    return float(found[0]["weight"])


def corr_screen(df: DataFrame, label: str = LABEL, top: int = 20) -> DataFrame:
    """Absolute Pearson correlation of every numeric column with the label, one pass."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != label]
    wide = df.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col(label).cast("double"))).alias(c) for c in names])
    return wide.unpivot([], names, "feature", "abs_corr").where("abs_corr is not null and not isnan(abs_corr)") \
        .orderBy(F.desc("abs_corr"), "feature").limit(top)


# Group and description per column name or name family.
KNOWN_COLUMNS = {
    ID: ("Identifier", "Unique transaction identifier and join key. Do not use as a deployment feature."),
    LABEL: ("Target", "Training label: 1 means fraud and 0 means legitimate. Not available for future scoring."),
    TIME: ("Transaction", "Relative time in seconds from a reference point; not a real calendar timestamp."),
    AMOUNT: ("Transaction", "Transaction amount."),
    "ProductCD": ("Transaction", "Anonymized product/payment category code."),
    "card1": ("Payment card", "Anonymized payment-card attribute 1; identifier-like numeric field."),
    "card2": ("Payment card", "Anonymized payment-card attribute 2."),
    "card3": ("Payment card", "Anonymized payment-card attribute 3."),
    "card4": ("Payment card", "Card network/category, e.g. visa, mastercard, american express, discover."),
    "card5": ("Payment card", "Anonymized payment-card attribute 5."),
    "card6": ("Payment card", "Card type/category, e.g. credit, debit, charge card."),
    "addr1": ("Address", "Anonymized billing/address attribute 1."),
    "addr2": ("Address", "Anonymized billing/address attribute 2."),
    "dist1": ("Distance", "Anonymized distance attribute 1."),
    "dist2": ("Distance", "Anonymized distance attribute 2."),
    "P_emaildomain": ("Email", "Purchaser email-domain category."),
    "R_emaildomain": ("Email", "Recipient email-domain category."),
    "DeviceType": ("Device identity", "Device class, commonly desktop or mobile."),
    "DeviceInfo": ("Device identity", "Anonymized/raw device-information string, often device family or model."),
}
NUMBERED_COLUMNS = {
    "C": ("Count feature", "Anonymized count-like transaction feature; exact business meaning is not disclosed."),
    "D": ("Time delta", "Anonymized time-delta feature; exact business meaning is not disclosed."),
    "M": ("Match flag", "Anonymized yes/no match-style feature; exact business meaning is not disclosed."),
    "V": ("Vesta engineered", "Anonymized Vesta engineered numerical feature; exact business meaning is not disclosed."),
}
IDENTITY_COLUMN = ("Device identity", "Anonymized device/identity feature; exact business meaning is not disclosed except for documented string examples.")
OTHER_COLUMN = ("Other", "Anonymized competition field; consult Kaggle documentation if a precise definition is required.")


def describe_column(name: str) -> tuple[str, str]:
    if name in KNOWN_COLUMNS:
        return KNOWN_COLUMNS[name]
    if name.startswith("id_"):
        return IDENTITY_COLUMN
    return NUMBERED_COLUMNS.get(name[:1], OTHER_COLUMN) if name[1:].isdigit() else OTHER_COLUMN


def data_dictionary(df: DataFrame, examples: int = 5) -> DataFrame:
    """Column, group, type, missing share, distinct count, smallest examples, description.

    Examples are the smallest texts, so the result does not depend on file order.
    """
    columns = df.columns
    counts = value_counts(df, columns)
    summary = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("value").alias("distinct_values"),
    )
    # Spark keeps at most ``examples`` rows per column before this window's shuffle.
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    shown = counts.where("value is not null").withColumn("_r", rank).where(F.col("_r") <= examples).groupBy("column").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("value")), lambda v: F.substring(F.replace(v, F.lit("|"), F.lit("/")), 1, 45)), ", ").alias("examples")
    )
    facts = [describe_column(c) for c in columns]
    lookup = lambda position: F.create_map(*[F.lit(x) for c, f in zip(columns, facts) for x in (c, f[position])])[F.col("column")]
    return summary.join(shown, "column", "left").select(
        "column", lookup(0).alias("group"), _types(df).alias("dtype"), (F.col("missing") / F.col("rows")).alias("missing_share"),
        "distinct_values", F.coalesce("examples", F.lit("No non-null values")).alias("examples"), lookup(1).alias("description"),
    )


def cardinality_band(distinct: Column) -> Column:
    return F.when(distinct <= 20, "low").when(distinct <= 100, "medium").when(distinct <= 1000, "high").otherwise("very_high")


# What the audit says of a feature by model, for few levels, many levels and numbers.
EXCLUDED_TREATMENT = "exclude from model input"
TREATMENTS = {
    "logistic_regression": ("one-hot with rare grouping", "frequency encode", "median impute, missing indicator, standardize"),
    "lightgbm": ("native category", "frequency encode", "numeric; preserve NaN; no scaling"),
    "catboost": ("native categorical string", "native categorical string", "numeric; preserve NaN; no scaling"),
    "neural_network": ("training vocabulary plus embedding", "training vocabulary plus embedding", "median impute, missing indicator, standardize"),
}


def feature_audit(train: DataFrame) -> DataFrame:
    """Role, missing share, cardinality band and treatment per model family."""
    types = {f.name: f.dataType for f in train.schema}

    def role(name: str) -> str:
        if name in (LABEL, ID):
            return "target" if name == LABEL else "row_identifier"
        if name in CODE_COLUMNS:
            return "identifier_code"
        return "categorical" if is_text(types[name]) else "numeric"

    roles = F.create_map(*[F.lit(x) for c in train.columns for x in (c, role(c))])[F.col("column")]
    summary = column_summary(train, train.columns).withColumn("role", roles)
    excluded = F.col("role").isin("target", "row_identifier")
    category = F.col("role").isin("identifier_code", "categorical")
    small = F.col("distinct_values") <= 100

    def treatment(model: str) -> Column:
        for_small, for_large, for_number = TREATMENTS[model]
        return (
            F.when(excluded, EXCLUDED_TREATMENT).when(category & small, for_small)
            .when(category, for_large).otherwise(for_number)
        )

    return summary.select(
        F.col("column").alias("feature"), _types(train).alias("dtype"), "role",
        F.round(F.col("missing") / F.col("rows") * 100, 4).alias("missing_percent_train"),
        F.col("distinct_values").alias("unique_non_null_train"),
        F.when(category, cardinality_band(F.col("distinct_values"))).otherwise("not_applicable").alias("cardinality_band"),
        *[treatment(model).alias(model) for model in TREATMENTS],
    )


def feature_groups(df: DataFrame, low_max: int = 100) -> DataFrame:
    """(feature, group): numeric, low_cardinality or high_cardinality."""
    inputs = [f for f in df.schema if f.name not in (ID, LABEL)]
    categories = [f.name for f in inputs if is_category(f.name, f.dataType)]
    numbers = [f.name for f in inputs if f.name not in categories and isinstance(f.dataType, T.NumericType)]
    summary = column_summary(df, categories).select(
        F.col("column").alias("feature"),
        F.when(F.col("distinct_values") <= low_max, "low_cardinality").otherwise("high_cardinality").alias("group"),
    )
    numeric = df.sparkSession.createDataFrame([(n, "numeric") for n in numbers], "feature string, group string")
    return summary.unionByName(numeric)


def infer_feature_groups(df: DataFrame, low_max: int = 100) -> dict[str, list[str]]:
    """The same as lists in column order; one row per column reaches the driver."""
    group_of = {r["feature"]: r["group"] for r in feature_groups(df, low_max).collect()}
    return {g: [c for c in df.columns if group_of.get(c) == g] for g in ("numeric", "low_cardinality", "high_cardinality")}


def dataset_summary(df: DataFrame, payload: str | None = None) -> DataFrame:
    """Rows, positives, first and last id in event order, or distinct payload fields."""
    order = F.struct(*EVENT_ORDER)
    measures = [F.count(F.lit(1)).alias("row_count"), F.min_by(ID, order).alias("first_transaction_id"), F.max_by(ID, order).alias("last_transaction_id")]
    if LABEL in df.columns:
        measures += [F.sum(LABEL).cast("bigint").alias("fraud_count"), F.avg(LABEL).alias("fraud_rate")]
    base = df.agg(*measures)
    if payload is None:
        return base
    fields = df.select(F.explode(F.json_object_keys(payload)).alias("f")).agg(F.count_distinct("f").alias("distinct_payload_fields"))
    return base.withColumn("_f", single_row(fields)).select(*base.columns, "_f.*")
