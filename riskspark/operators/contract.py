"""Input contract: names, types, row verdicts, quarantine and duplicates."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.row_features import number
from riskspark.schema import AMOUNT, ID, LABEL, TIME, column_type, contract_columns, identity_value_columns
from riskspark.session import write_through

# Error codes and messages reported for a refused row.
DUPLICATE_CODE = "duplicate_transaction_id"
INVALID_CODE = "invalid_prediction_input"
DUPLICATE_TEXT = "TransactionID is duplicated in the uploaded CSV"
FINITE_ID_TEXT = "TransactionID must be a finite integer"
POSITIVE_ID_TEXT = "TransactionID must be a positive integer"
TIME_TEXT = "TransactionDT must be a finite non-negative number"
AMOUNT_TEXT = "TransactionAmt must be a finite non-negative number"
OVERLAP_TEXT = "Behavioral reference overlaps the transaction being scored"


def normalize_names(df: DataFrame) -> DataFrame:
    """Identity columns arrive as ``id-01`` in some files."""
    return df.withColumnsRenamed({c: c.replace("id-", "id_") for c in df.columns if c.startswith("id-")})


def schema_difference(columns: list[str], contract: list[str]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) names against a contract."""
    return sorted(set(contract) - set(columns)), sorted(set(columns) - set(contract))


def align_contract(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Contract columns in contract order and type; absent optional columns become NULL."""
    columns = columns or contract_columns()
    names = [c for c in df.columns if c != LABEL]
    if len(names) != len(set(names)):
        raise ValueError("these rows have a duplicate column name")
    unexpected = schema_difference(names, columns)[1]
    if unexpected:
        raise ValueError(f"unknown fields, for which the contract has no column: {unexpected}")
    for required in (ID, TIME):
        if required not in names:
            raise ValueError(f"Missing required field, which every row needs: {required}")
    types = {c: column_type(c).simpleString() for c in columns}
    return df.select(*[
        F.expr(f"try_cast(`{c}` as {types[c]})").alias(c) if c in names else F.lit(None).cast(types[c]).alias(c)
        for c in columns
    ])


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Unparseable text and NaN become NULL; infinities stay and are judged later."""
    return df.withColumns({c: F.nanvl(number(c), F.lit(None).cast("double")) for c in columns})


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL are one notion of missing; applied once at ingestion."""
    floats = [c for c, t in df.dtypes if t in {"double", "float"}]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in floats}) if floats else df


def _id_text() -> Column:
    """Spelling-independent id: 7 and 7.0 are one id, unparseable text stands for itself."""
    return F.coalesce(number(ID).cast("string"), F.col(ID).cast("string"), F.lit(""))


def duplicate_flag(df: DataFrame, name: str = "is_duplicate") -> DataFrame:
    """Flag every copy of a repeated id.

    Counts combine before the shuffle and only repeated ids come back, so a huge group of
    copies never meets in one task. The repeated ids are written first: the planner sees
    their real size, broadcasts a short list without shuffling the rows, and joins a long
    one by shuffle, where AQE splits the skewed side.
    """
    keyed = df.withColumn("_id_text", _id_text())
    repeated = (
        keyed.groupBy("_id_text").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
        .select("_id_text", F.lit(True).alias(name))
    )
    repeated = write_through(repeated, "repeated-ids")
    return keyed.join(repeated, "_id_text", "left").drop("_id_text").withColumn(name, F.coalesce(name, F.lit(False)))


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def validate_rows(
    df: DataFrame, *, cutoff: tuple[float, int] | None = None, contract: list[str] | None = None, unique: bool = False
) -> DataFrame:
    """Add ``error_code`` and ``error_message``; the first failing check wins.

    ``unique`` says that ids are known not to repeat, which saves counting them.
    """
    flagged = df.withColumn("_duplicate", F.lit(False)) if unique else duplicate_flag(df, "_duplicate")
    ident, seconds, amount = number(ID), number(TIME), number(AMOUNT) if AMOUNT in df.columns else F.lit(None).cast("double")
    failures: list[tuple[Column, str]] = []
    if contract is not None:
        unexpected = schema_difference([c for c in df.columns if c != LABEL], contract)[1]
        if unexpected:
            failures.append((F.lit(True), f"unknown fields, for which the contract has no column: {unexpected}"))
    failures += [
        (~_finite(ident), FINITE_ID_TEXT),
        ((ident <= 0) | (ident % 1 != 0), POSITIVE_ID_TEXT),
        (~_finite(seconds) | (seconds < 0), TIME_TEXT),
        (amount.isNotNull() & ~F.isnan(amount) & (~_finite(amount) | (amount < 0)), AMOUNT_TEXT),
    ]
    if cutoff is not None:
        end = F.struct(F.lit(float(cutoff[0])).alias("t"), F.lit(float(cutoff[1])).alias("i"))
        failures.append((end >= F.struct(seconds.alias("t"), ident.alias("i")), OVERLAP_TEXT))
    text = F.when(F.col("_duplicate"), F.lit(DUPLICATE_TEXT))
    for test, message in failures:
        text = text.when(test, F.lit(message))
    return flagged.withColumn("error_message", text).withColumn(
        "error_code",
        F.when(F.col("_duplicate"), F.lit(DUPLICATE_CODE)).when(F.col("error_message").isNotNull(), F.lit(INVALID_CODE)),
    ).drop("_duplicate")


def quarantine_split(
    df: DataFrame, *, ordinal: str, cutoff: tuple[float, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid report). ``ordinal`` is the zero-based position in the file."""
    inputs = [c for c in df.columns if c != ordinal]
    judged = validate_rows(df, cutoff=cutoff)
    valid = judged.where("error_code is null").drop("error_code", "error_message")
    invalid = judged.where("error_code is not null").select(
        (F.col(ordinal) + 2).alias("row_number"), F.col(ID).cast("string").alias("transaction_id"),
        "error_code", F.col("error_message").alias("message"), encode_payload(inputs).alias("input_payload"),
    )
    return valid, invalid


def encode_payload(columns: list[str]) -> Column:
    """Sparse JSON of a row: no NULL, no non-finite number, no label."""
    return F.to_json(F.struct(*[F.col(c) for c in columns if c != LABEL]))


def finite_only(df: DataFrame) -> DataFrame:
    """Infinite and NaN doubles become NULL so that JSON leaves them out."""
    floats = [c for c, t in df.dtypes if t in {"double", "float"}]
    return df.withColumns({c: F.when(_finite(F.col(c)), F.col(c)) for c in floats}) if floats else df


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Exact number of repeated whole rows.

    Only 64-bit hashes travel for all rows; whole rows are compared for repeated hashes.
    """
    hashed = df.withColumn("_h", F.xxhash64(*[F.col(c) for c in df.columns]))
    suspects = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")
    groups = hashed.join(suspects, "_h", "left_semi").groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def protect_columns(df: DataFrame) -> DataFrame:
    """Model frame without label and id."""
    return df.drop(LABEL, ID)


def assert_protected(columns: list[str]) -> None:
    if LABEL in columns or ID in columns:
        raise ValueError("label and id must not be inputs of a model")


def input_completeness(columns: list[str]) -> Column:
    filled = F.aggregate(F.array(*[F.col(c).isNotNull().cast("int") for c in columns]), F.lit(0), lambda a, x: a + x)
    return filled / F.lit(float(len(columns)))


def has_identity_values(columns: list[str]) -> Column:
    """1 when any identity value is present (the serving rule)."""
    present = [F.col(c).isNotNull() for c in identity_value_columns(columns)]
    found = F.lit(False)
    for test in present:
        found = found | test
    return found.cast("int")


def column_usability(train: DataFrame) -> DataFrame:
    """One row per candidate column: usable unless all NULL or constant (NULL is a value)."""
    names = [c for c in train.columns if c not in {ID, LABEL}]
    measures = []
    for c in names:
        constant = (F.count(c) == 0) | ((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)))
        measures.append(F.coalesce(constant, F.lit(True)).alias(c))
    flags = train.agg(*measures)
    return flags.unpivot([], names, "column", "unusable")


def drop_unusable(frames: list[DataFrame], train: DataFrame) -> list[DataFrame]:
    """Drop columns that carry no information in training from every given frame."""
    names = [row["column"] for row in column_usability(train).where("unusable").collect()]  # one row per column
    return [f.drop(*names) for f in frames]


def constraint_audit(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Violations per rule; as in a CHECK, NULL counts as passed. One pass for all rules."""
    counts = df.agg(*[F.count_if(F.expr(f"not ({predicate})")).alias(name) for name, predicate in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


# CHECK rules of the run, event, prediction, alert and history tables.
RUN_RULES = {
    "rate_allowed": "transactions_per_second in (1, 2, 5)",
    "status_known": "status in ('LOADING', 'RUNNING', 'PAUSED', 'STOPPED', 'COMPLETED', 'FAILED')",
    "sequence_from_minus_one": "current_sequence >= -1",
    "counters_not_negative": "received_count >= 0 and processed_count >= 0 and fraud_count >= 0 and failed_count >= 0",
    "versions_known": "size(selected_versions) > 0 and size(array_except(selected_versions, array('V1', 'V2'))) = 0",
    "models_known": (
        "size(selected_models) > 0 and size(array_except(selected_models, array("
        "'logistic_regression.v1', 'lightgbm.v1', 'catboost.v1', 'neural_network.v1', "
        "'logistic_regression.v2', 'lightgbm.v2', 'catboost.v2', 'neural_network.v2'))) = 0"
    ),
    "counters_add_up": "processed_count + failed_count <= received_count",
}
EVENT_RULES = {
    "sequence_not_negative": "sequence_number >= 0",
    "queue_not_negative": "queue_position >= 0",
    "status_known": "status in ('QUEUED', 'PROCESSING', 'COMPLETED', 'FAILED')",
    "times_follow_status": (
        "(status = 'QUEUED' and processing_started_at is null and completed_at is null) or "
        "(status = 'PROCESSING' and processing_started_at is not null and completed_at is null) or "
        "(status in ('COMPLETED', 'FAILED') and processing_started_at is not null and completed_at is not null)"
    ),
}
PREDICTION_RULES = {
    "score_in_unit": "risk_score between 0 and 1",
    "threshold_in_unit": "threshold between 0 and 1",
    "latency_not_negative": "latency_ms >= 0",
}
ALERT_RULES = {
    "status_known": "status in ('OPEN', 'IN_REVIEW', 'CONFIRMED_FRAUD', 'LEGITIMATE', 'ESCALATED', 'CLOSED')",
    "score_in_unit": "highest_risk_score between 0 and 1",
    "votes_not_negative": "model_agreement >= 0",
    "models_positive": "selected_model_count > 0",
    "amount_not_negative": "suspicious_amount is null or suspicious_amount >= 0",
    "votes_within_models": "model_agreement <= selected_model_count",
}
HISTORY_RULES = {
    "status_known": "status in ('PROCESSING', 'COMPLETED', 'PARTIAL', 'FAILED')",
    "one_to_eight_models": "size(selected_models) between 1 and 8",
    "counters_add_up": "successful_transactions + failed_transactions <= total_transactions",
}


def unique_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Number of key values that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.count_if(F.col("_n") > 1).alias("repeated_keys"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")
    )


def orphan_rows(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``child`` whose key is set but absent from ``parent``; as in a foreign key, a NULL passes."""
    named = F.lit(True)
    for c in key:
        named = named & F.col(c).isNotNull()
    return child.where(named).join(parent.select(*key), key, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


def key_audit(tables: dict[str, DataFrame], unique: dict[str, list[str]], parents: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(table_name, rule, violations): keys that occur more than once, and rows without their parent (child, parent, key)."""
    parts = [
        unique_violations(tables[t], key).select(F.lit(t).alias("table_name"), F.lit(f"unique {', '.join(key)}").alias("rule"), F.col("repeated_keys").alias("violations"))
        for t, key in unique.items()
    ]
    parts += [
        orphan_rows(tables[c], tables[p], key).select(F.lit(c).alias("table_name"), F.lit(f"{', '.join(key)} in {p}").alias("rule"), F.col("orphans").alias("violations"))
        for c, p, key in parents
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def safe_id_parse(column: str | Column) -> Column:
    """Exact integer spelling (``100`` or ``100.0``) to bigint, anything else NULL."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    head = F.regexp_extract(text, r"^(0|-?[1-9][0-9]*)(\.0)?$", 1)
    return F.nullif(head, F.lit("")).try_cast("bigint")


def mask_value(key: Column, value: Column) -> Column:
    """Mask card, address, mail, device and identity fields; shorten other long texts."""
    bullets = F.lit("••••")
    sensitive = F.lower(key).rlike("card|addr|email|device|id_")
    return (
        F.when(sensitive & (F.length(value) <= 4), bullets)
        .when(sensitive, F.concat(bullets, F.right(value, F.lit(4))))
        .when(F.length(value) > 32, F.concat(F.substring(value, 1, 29), F.lit("…")))
        .otherwise(value)
    )


def mask_sensitive(df: DataFrame, id_columns: list[str], columns: list[str]) -> DataFrame:
    """Long (id, field, value) view with masked values, NULL fields left out."""
    pairs = F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns])
    )).alias("field", "raw")
    return df.select(*id_columns, pairs).where("raw is not null").select(
        *id_columns, "field", mask_value(F.col("field"), F.col("raw")).alias("value")
    )
