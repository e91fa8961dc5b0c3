"""Typed scans, lookups and payload decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.operators.contract import nan_to_null
from riskspark.schema import AMOUNT, ID, TIME, identity_value_columns

# Spellings a CSV reader treats as missing.
CSV_MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# The columns needed to rebuild behavioural state.
HISTORY_COLUMNS = [
    ID, TIME, AMOUNT, "card1", "addr1", "D1", "D4", "D10", "D15", "P_emaildomain", "DeviceType", "DeviceInfo",
]


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header to the given types; every usual spelling of missing becomes NULL.

    Read as text first because the reader knows a single null spelling.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(text).option("header", True).option("escape", '"').csv(path)
    typed = raw.select(*[
        F.when(~F.col(f.name).isin(CSV_MISSING), F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in schema
    ])
    return nan_to_null(typed)


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Only the named columns reach the scan."""
    return spark.read.parquet(path).select(*(columns or HISTORY_COLUMNS))


def point_lookup(df: DataFrame, transaction_id: int, key: str = ID) -> DataFrame:
    """At most two rows of one id; the filter is pushed to the file scan."""
    return df.where(F.col(key) == transaction_id).limit(2)


def require_single(df: DataFrame, transaction_id: int) -> dict:
    """The row as a dict; no row and repeated rows are different errors."""
    rows = point_lookup(df, transaction_id).collect()  # two rows at most
    if not rows:
        raise LookupError(f"TransactionID {transaction_id} is not in the dataset")
    if len(rows) > 1:
        raise ValueError(f"Duplicate identifier {transaction_id}")
    return rows[0].asDict()


def paged_listing(df: DataFrame, *, limit: int, offset: int, sequence: str = "sequence_number") -> DataFrame:
    """A page of label-free summary columns in sequence order."""
    identity = [F.col(c).isNotNull() for c in identity_value_columns(df.columns)]
    found = F.lit(False)
    for test in identity:
        found = found | test
    page = df.where((F.col(sequence) >= offset) & (F.col(sequence) < offset + limit)).orderBy(sequence)
    return page.select(
        F.col(ID).alias("transaction_id"), F.col(TIME).cast("double").alias("transaction_dt"),
        F.col(AMOUNT).alias("transaction_amount"), F.col("ProductCD").alias("product_code"),
        found.alias("has_identity"),
    )


def keyset_batch(df: DataFrame, *, after_sequence: int, limit: int = 100, sequence: str = "sequence_number") -> DataFrame:
    """Next rows after a sequence number, at most 100, in order."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return df.where(F.col(sequence) > after_sequence).orderBy(sequence).limit(limit)


def decode_payload(df: DataFrame, schema: T.StructType, column: str = "transaction_payload") -> DataFrame:
    """Stored JSON to typed columns; absent fields are NULL."""
    others = [c for c in df.columns if c != column]
    return df.withColumn("_p", F.from_json(column, schema)).select(*others, "_p.*")
