"""Table contract: column names, groups and types of a joined transaction row."""

from __future__ import annotations

from pyspark.sql import types as T

ID = "TransactionID"
TIME = "TransactionDT"
AMOUNT = "TransactionAmt"
LABEL = "isFraud"
MISSING = "MISSING"
OTHER = "OTHER"
UNKNOWN = "UNKNOWN"

# Numeric codes that are categories, not quantities.
CODE_COLUMNS = ["card1", "card2", "card3", "card5", "addr1", "addr2"]

# Text columns of the transaction table outside M1..M9.
TEXT_COLUMNS = ["ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain"]

# Numbers of the id_ fields that hold text.
TEXT_IDENTITY_NUMBERS = {12, 15, 16, 23, 27, 28, 29, 30, 31, 33, 34, 35, 36, 37, 38}

# The time-delta columns that are re-based on the current day.
D_COLUMNS = ["D1", "D2", "D4", "D10", "D15"]


def _numbered(prefix: str, last: int, first: int = 1) -> list[str]:
    return [f"{prefix}{n}" for n in range(first, last + 1)]


def identity_fields() -> list[str]:
    return [f"id_{n:02d}" for n in range(1, 39)] + ["DeviceType", "DeviceInfo"]


def contract_columns() -> list[str]:
    """The 433 model-input columns in training order."""
    return (
        [ID, TIME, AMOUNT, "ProductCD"]
        + _numbered("card", 6)
        + _numbered("addr", 2)
        + _numbered("dist", 2)
        + ["P_emaildomain", "R_emaildomain"]
        + _numbered("C", 14)
        + _numbered("D", 15)
        + _numbered("M", 9)
        + _numbered("V", 339)
        + identity_fields()
    )


def column_type(name: str) -> T.DataType:
    if name == ID:
        return T.LongType()
    if name == LABEL:
        return T.IntegerType()
    if name in TEXT_COLUMNS or name in {"DeviceType", "DeviceInfo"}:
        return T.StringType()
    if name.startswith("M") and name[1:].isdigit():
        return T.StringType()
    if name.startswith("id_") and int(name[3:]) in TEXT_IDENTITY_NUMBERS:
        return T.StringType()
    if name == "card1":
        return T.LongType()
    return T.DoubleType()


def contract_schema(columns: list[str] | None = None) -> T.StructType:
    """StructType of the contract, or of the given subset in the given order."""
    return T.StructType([T.StructField(c, column_type(c)) for c in columns or contract_columns()])


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.BooleanType))


def is_category(name: str, data_type: T.DataType) -> bool:
    return name in CODE_COLUMNS or is_text(data_type)


def identity_value_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.startswith("id_") or c in {"DeviceType", "DeviceInfo"}]


# Model identifiers, their display names and the feature versions.
MODEL_NAMES = {
    "logistic_regression.v1": "LogisticRegression.V1",
    "lightgbm.v1": "LightGBM.V1",
    "catboost.v1": "CatBoost.V1",
    "neural_network.v1": "NeuralNetwork.V1",
    "logistic_regression.v2": "LogisticRegression.V2",
    "lightgbm.v2": "LightGBM.V2",
    "catboost.v2": "CatBoost.V2",
    "neural_network.v2": "NeuralNetwork.V2",
}
VERSIONS = ["V1", "V2"]

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField(ID, T.LongType()),
        T.StructField("model_identifier", T.StringType()),
        T.StructField("risk_score", T.DoubleType()),
    ]
)
