import math

from pyspark.sql import functions as F

from riskspark.functions import row_features as rf
from riskspark.schema import contract_columns, contract_schema
from tests.conftest import rows
from tests.fixtures import BASIC, basic, history


def test_contract_has_433_columns():
    names = contract_columns()
    assert len(names) == len(set(names)) == 433 == len(contract_schema())
    assert names[0] == "TransactionID" and names[-1] == "DeviceInfo" and "isFraud" not in names


def test_v1_features(spark):
    found = {r["TransactionID"]: r for r in rows(rf.with_v1_features(basic(spark)))}
    assert found[27]["transaction_amount_cents"] == 75
    assert math.isclose(found[27]["transaction_amount_log1p"], math.log1p(18.75))
    assert found[24]["transaction_amount_log1p"] is None and found[24]["transaction_amount_cents"] is None
    empty = {r[0]: sum(v is None for v in r) for r in BASIC}
    assert {i: r["num_missing"] for i, r in found.items()} == empty and empty[24] == 5
    assert found[21]["transaction_missing"] == 1 and found[24]["card_address_missing"] == 1 and found[22]["identity_missing"] == 1
    assert found[24]["card_1_2"] == "5__MISSING" and found[29]["email_pair"] == "post.test__MISSING"


def test_negative_amount_logs_as_zero(spark):
    df = spark.createDataFrame([(1, -3.0)], "TransactionID long, TransactionAmt double")
    assert rows(rf.with_v1_features(df))[0]["transaction_amount_log1p"] == 0.0


def test_v2_features(spark):
    found = {r["TransactionID"]: r for r in rows(rf.with_v2_row_features(history(spark)))}
    assert found[13]["uid_proxy"] == "55__70__0" and found[14]["uid_proxy"] == "66__80__-3"
    assert found[17]["device_key"] == "MISSING__MISSING" and found[15]["device_key"] == "tablet__Pad 10"
    assert found[12]["browser_family"] == "edge" and found[15]["operating_system_family"] == "android"
    # A missing text is filled before lower-casing, so it reads as a word.
    assert found[17]["browser_family"] == "missing"


def test_family_without_leading_letter(spark):
    df = spark.createDataFrame([("3-MEDIUM",), ("  Chrome 5",), ("",)], "id_31 string")
    assert [r["f"] for r in rows(df.select(rf.agent_family("id_31").alias("f")))] == ["MISSING", "chrome", "MISSING"]


def test_relative_time_of_large_values(spark):
    df = spark.createDataFrame([(15_811_131.0,)], "TransactionDT double")
    one = rows(df.select(*[v.alias(n) for n, v in rf.relative_time_features().items()]))[0]
    assert one == {"transaction_relative_day": 182.0, "transaction_relative_week": 26.0, "transaction_relative_hour_phase": 23.0}


def test_model_columns_exclude_label_and_id():
    assert rf.model_columns(["TransactionID", "x", "isFraud"]) == ["x"]


def test_null_count_of_nothing(spark):
    assert rows(spark.range(1).select(rf.null_count([]).alias("n"), F.lit(1)))[0]["n"] == 0
