import pytest
from pyspark.sql import functions as F

from riskspark.operators import contract as c
from riskspark.operators import joins
from riskspark.schema import contract_columns
from riskspark.sources import readers, sinks
from tests.conftest import rows

COLUMNS = ["TransactionID", "TransactionDT", "TransactionAmt", "card1", "addr1", "D1", "D4", "D10", "D15", "P_emaildomain", "DeviceInfo", "DeviceType"]
TEXT = "TransactionID string, TransactionDT string, TransactionAmt string"


def base_row(spark):
    return spark.createDataFrame([(2, 200.0, 25.5, 1001, 10.0, 0.0, 0.0, 0.0, 0.0, "bank.test", "desktop", 1)],
                                 "TransactionID long, TransactionDT double, TransactionAmt double, card1 long, addr1 double, D1 double, D4 double, D10 double, D15 double, P_emaildomain string, DeviceType string, isFraud int")


def test_align_drops_label_and_fills(spark):
    aligned = c.align_contract(base_row(spark), COLUMNS)
    assert aligned.columns == COLUMNS and rows(aligned)[0]["DeviceInfo"] is None
    sparse = c.align_contract(base_row(spark).select("TransactionID", "TransactionDT"))
    assert sparse.columns == contract_columns()


def test_align_rejects(spark):
    with pytest.raises(ValueError, match="unknown fields"):
        c.align_contract(base_row(spark).withColumn("surprise", F.lit(1)), COLUMNS)
    with pytest.raises(ValueError, match="Missing required field"):
        c.align_contract(base_row(spark).drop("TransactionDT"), COLUMNS)
    with pytest.raises(ValueError, match="duplicate column"):
        c.align_contract(base_row(spark).select("*", F.col("card1")), COLUMNS)
    assert c.schema_difference(["a", "b"], ["b", "c"]) == (["c"], ["a"])


def test_verdict_order(spark):
    data = [("invalid", "1", "1"), ("7", "-1", "1"), ("8", "1", "-1"), ("1.5", "500", None), ("9", "1", None), ("10", "inf", "1"),
            ("11", "1", "abc"), ("-4", "1", "1"), (None, "1", "1"), ("12", "1", "inf"), ("13.0", "3", "1")]
    found = {r["TransactionID"]: r["error_message"] for r in rows(c.validate_rows(spark.createDataFrame(data, TEXT)))}
    assert found == {
        "invalid": c.FINITE_ID_TEXT, "7": c.TIME_TEXT, "8": c.AMOUNT_TEXT, "1.5": c.POSITIVE_ID_TEXT, "9": None, "10": c.TIME_TEXT,
        "11": None, "-4": c.POSITIVE_ID_TEXT, None: c.FINITE_ID_TEXT, "12": c.AMOUNT_TEXT, "13.0": None}


def test_cutoff_and_unknown_column(spark):
    df = spark.createDataFrame([("5", "100", "1"), ("6", "100", "1"), ("7", "100", "1")], TEXT)
    late = {r["TransactionID"]: r["error_message"] for r in rows(c.validate_rows(df, cutoff=(100.0, 6)))}
    assert late == {"5": c.OVERLAP_TEXT, "6": c.OVERLAP_TEXT, "7": None}
    odd = df.union(df.limit(1)).withColumn("surprise", F.lit(1))
    codes = [r["error_code"] for r in rows(c.validate_rows(odd, contract=COLUMNS), "TransactionID")]
    assert codes == [c.DUPLICATE_CODE, c.DUPLICATE_CODE, c.INVALID_CODE, c.INVALID_CODE]


def test_quarantine_of_a_batch(spark):
    df = spark.createDataFrame([(0, 100, 500, 25.0, 1), (1, 101, 501, 30.0, 0), (2, 101, 502, 40.0, 1)],
                               "ordinal int, TransactionID long, TransactionDT long, TransactionAmt double, isFraud int")
    valid, invalid = c.quarantine_split(df, ordinal="ordinal")
    assert [r["TransactionID"] for r in rows(valid)] == [100]
    bad = rows(invalid, "row_number")
    assert [(r["row_number"], r["error_code"]) for r in bad] == [(3, c.DUPLICATE_CODE), (4, c.DUPLICATE_CODE)]
    assert bad[0]["input_payload"] == '{"TransactionID":101,"TransactionDT":501,"TransactionAmt":30.0}'


def test_fractional_id_is_echoed(spark):
    df = spark.createDataFrame([(0, 1.5, 500.0)], "ordinal int, TransactionID double, TransactionDT double")
    bad = rows(c.quarantine_split(df, ordinal="ordinal")[1])[0]
    assert bad["error_code"] == c.INVALID_CODE and bad["transaction_id"] == "1.5"


def test_csv_missing_spellings(spark, tmp_path):
    (tmp_path / "in.csv").write_text("TransactionID,TransactionAmt,P_emaildomain\n1,NaN,a.com\n2,N/A,null\n3,7.5,\n4,x,None\n")
    from riskspark.schema import contract_schema
    found = rows(readers.scan_csv(spark, str(tmp_path / "in.csv"), contract_schema(["TransactionID", "TransactionAmt", "P_emaildomain"])), "TransactionID")
    assert [(r["TransactionAmt"], r["P_emaildomain"]) for r in found] == [(None, "a.com"), (None, None), (7.5, None), (None, None)]


def test_identity_sample_join(spark):
    tx = spark.createDataFrame([(20, 2, 50.0), (21, 1, 75.0)], "TransactionID long, TransactionDT long, TransactionAmt double")
    identity = c.normalize_names(spark.createDataFrame([(20, 3.5), (99, 1.0)], "TransactionID long, `id-01` double"))
    joined = rows(joins.join_identity(tx, joins.semi_join_ids(identity, tx)), "TransactionDT")
    assert [(r["TransactionID"], r["id_01"], r["has_identity"]) for r in joined] == [(21, None, 0), (20, 3.5, 1)]
    with pytest.raises(ValueError, match="must be unique"):
        joins.join_identity(tx.union(tx), identity)


def test_lookup_errors(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "TransactionID long")
    assert readers.require_single(df, 1) == {"TransactionID": 1}
    with pytest.raises(LookupError):
        readers.require_single(df, 5)
    with pytest.raises(ValueError):
        readers.require_single(df, 2)
    with pytest.raises(ValueError):
        readers.keyset_batch(df, after_sequence=0, limit=101)


def test_payload_has_no_nulls_infinities_or_label(spark):
    df = spark.createDataFrame([(1, float("inf"), None, 1)], "TransactionID long, TransactionAmt double, addr1 double, isFraud int")
    clean = c.finite_only(c.nan_to_null(df))
    assert rows(clean.select(c.encode_payload(clean.columns).alias("p")))[0]["p"] == '{"TransactionID":1}'


def test_duplicate_rows_are_exact(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (2, "a"), (1, "a"), (1, None)], "x int, y string")
    assert c.duplicate_row_count(df).first()["duplicate_rows"] == 3
    assert c.duplicate_row_count(df.limit(0)).first()["duplicate_rows"] == 0


def test_safe_ids(spark):
    texts = ["100", "100.0", "100.5", "007", "+5", " 1", "-3", "0", "-0", "1e3", "99999999999999999999", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["i"] for r in rows(df.select(c.safe_id_parse("t").alias("i")))] == [100, 100, None, None, None, None, -3, 0, None, None, None, None]


def test_masking(spark):
    df = spark.createDataFrame([("card1", "1234567"), ("card1", "1234"), ("note", "x" * 40), ("note", "short"), ("id_30", "abcdef")], "k string, v string")
    shown = [r["m"] for r in rows(df.select(c.mask_value(F.col("k"), F.col("v")).alias("m")))]
    assert shown == ["••••4567", "••••", "x" * 29 + "…", "short", "••••cdef"]


def test_unusable_columns(spark):
    df = spark.createDataFrame([(1, 5, None, 1, "a"), (2, 5, None, None, "b")], "TransactionID long, same int, empty int, half int, text string")
    assert [f.columns for f in c.drop_unusable([df], df)] == [["TransactionID", "half", "text"]]


def test_upsert_latest(spark):
    base = spark.createDataFrame([(1, "old"), (2, "keep")], "k int, v string")
    new = spark.createDataFrame([(1, "mid", 1), (1, "new", 2), (3, None, 1)], "k int, v string, t int")
    assert rows(sinks.upsert_latest(base, new, ["k"], F.col("t")), "k") == [{"k": 1, "v": "new"}, {"k": 2, "v": "keep"}, {"k": 3, "v": None}]


def test_key_audit(spark):
    parent = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    child = spark.createDataFrame([(1,), (3,), (3,), (None,)], "k long")
    found = {(r["table_name"], r["rule"]): r["violations"] for r in c.key_audit({"p": parent, "c": child}, {"p": ["k"], "c": ["k"]}, [("c", "p", ["k"])]).collect()}
    assert found == {("p", "unique k"): 1, ("c", "unique k"): 1, ("c", "k in p"): 2}
    assert c.orphan_rows(child.limit(0), parent, ["k"]).first()["orphans"] == 0
