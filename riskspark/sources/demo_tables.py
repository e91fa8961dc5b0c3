"""Transaction-shaped views over the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_START = 1_704_067_200  # 2024-01-01, first day of the event table
DAY = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction side: one row per event, label included, no identity columns."""
    events = table(spark, sf_dir, "events")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("card1"), F.lower("c_mktsegment").alias("segment")
    )
    k = F.get_json_object("props", "$.k").cast("int")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    base = events.select(
        (F.col("event_id") + 1).alias("TransactionID"),
        (seconds - EPOCH_START + DAY).cast("bigint").alias("TransactionDT"),
        F.col("value").alias("TransactionAmt"),
        F.col("event_type").alias("ProductCD"),
        F.col("user_id").alias("card1"),
        (F.col("user_id") % 7).alias("card2"),
        k.alias("k"),
    )
    day = F.floor(F.col("TransactionDT") / DAY)

    def sometimes(divisor: int, remainder: int, value):
        return F.when(F.col("k") % divisor != remainder, value.cast("double"))

    wide = base.select(
        "*",
        sometimes(9, 0, F.col("k") % 5).alias("addr1"),
        sometimes(11, 0, F.col("k") % 3).alias("addr2"),
        sometimes(13, 0, day + F.col("card1") % 3).alias("D1"),
        sometimes(13, 1, F.col("k") % 21).alias("D2"),
        sometimes(13, 2, F.col("k") % 22).alias("D4"),
        sometimes(13, 3, F.col("k") % 23).alias("D10"),
        sometimes(13, 4, F.col("k") % 24).alias("D15"),
        F.when((F.col("ProductCD") == "error") & (F.col("k") >= 80), 1).otherwise(0).alias("isFraud"),
    )
    return wide.join(customers, "card1", "left").select(
        "TransactionID", "TransactionDT", "TransactionAmt", "ProductCD", "card1", "card2",
        "addr1", "addr2", "D1", "D2", "D4", "D10", "D15",
        F.when(F.col("k") % 6 != 0, F.col("segment")).alias("P_emaildomain"),
        "isFraud", "k",
    )


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity side: finished orders, keyed by the transaction id."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("TransactionID"),
        F.col("o_orderstatus").alias("DeviceType"),
        F.col("o_orderpriority").alias("DeviceInfo"),
        F.col("o_orderpriority").alias("id_30"),
    )


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined view used by most queries, with two synthetic model scores."""
    joined = transactions(spark, sf_dir).join(
        identities(spark, sf_dir).withColumn("_found", F.lit(True)), "TransactionID", "left"
    )
    k, user = F.col("k"), F.col("card1")
    return joined.select(
        "TransactionID", "TransactionDT", "TransactionAmt", "ProductCD", "card1", "card2",
        "addr1", "addr2", "D1", "D2", "D4", "D10", "D15", "P_emaildomain",
        "DeviceType", "DeviceInfo", "id_30",
        F.when(F.col("_found"), F.concat_ws(" ", "ProductCD", k.cast("string"))).alias("id_31"),
        "isFraud",
        (((k * 37 + user * 11) % 1000) / F.lit(1000.0)).alias("probability"),
        (((k * 53 + user * 29) % 997) / F.lit(997.0)).alias("probability_b"),
        "k",
    )


# The same views for DuckDB, used by the SQL side of the checks.
TXN_SQL = """
ev as (
  select event_id + 1 as TransactionID,
    cast(floor(epoch_us(ts) / 1000000.0) as bigint) - 1704067200 + 86400 as TransactionDT,
    value as TransactionAmt, event_type as ProductCD, user_id as card1, user_id % 7 as card2,
    cast(json_extract_string(props, '$.k') as int) as k
  from events
),
transactions as (
  select TransactionID, TransactionDT, TransactionAmt, ProductCD, card1, card2,
    case when k % 9 <> 0 then cast(k % 5 as double) end as addr1,
    case when k % 11 <> 0 then cast(k % 3 as double) end as addr2,
    case when k % 13 <> 0 then cast(TransactionDT // 86400 + card1 % 3 as double) end as D1,
    case when k % 13 <> 1 then cast(k % 21 as double) end as D2,
    case when k % 13 <> 2 then cast(k % 22 as double) end as D4,
    case when k % 13 <> 3 then cast(k % 23 as double) end as D10,
    case when k % 13 <> 4 then cast(k % 24 as double) end as D15,
    case when k % 6 <> 0 then lower(c_mktsegment) end as P_emaildomain,
    case when ProductCD = 'error' and k >= 80 then 1 else 0 end as isFraud, k
  from ev left join customer on c_custkey = card1
),
identities as (
  select o_orderkey as TransactionID, o_orderstatus as DeviceType,
    o_orderpriority as DeviceInfo, o_orderpriority as id_30
  from orders where o_orderstatus = 'F'
),
txn as (
  select t.TransactionID, TransactionDT, TransactionAmt, ProductCD, card1, card2, addr1, addr2,
    D1, D2, D4, D10, D15, P_emaildomain, DeviceType, DeviceInfo, id_30,
    case when i.TransactionID is not null then ProductCD || ' ' || k end as id_31, isFraud,
    ((k * 37 + card1 * 11) % 1000) / 1000.0::double as probability,
    ((k * 53 + card1 * 29) % 997) / 997.0::double as probability_b, k
  from transactions t left join identities i on i.TransactionID = t.TransactionID
)
"""
