"""Joins, profiles, rates, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, rounded, r, txn_sql
from riskspark.operators import contract, joins, ordering, profiling, sampling
from riskspark.sources.demo_tables import identities, table, transactions, txn

# --- joins ----------------------------------------------------------------------------


@query("join_identity_left", txn_sql("""
select t.TransactionID, TransactionAmt, ProductCD, DeviceType, DeviceInfo, id_30, cast(i.TransactionID is not null as int) as has_identity
from transactions t left join identities i using (TransactionID)"""))
def _join_identity(spark, sf_dir):
    base = transactions(spark, sf_dir).select("TransactionID", "TransactionAmt", "ProductCD")
    return joins.join_identity(base, identities(spark, sf_dir))


@query("has_identity_join", txn_sql("""
select doc_id as TransactionID, cast(l.doc_id is not null as int) as has_identity from documents d left join labels l using (doc_id)""".replace(
    "select doc_id", "select d.doc_id")))
def _has_identity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("TransactionID"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("TransactionID"))
    return joins.join_identity(docs, labels)


@query("join_key_uniqueness", """
select 'lineitem' as side, count(*) filter (where n > 1) as repeated_keys, cast(sum(n) as bigint) as rows
from (select l_orderkey, l_linenumber, count(*) as n from lineitem group by all)
union all select 'orders', count(*) filter (where n > 1), cast(sum(n) as bigint) from (select o_orderkey, count(*) as n from orders group by all)""")
def _unique(spark, sf_dir):
    lines = contract.unique_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    orders = contract.unique_violations(table(spark, sf_dir, "orders"), ["o_orderkey"])
    return lines.select(F.lit("lineitem").alias("side"), "*").unionByName(orders.select(F.lit("orders").alias("side"), "*"))


@query("semi_join_ids", txn_sql("select * from identities where TransactionID in (select TransactionID from txn where isFraud = 1)"))
def _semi(spark, sf_dir):
    return joins.semi_join_ids(identities(spark, sf_dir), txn(spark, sf_dir).where("isFraud = 1"))


@query("anti_join_new_pairs", txn_sql("""
select distinct card1, addr1 from txn t where TransactionDT >= 86400 * 16 and addr1 is not null
  and not exists (select 1 from txn o where o.TransactionDT < 86400 * 16 and o.card1 = t.card1 and o.addr1 = t.addr1)"""))
def _anti(spark, sf_dir):
    rows = txn(spark, sf_dir).where("addr1 is not null")
    return joins.new_pairs(rows.where("TransactionDT >= 86400 * 16"), rows.where("TransactionDT < 86400 * 16"), ["card1", "addr1"])


@query("join_predictions_agree", txn_sql("select TransactionID, isFraud, probability as first_model, probability_b as second_model, false as label_mismatch from txn"))
def _agree(spark, sf_dir):
    rows = txn(spark, sf_dir)
    second = rows.select("TransactionID", "isFraud", F.col("probability_b").alias("probability"))
    return joins.join_predictions(rows, second, ("first_model", "second_model"))


@query("join_ground_truth", """
select d.doc_id, d.source, cast(l.toxic as boolean) as actual_label from documents d left join labels l using (doc_id)""")
def _truth(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("is_fraud"))
    return joins.join_ground_truth(table(spark, sf_dir, "documents").select("doc_id", "source"), labels, "doc_id")


@query("score_parity", txn_sql("""
select count(*) as rows_compared, round(max(abs(delta)), 12) + 0.0 as max_abs_delta, bool_and(abs(delta) <= 1e-7 + 1e-5 * abs(probability)) as scores_match,
  true as labels_match, cast(0 as bigint) as unmatched_rows from shifted""",
  "shifted as (select probability, (probability + case when k = 50 then 1e-4 else 1e-9 end) - probability as delta from txn)"))
def _parity(spark, sf_dir):
    stored = txn(spark, sf_dir).select("TransactionID", "isFraud", "probability", "k")
    fresh = stored.withColumn("probability", F.col("probability") + F.when(F.col("k") == 50, 1e-4).otherwise(1e-9))
    return joins.score_parity(fresh, stored).withColumn("max_abs_delta", rounded(F.col("max_abs_delta"), 12))


# --- profiles -------------------------------------------------------------------------

PROFILE = ["TransactionID", "TransactionAmt", "ProductCD", "addr1", "D1", "P_emaildomain", "DeviceType", "id_31", "always_null"]
WIDE = "wide as (select TransactionID, TransactionAmt, ProductCD, addr1, D1, P_emaildomain, DeviceType, id_31, cast(null as double) as always_null from txn)"
SUMMARY = "summary as (" + " union all ".join(
    f"select '{c}' as \"column\", count(*) as rows, count(*) - count({c}) as missing, count(distinct {c}) as distinct_values from wide" for c in PROFILE) + ")"
TYPES = dict(zip(PROFILE, ["bigint", "double", "string", "double", "double", "string", "string", "string", "double"]))
DTYPE = "case \"column\" " + " ".join(f"when '{c}' then '{t}'" for c, t in TYPES.items()) + " end"


def wide(spark, sf_dir):
    return txn(spark, sf_dir).withColumn("always_null", F.lit(None).cast("double")).select(*PROFILE)


@query("profile_table", txn_sql(f"""
select 'txn' as name, max(rows) as rows, 9 as columns, 5 as numeric, 4 as categorical, cast(0 as bigint) as duplicate_rows,
  count(*) filter (where missing = rows) as all_missing, count(*) filter (where distinct_values <= 1) as constant,
  cast(sum(missing) as bigint) as missing_cells, {r('avg(missing / rows)', 'missing_rate')} from summary""", WIDE, SUMMARY))
def _profile(spark, sf_dir):
    return profiling.profile_table(wide(spark, sf_dir), "txn").withColumn("missing_rate", rounded(F.col("missing_rate")))


@query("profile_missing", txn_sql(f"""
select "column", {r('missing / rows * 100', 'missing_pct')}, {DTYPE} as dtype, distinct_values as unique_values
from summary where missing > 0 order by missing / rows desc, "column" limit 25""", WIDE, SUMMARY))
def _missing(spark, sf_dir):
    return profiling.profile_missing(wide(spark, sf_dir)).withColumn("missing_pct", rounded(F.col("missing_pct")))


@query("profile_cardinality", txn_sql(f"""
select "column", distinct_values as unique_values, {r('missing / rows * 100', 'missing_pct')} from summary
where "column" in ('ProductCD', 'P_emaildomain', 'DeviceType', 'id_31')""", WIDE, SUMMARY))
def _cardinality(spark, sf_dir):
    return profiling.profile_cardinality(wide(spark, sf_dir)).withColumn("missing_pct", rounded(F.col("missing_pct")))


def rate_sql(key, name):
    return txn_sql(f"select {key} as {name}, count(isFraud) as count, cast(sum(isFraud) as bigint) as sum, {r('avg(isFraud)', 'mean')} from txn group by 1")


@query("rate_by_category", rate_sql("ProductCD", "ProductCD"))
def _by_category(spark, sf_dir):
    return profiling.rate_by(txn(spark, sf_dir), "ProductCD", "ProductCD").withColumn("mean", rounded(F.col("mean")))


@query("rate_by_identity", rate_sql("cast(DeviceType is not null as int)", "has_identity"))
def _by_identity(spark, sf_dir):
    joined = joins.join_identity(transactions(spark, sf_dir), identities(spark, sf_dir), validate=False)
    return profiling.rate_by(joined, "has_identity", "has_identity").withColumn("mean", rounded(F.col("mean")))


@query("rate_by_day", txn_sql(f"select cast(TransactionDT // 86400 as int) as day, count(isFraud) as count, {r('avg(isFraud)', 'mean')} from txn group by 1"))
def _by_day(spark, sf_dir):
    return profiling.rate_by_day(txn(spark, sf_dir)).withColumn("mean", rounded(F.col("mean")))


@query("amount_by_label", txn_sql(f"""
select isFraud, count(TransactionAmt) as count, {r('avg(TransactionAmt)', 'mean')}, min(TransactionAmt) as min, max(TransactionAmt) as max,
  {r('median(TransactionAmt)', 'median')} from txn group by 1"""))
def _amounts(spark, sf_dir):
    return profiling.amount_by_label(txn(spark, sf_dir)).withColumns({c: rounded(F.col(c)) for c in ("mean", "median")})


@query("class_balance", txn_sql(f"""
select label, rows, {r('rows / total', 'share')}, {r('n0 / n1', 'ratio')} from (
  select isFraud as label, count(*) as rows, sum(count(*)) over () as total,
    sum(count(*)) filter (where isFraud = 0) over () as n0, sum(count(*)) filter (where isFraud = 1) over () as n1 from txn group by isFraud)"""))
def _balance(spark, sf_dir):
    return profiling.class_balance(txn(spark, sf_dir)).withColumns({c: rounded(F.col(c)) for c in ("share", "ratio")})


@query("positive_weight", txn_sql(f"""
select mode, {r("case mode when 'none' then 1.0 when 'balanced' then ratio else sqrt(ratio) end", 'weight')}
from (select count(*) filter (where isFraud = 0) / count(*) filter (where isFraud = 1) as ratio from txn), (values ('none'), ('balanced'), ('sqrt_balanced')) m(mode)"""))
def _weight(spark, sf_dir):
    return profiling.positive_weights(txn(spark, sf_dir)).withColumn("weight", rounded(F.col("weight")))


CORR = ["TransactionID", "TransactionDT", "TransactionAmt", "card1", "card2", "addr1", "addr2", "D1", "D2", "D4", "D10", "D15", "k"]


@query("corr_screen", txn_sql("select * from (" + " union all ".join(
    f"select '{c}' as feature, {r(f'abs(corr({c}, isFraud))', 'abs_corr')} from txn" for c in CORR) + ") order by abs_corr desc limit 20"))
def _corr(spark, sf_dir):
    return profiling.corr_screen(txn(spark, sf_dir).select(*CORR, "isFraud")).withColumn("abs_corr", rounded(F.col("abs_corr")))


DICTIONARY = ["TransactionID", "ProductCD", "P_emaildomain", "DeviceInfo", "id_31", "D1", "always_null"]


def dictionary_sql():
    parts = []
    for c in DICTIONARY:
        group, description = profiling.describe_column(c)
        parts.append(f"""select '{c}' as "column", '{group}' as "group", '{TYPES.get(c, 'string')}' as dtype, {r(f'(count(*) - count({c})) / count(*)', 'missing_share')},
          count(distinct {c}) as distinct_values, coalesce((select string_agg(substr(replace(v, '|', '/'), 1, 45), ', ' order by v) from
            (select distinct cast({c} as varchar) as v from src where {c} is not null order by v limit 5)), 'No non-null values') as examples,
          '{description}' as description from src""")
    return txn_sql(" union all ".join(parts), "src as (select *, cast(null as double) as always_null from txn)")


@query("data_dictionary", dictionary_sql())
def _dictionary(spark, sf_dir):
    df = txn(spark, sf_dir).withColumn("always_null", F.lit(None).cast("double")).select(*DICTIONARY)
    return profiling.data_dictionary(df).withColumn("missing_share", rounded(F.col("missing_share")))


AUDIT = {"TransactionID": "row_identifier", "TransactionAmt": "numeric", "ProductCD": "categorical", "card1": "identifier_code",
         "addr1": "identifier_code", "D1": "numeric", "P_emaildomain": "categorical", "id_31": "categorical", "isFraud": "target"}
AUDIT_TYPES = {"TransactionID": "bigint", "TransactionAmt": "double", "ProductCD": "string", "card1": "bigint", "addr1": "double",
               "D1": "double", "P_emaildomain": "string", "id_31": "string", "isFraud": "int"}


def audit_sql():
    parts = " union all ".join(
        f"select '{c}' as feature, '{AUDIT_TYPES[c]}' as dtype, '{role}' as role, round((count(*) - count({c})) / count(*) * 100, 4) + 0.0 as missing_percent_train, count(distinct {c}) as n from train"
        for c, role in AUDIT.items())
    cat = "role in ('identifier_code', 'categorical')"

    def rule(small, large, number, name):
        return f"""case when role in ('target', 'row_identifier') then 'exclude from model input' when {cat} and n <= 100 then '{small}'
          when {cat} then '{large}' else '{number}' end as {name}"""

    scaled, kept = "median impute, missing indicator, standardize", "numeric; preserve NaN; no scaling"
    return txn_sql(f"""select feature, dtype, role, missing_percent_train, n as unique_non_null_train,
      case when not {cat} then 'not_applicable' when n <= 20 then 'low' when n <= 100 then 'medium' when n <= 1000 then 'high' else 'very_high' end as cardinality_band,
      {rule('one-hot with rare grouping', 'frequency encode', scaled, 'logistic_regression')}, {rule('native category', 'frequency encode', kept, 'lightgbm')},
      {rule('native categorical string', 'native categorical string', kept, 'catboost')},
      {rule('training vocabulary plus embedding', 'training vocabulary plus embedding', scaled, 'neural_network')} from ({parts})""",
      "train as (select * from txn where TransactionDT < 86400 * 22)")


@query("feature_audit", audit_sql())
def _audit(spark, sf_dir):
    train = txn(spark, sf_dir).where("TransactionDT < 86400 * 22").select(*AUDIT)
    return profiling.feature_audit(train).withColumn("missing_percent_train", F.col("missing_percent_train") + F.lit(0.0))


@query("infer_feature_groups", txn_sql(" union all ".join(
    f"select '{c}' as feature, case when count(distinct {c}) <= 100 then 'low_cardinality' else 'high_cardinality' end as \"group\" from txn"
    for c in ["card1", "card2", "addr1", "ProductCD", "P_emaildomain", "id_31"]) + " union all select unnest(['TransactionAmt', 'D1', 'D15']), 'numeric'"))
def _groups(spark, sf_dir):
    df = txn(spark, sf_dir).select("TransactionID", "TransactionAmt", "ProductCD", "card1", "card2", "addr1", "D1", "D15", "P_emaildomain", "id_31", "isFraud")
    return profiling.feature_groups(df)


SPLIT_SQL = """
ranked as (select *, row_number() over (order by TransactionDT, TransactionID) - 1 as rn, count(*) over () as n from txn),
split as (select *, case when rn < cast(floor(n * 0.7::double) as bigint) then 'train'
  when rn < cast(floor(n * (0.7::double + 0.15::double)) as bigint) then 'validation' else 'test' end as split from ranked)"""


@query("split_chronological", txn_sql("select TransactionID, split from split", SPLIT_SQL))
def _split(spark, sf_dir):
    return sampling.split_chronological(txn(spark, sf_dir)).select("TransactionID", "split")


@query("split_summary", txn_sql(f"""
select split, count(*) as rows, cast(sum(isFraud) as bigint) as fraud_count, {r('avg(isFraud)', 'fraud_rate')},
  cast(min(TransactionDT) as double) as transaction_dt_min, cast(max(TransactionDT) as double) as transaction_dt_max from split group by split""", SPLIT_SQL))
def _split_summary(spark, sf_dir):
    return sampling.split_summary(sampling.split_chronological(txn(spark, sf_dir))).withColumn("fraud_rate", rounded(F.col("fraud_rate")))


@query("split_expanding_folds", txn_sql("""
select TransactionID, fold, case when rn < a then 'train' else 'validation' end as role from (
  select TransactionID, rn, fold, cast(floor(n * lo / 0.85::double) as bigint) as a, cast(floor(n * hi / 0.85::double) as bigint) as b
  from ranked, (values (1, 0.45::double, 0.55::double), (2, 0.60::double, 0.70::double), (3, 0.70::double, 0.85::double)) f(fold, lo, hi)) where rn < b""", SPLIT_SQL))
def _folds(spark, sf_dir):
    return sampling.split_expanding_folds(txn(spark, sf_dir).select("TransactionID", "TransactionDT")).select("TransactionID", "fold", "role")


def quota_sql(rows, debug):
    share = f"{rows} * (count(*) / (select count(*) from txn))" if not debug else f"{rows} * count(*) / (select count(*) from txn)"
    quota = f"greatest(1, cast(round_even({share}, 0) as bigint))" if debug else (
        f"case when isFraud = 0 then cast(round_even({share}, 0) as bigint) else {rows} - (select cast(round_even({rows} * (count(*) filter (where isFraud = 0) / count(*)), 0) as bigint) from txn) end")
    return txn_sql(f"""select TransactionID, isFraud from (
      select TransactionID, isFraud, row_number() over (partition by isFraud order by md5('42:' || TransactionID), TransactionID) as rn from txn)
      join (select isFraud, {quota} as quota from txn group by isFraud) using (isFraud) where rn <= quota""")


@query("sample_stratified", quota_sql(777, False))
def _stratified(spark, sf_dir):
    return sampling.sample_stratified(txn(spark, sf_dir), 777).select("TransactionID", "isFraud")


@query("sample_debug", quota_sql(301, True))
def _debug(spark, sf_dir):
    return sampling.sample_debug(txn(spark, sf_dir), 301).select("TransactionID", "isFraud")


@query("earliest_n", txn_sql("select TransactionID, TransactionDT, TransactionAmt from txn order by TransactionDT, TransactionID limit 250"))
def _earliest(spark, sf_dir):
    return sampling.earliest_n(txn(spark, sf_dir), 250).select("TransactionID", "TransactionDT", "TransactionAmt")


@query("sequence_number", txn_sql("select TransactionID, row_number() over (order by TransactionDT, TransactionID) - 1 as sequence_number from txn"))
def _sequence(spark, sf_dir):
    return ordering.sequence_numbers(txn(spark, sf_dir).select("TransactionID", "TransactionDT")).select("TransactionID", "sequence_number")


@query("fifo_check", txn_sql("""
select count(*) filter (where pt is not null and (pt, pi) > (TransactionDT, TransactionID)) as order_violations, count(*) filter (where ps >= seq) as sequence_violations
from (select *, lag(TransactionDT) over w as pt, lag(TransactionID) over w as pi, lag(seq) over w as ps from seqs window w as (order by seq, TransactionDT, TransactionID))""",
  "seqs as (select TransactionDT, TransactionID, TransactionID // 2 + k % 3 as seq from txn)"))
def _fifo(spark, sf_dir):
    rows = txn(spark, sf_dir).select("TransactionID", "TransactionDT", (F.floor(F.col("TransactionID") / 2) + F.col("k") % 3).alias("seq"))
    return ordering.fifo_violations(rows, "seq")


@query("dataset_summary", txn_sql(f"""
select count(*) as row_count, arg_min(TransactionID, (TransactionDT, TransactionID)) as first_transaction_id, arg_max(TransactionID, (TransactionDT, TransactionID)) as last_transaction_id,
  cast(sum(isFraud) as bigint) as fraud_count, {r('avg(isFraud)', 'fraud_rate')}, cast(8 as bigint) as distinct_payload_fields from txn"""))
def _summary(spark, sf_dir):
    fields = ["TransactionID", "TransactionDT", "TransactionAmt", "ProductCD", "addr1", "P_emaildomain", "DeviceInfo", "id_31"]
    df = txn(spark, sf_dir).withColumn("payload", contract.encode_payload(fields))
    return profiling.dataset_summary(df, "payload").withColumn("fraud_rate", rounded(F.col("fraud_rate")))


@query("union_history", txn_sql("select split, TransactionID, TransactionDT, card1 from split where split in ('train', 'validation')", SPLIT_SQL))
def _union_history(spark, sf_dir):
    rows = sampling.split_chronological(txn(spark, sf_dir).select("TransactionID", "TransactionDT", "card1"))
    return rows.where("split = 'train'").unionByName(rows.where("split = 'validation'"))
