"""Row features, contract, scans and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, rounded, r, txn_sql
from riskspark.functions import row_features as rf
from riskspark.operators import contract, ordering
from riskspark.schema import contract_schema
from riskspark.session import scratch_path
from riskspark.sources import keyed_table, readers, sinks
from riskspark.sources.demo_tables import identities, table, transactions, txn

SOURCE = ["TransactionID", "TransactionDT", "TransactionAmt", "ProductCD", "card1", "card2", "addr1", "addr2",
          "D1", "D2", "D4", "D10", "D15", "P_emaildomain", "DeviceType", "DeviceInfo", "id_30", "id_31"]


def raw(spark, sf_dir):
    """Contract columns of the adapter view, without label and helper columns."""
    return txn(spark, sf_dir).select(*SOURCE)


def nulls(names):
    return " + ".join(f"cast({n} is null as int)" for n in names) or "0"


@query("feat_num_missing", txn_sql(f"select TransactionID, {nulls(SOURCE[1:])} as num_missing from txn"))
def _num_missing(spark, sf_dir):
    df = raw(spark, sf_dir)
    return df.select("TransactionID", rf.num_missing(df.columns).alias("num_missing"))


@query("feat_family_missing", txn_sql(f"""
select TransactionID, {nulls(['TransactionAmt', 'ProductCD'])} as transaction_missing,
  {nulls(['card1', 'card2', 'addr1', 'addr2'])} as card_address_missing,
  {nulls(['DeviceType', 'DeviceInfo', 'id_30', 'id_31'])} as identity_missing from txn"""))
def _family(spark, sf_dir):
    df = raw(spark, sf_dir)
    return df.select("TransactionID", *[v.alias(n) for n, v in rf.family_missing(df.columns).items()])


@query("feat_amount", txn_sql(f"""
select TransactionID, {r('ln(1 + greatest(TransactionAmt, 0))', 'transaction_amount_log1p')},
  round_even((TransactionAmt - floor(TransactionAmt)) * 100, 0) as transaction_amount_cents from txn"""))
def _amount(spark, sf_dir):
    v = rf.amount_features()
    return raw(spark, sf_dir).select("TransactionID", rounded(v["transaction_amount_log1p"]).alias("transaction_amount_log1p"),
                                     v["transaction_amount_cents"].alias("transaction_amount_cents"))


@query("feat_relative_time", txn_sql("""
select TransactionID, cast(TransactionDT // 86400 as double) as transaction_relative_day,
  cast(TransactionDT // 604800 as double) as transaction_relative_week,
  cast((TransactionDT % 86400) // 3600 as double) as transaction_relative_hour_phase from txn"""))
def _time(spark, sf_dir):
    return raw(spark, sf_dir).select("TransactionID", *[v.alias(n) for n, v in rf.relative_time_features().items()])


def text(c):
    return f"coalesce(cast({c} as varchar), 'MISSING')"


@query("feat_pair_keys", txn_sql(f"""
select TransactionID, {text('card1')} || '__' || {text('card2')} as card_1_2,
  {text('addr1')} || '__' || {text('addr2')} as address_1_2,
  {text('P_emaildomain')} || '__MISSING' as email_pair from txn"""))
def _pairs(spark, sf_dir):
    df = raw(spark, sf_dir)
    return df.select("TransactionID", *[v.alias(n) for n, v in rf.pair_keys(df.columns).items()])


@query("feat_cyclic_time", txn_sql(f"""
select TransactionID, {r('TransactionDT / 86400.0::double', 'transaction_day_continuous')},
  {r('sin(2 * pi() * (TransactionDT / 86400.0::double) / 7)', 'transaction_week_sin')},
  {r('cos(2 * pi() * (TransactionDT / 86400.0::double) / 7)', 'transaction_week_cos')},
  {r('sin(2 * pi() * ((TransactionDT % 86400) / 3600.0::double) / 24)', 'transaction_hour_sin')},
  {r('cos(2 * pi() * ((TransactionDT % 86400) / 3600.0::double) / 24)', 'transaction_hour_cos')} from txn"""))
def _cyclic(spark, sf_dir):
    return raw(spark, sf_dir).select("TransactionID", *[rounded(v).alias(n) for n, v in rf.cyclic_time_features().items()])


D = ["D1", "D2", "D4", "D10", "D15"]


@query("feat_d_normalized", txn_sql("select TransactionID, " + ", ".join(
    r(f"TransactionDT / 86400.0::double - {d}", f"{d}_normalized") for d in D) + " from txn"))
def _d(spark, sf_dir):
    df = raw(spark, sf_dir)
    return df.select("TransactionID", *[rounded(v).alias(n) for n, v in rf.normalized_d(df.columns).items()])


@query("feat_amount_dollars", txn_sql("select TransactionID, floor(TransactionAmt) as transaction_amount_dollars from txn"))
def _dollars(spark, sf_dir):
    return raw(spark, sf_dir).select("TransactionID", *[v.alias(n) for n, v in rf.amount_dollars().items()])


@query("feat_entity_keys", txn_sql(f"""
select TransactionID, {text('card1')} as card1_key, {text('card1')} || '__' || {text('addr1')} as card_address_key,
  {text('card1')} || '__' || {text('addr1')} || '__' || {text('P_emaildomain')} as card_address_email_key,
  {text('DeviceType')} || '__' || {text('DeviceInfo')} as device_key from txn"""))
def _entity(spark, sf_dir):
    df = raw(spark, sf_dir)
    return df.select("TransactionID", *[v.alias(n) for n, v in rf.entity_keys(df.columns).items()])


@query("feat_uid_proxy", txn_sql(f"""
select TransactionID, {text('card1')} || '__' || {text('addr1')} || '__' ||
  coalesce(cast(cast(round_even(TransactionDT / 86400.0::double - D1, 0) as bigint) as varchar), 'MISSING') as uid_proxy from txn"""))
def _uid(spark, sf_dir):
    df = raw(spark, sf_dir)
    return df.select("TransactionID", rf.uid_proxy(df.columns).alias("uid_proxy"))


def family_sql(c):
    return f"coalesce(nullif(regexp_extract(trim(lower(coalesce({c}, 'MISSING'))), '^([a-z][a-z0-9_+.-]*)', 1), ''), 'MISSING')"


@query("feat_agent_family", txn_sql(f"""
select TransactionID, {family_sql('id_30')} as operating_system_family, {family_sql('id_31')} as browser_family from txn"""))
def _agent(spark, sf_dir):
    return raw(spark, sf_dir).select("TransactionID", rf.agent_family("id_30").alias("operating_system_family"),
                                     rf.agent_family("id_31").alias("browser_family"))


# --- contract -------------------------------------------------------------------------


@query("normalize_names", 'with t as (select o_orderkey as TransactionID, o_totalprice as id_01, o_orderpriority as id_30 from orders) select * from t')
def _names(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("TransactionID"), F.col("o_totalprice").alias("id-01"), F.col("o_orderpriority").alias("id-30"))
    return contract.normalize_names(orders)


SMALL_CONTRACT = ["TransactionID", "TransactionDT", "TransactionAmt", "card1", "card2", "dist1", "R_emaildomain", "DeviceInfo"]


@query("align_contract", txn_sql("""
select TransactionID, cast(TransactionDT as double) as TransactionDT, TransactionAmt, card1, cast(card2 as double) as card2,
  cast(null as double) as dist1, cast(null as varchar) as R_emaildomain, DeviceInfo from txn"""))
def _align(spark, sf_dir):
    df = txn(spark, sf_dir).select("card2", "DeviceInfo", "TransactionID", "card1", "isFraud", "TransactionAmt", "TransactionDT")
    return contract.align_contract(df, SMALL_CONTRACT)


def dirty(spark, sf_dir):
    """Text rows as an uploaded file holds them: repeated ids, fractions, bad numbers."""
    df = txn(spark, sf_dir)
    k, i = F.col("k"), F.col("TransactionID")
    ident = (
        F.when(k == 3, "bad").when(k == 5, F.concat(i.cast("string"), F.lit(".5"))).when(k == 7, (-i).cast("string"))
        .when(k == 11, "inf").when(k == 13, (i - i % 2 + 1).cast("string")).when(k == 15, F.concat(i.cast("string"), F.lit(".0")))
        .otherwise(i.cast("string"))
    )
    return df.select(
        (i - 1).alias("ordinal"), ident.alias("TransactionID"),
        F.when(k == 17, "nan").when(k == 19, "-5").otherwise(F.col("TransactionDT").cast("string")).alias("TransactionDT"),
        F.when(k == 23, "-1").when(k == 29, "abc").when(k == 31, "inf").otherwise(F.col("TransactionAmt").cast("string")).alias("TransactionAmt"),
        "ProductCD", "isFraud",
    )


DIRTY = """
dirty as (
  select TransactionID - 1 as ordinal,
    case when k = 3 then 'bad' when k = 5 then TransactionID || '.5' when k = 7 then cast(-TransactionID as varchar)
      when k = 11 then 'inf' when k = 13 then cast(TransactionID - TransactionID % 2 + 1 as varchar)
      when k = 15 then TransactionID || '.0' else cast(TransactionID as varchar) end as TransactionID,
    case when k = 17 then 'nan' when k = 19 then '-5' else cast(TransactionDT as varchar) end as TransactionDT,
    case when k = 23 then '-1' when k = 29 then 'abc' when k = 31 then 'inf' else cast(TransactionAmt as varchar) end as TransactionAmt,
    ProductCD, isFraud
  from txn
)"""
JUDGED = """
numbers as (
  select *, try_cast(TransactionID as double) as i, try_cast(TransactionDT as double) as t, try_cast(TransactionAmt as double) as a,
    count(*) over (partition by coalesce(cast(try_cast(TransactionID as double) as varchar), TransactionID)) as copies from dirty
),
judged as (
  select *, case when copies > 1 then 'TransactionID is duplicated in the uploaded CSV'
    when i is null or not isfinite(i) then 'TransactionID must be a finite integer'
    when i <= 0 or i % 1 <> 0 then 'TransactionID must be a positive integer'
    when t is null or not isfinite(t) or t < 0 then 'TransactionDT must be a finite non-negative number'
    when a is not null and not isnan(a) and (not isfinite(a) or a < 0) then 'TransactionAmt must be a finite non-negative number'
    when (86400.0 * 2, 500.0) >= (t, i) then 'Behavioral reference overlaps the transaction being scored' end as error_message
  from numbers
),
verdict as (select *, case when error_message is null then null when copies > 1 then 'duplicate_transaction_id'
  else 'invalid_prediction_input' end as error_code from judged)"""
CUTOFF = (86_400.0 * 2, 500)


@query("coerce_numeric", txn_sql("""
select ordinal, case when isnan(try_cast(TransactionDT as double)) then null else try_cast(TransactionDT as double) end as TransactionDT,
  try_cast(TransactionAmt as double) as TransactionAmt from dirty""", DIRTY))
def _coerce(spark, sf_dir):
    return contract.coerce_numeric(dirty(spark, sf_dir), ["TransactionDT", "TransactionAmt"]).select(
        "ordinal", "TransactionDT", "TransactionAmt")


@query("validate_rows", txn_sql("select ordinal, TransactionID, error_code, error_message from verdict", DIRTY, JUDGED))
def _validate(spark, sf_dir):
    return contract.validate_rows(dirty(spark, sf_dir), cutoff=CUTOFF).select("ordinal", "TransactionID", "error_code", "error_message")


@query("quarantine_split", txn_sql("""
select 'invalid' as part, ordinal + 2 as row_number, TransactionID as transaction_id, error_code, error_message as message, ProductCD as payload_product, 4 as payload_fields
from verdict where error_code is not null
union all select 'valid', ordinal + 2, TransactionID, null, null, ProductCD, 4 from verdict where error_code is null""", DIRTY, JUDGED))
def _quarantine(spark, sf_dir):
    valid, invalid = contract.quarantine_split(dirty(spark, sf_dir), ordinal="ordinal", cutoff=CUTOFF)
    bad = invalid.select(
        F.lit("invalid").alias("part"), "row_number", "transaction_id", "error_code", "message",
        F.get_json_object("input_payload", "$.ProductCD").alias("payload_product"),
        F.size(F.json_object_keys("input_payload")).alias("payload_fields"))
    good = valid.select(
        F.lit("valid").alias("part"), (F.col("ordinal") + 2).alias("row_number"), F.col("TransactionID").alias("transaction_id"),
        F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("message"),
        F.col("ProductCD").alias("payload_product"), F.lit(4).alias("payload_fields"))
    return bad.unionByName(good)


@query("duplicate_flag", txn_sql("select ordinal, copies > 1 as is_duplicate from numbers", DIRTY, JUDGED))
def _duplicates(spark, sf_dir):
    return contract.duplicate_flag(dirty(spark, sf_dir)).select("ordinal", "is_duplicate")


@query("duplicate_row_count", """
with t as (select l_orderkey, l_linenumber, l_returnflag from lineitem)
select cast((select count(*) from t) - (select count(*) from (select distinct * from t)) as bigint) as duplicate_rows""")
def _duplicate_rows(spark, sf_dir):
    return contract.duplicate_row_count(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query("protect_columns", txn_sql("select TransactionDT, TransactionAmt, card1 from txn"))
def _protect(spark, sf_dir):
    df = contract.protect_columns(txn(spark, sf_dir).select("TransactionID", "TransactionDT", "TransactionAmt", "card1", "isFraud"))
    contract.assert_protected(df.columns)
    return df


@query("input_completeness", txn_sql(f"select TransactionID, {r('(' + str(len(SOURCE)) + ' - (' + nulls(SOURCE) + ')) / ' + str(len(SOURCE)) + '.0::double', 'input_completeness')} from txn"))
def _completeness(spark, sf_dir):
    return raw(spark, sf_dir).select("TransactionID", rounded(contract.input_completeness(SOURCE)).alias("input_completeness"))


@query("has_identity_values", txn_sql("select TransactionID, cast(DeviceType is not null or DeviceInfo is not null or id_30 is not null or id_31 is not null as int) as has_identity from txn"))
def _identity_values(spark, sf_dir):
    return raw(spark, sf_dir).select("TransactionID", contract.has_identity_values(SOURCE).alias("has_identity"))


USABLE = ["TransactionDT", "TransactionAmt", "ProductCD", "D2", "DeviceType", "id_30", "always_null", "always_one"]


@query("drop_unusable", txn_sql(" union all ".join(
    f"select '{c}' as \"column\", (count(distinct {c}) + cast(count(*) > count({c}) as int)) <= 1 as unusable from train" for c in USABLE),
    "train as (select *, cast(null as double) as always_null, 1 as always_one from txn where TransactionDT < 86400 * 22)"))
def _unusable(spark, sf_dir):
    train = txn(spark, sf_dir).where("TransactionDT < 86400 * 22").withColumns(
        {"always_null": F.lit(None).cast("double"), "always_one": F.lit(1)})
    return contract.column_usability(train.select(*USABLE))


@query("safe_id_parse", txn_sql("""
select ordinal, TransactionID as raw, case when regexp_full_match(TransactionID, '(0|-?[1-9][0-9]*)(\\.0)?')
  then try_cast(regexp_replace(TransactionID, '\\.0$', '') as bigint) end as transaction_id from dirty""", DIRTY))
def _safe_id(spark, sf_dir):
    return dirty(spark, sf_dir).select("ordinal", F.col("TransactionID").alias("raw"), contract.safe_id_parse("TransactionID").alias("transaction_id"))


MASKED = ["card1", "ProductCD", "P_emaildomain", "DeviceInfo", "id_31", "c_note"]


@query("mask_sensitive", txn_sql("""
select TransactionID, field, case when regexp_matches(lower(field), 'card|addr|email|device|id_') and length(raw) <= 4 then '••••'
  when regexp_matches(lower(field), 'card|addr|email|device|id_') then '••••' || right(raw, 4)
  when length(raw) > 32 then substr(raw, 1, 29) || '…' else raw end as value
from (""" + " union all ".join(f"select TransactionID, '{c}' as field, cast({c} as varchar) as raw from noted" for c in MASKED) + ") where raw is not null",
    "noted as (select *, ProductCD || ' at second ' || TransactionDT || ' for ' || k as c_note from txn)"))
def _mask(spark, sf_dir):
    note = F.concat(F.col("ProductCD"), F.lit(" at second "), F.col("TransactionDT").cast("string"), F.lit(" for "), F.col("k").cast("string"))
    return contract.mask_sensitive(txn(spark, sf_dir).withColumn("c_note", note), ["TransactionID"], MASKED)


# --- scans and sinks ------------------------------------------------------------------


@query("scan_csv_typed", txn_sql("select TransactionID, cast(TransactionDT as double) as TransactionDT, TransactionAmt, ProductCD, addr1, P_emaildomain from txn"))
def _csv(spark, sf_dir):
    names = ["TransactionID", "TransactionDT", "TransactionAmt", "ProductCD", "addr1", "P_emaildomain"]
    path = scratch_path(spark, "csv")
    # Missing values are written in two of the usual spellings.
    source = txn(spark, sf_dir).select(*names[:4], F.coalesce(F.col("addr1").cast("string"), F.lit("NA")).alias("addr1"),
                                       F.coalesce("P_emaildomain", F.lit("")).alias("P_emaildomain"))
    source.write.option("header", True).csv(path)
    return readers.scan_csv(spark, path, contract_schema(names))


@query("scan_parquet_pruned", txn_sql("select " + ", ".join(readers.HISTORY_COLUMNS) + " from txn"))
def _pruned(spark, sf_dir):
    path = scratch_path(spark, "wide")
    txn(spark, sf_dir).write.parquet(path)
    return readers.scan_parquet(spark, path)


@query("point_lookup", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders where o_orderkey = 4242")
def _lookup(spark, sf_dir):
    return readers.point_lookup(table(spark, sf_dir, "orders").drop("o_orderdate"), 4242, "o_orderkey")


SEQUENCED = "sequenced as (select *, row_number() over (order by TransactionDT, TransactionID) - 1 as sequence_number from txn)"


@query("paged_listing", txn_sql("""
select TransactionID as transaction_id, cast(TransactionDT as double) as transaction_dt, TransactionAmt as transaction_amount,
  ProductCD as product_code, DeviceType is not null or DeviceInfo is not null or id_30 is not null or id_31 is not null as has_identity
from sequenced where sequence_number >= 40 and sequence_number < 60""", SEQUENCED))
def _paged(spark, sf_dir):
    return readers.paged_listing(ordering.sequence_numbers(raw(spark, sf_dir)), limit=20, offset=40)


@query("keyset_batch", txn_sql("select sequence_number, TransactionID from sequenced where sequence_number > 123 order by 1 limit 100", SEQUENCED))
def _keyset(spark, sf_dir):
    rows = ordering.sequence_numbers(txn(spark, sf_dir).select("TransactionID", "TransactionDT"))
    return readers.keyset_batch(rows, after_sequence=123).select("sequence_number", "TransactionID")


@query("json_payload_encode", txn_sql(f"""
select TransactionID, {len(SOURCE)} - ({nulls(SOURCE)}) as fields, TransactionAmt as amount, addr1, id_31, true as label_free from txn"""))
def _encode(spark, sf_dir):
    df = contract.finite_only(txn(spark, sf_dir).select(*SOURCE, "isFraud"))
    payload = df.select("TransactionID", contract.encode_payload(df.columns).alias("p"))
    field = lambda name: F.get_json_object("p", f"$.{name}")
    return payload.select("TransactionID", F.size(F.json_object_keys("p")).alias("fields"), field("TransactionAmt").cast("double").alias("amount"),
                          field("addr1").cast("double").alias("addr1"), field("id_31").alias("id_31"), field("isFraud").isNull().alias("label_free"))


@query("json_payload_decode", txn_sql("select TransactionID, cast(TransactionDT as double) as TransactionDT, TransactionAmt, ProductCD, addr1, D15, id_31, cast(null as double) as dist1 from txn"))
def _decode(spark, sf_dir):
    df = txn(spark, sf_dir)
    stored = df.select(contract.encode_payload(SOURCE).alias("transaction_payload"))
    schema = contract_schema(["TransactionID", "TransactionDT", "TransactionAmt", "ProductCD", "addr1", "D15", "id_31", "dist1"])
    return readers.decode_payload(stored, schema)


UPSERT_SQL = """
with base as (select o_orderkey, o_orderstatus, o_totalprice from orders),
upd as (select l_orderkey as o_orderkey, l_linestatus as o_orderstatus, l_extendedprice as o_totalprice,
  row_number() over (partition by l_orderkey order by l_shipdate desc, l_extendedprice desc, l_linestatus desc) as rn from lineitem)
select o_orderkey, o_orderstatus, o_totalprice from base where o_orderkey not in (select o_orderkey from upd)
union all select o_orderkey, o_orderstatus, o_totalprice from upd where rn = 1"""


@query("upsert_latest", UPSERT_SQL)
def _upsert(spark, sf_dir):
    base, updates = order_updates(spark, sf_dir)
    return sinks.upsert_latest(base, updates, ["o_orderkey"], F.col("v"))


def order_updates(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem")
    # Dates and prices make one number, so that the latest line of an order is unique.
    updates = lines.select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"), F.col("l_extendedprice").alias("o_totalprice"),
        (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * 1_000_000_000 + F.rint(F.col("l_extendedprice") * 100).cast("long")).alias("v"))
    return base, updates


@query("upsert_stored", UPSERT_SQL)
def _upsert_stored(spark, sf_dir):
    """Lines up to the end of 1994 and later ones are merged one after the other into a stored table."""
    base, updates = order_updates(spark, sf_dir)
    stored = keyed_table.KeyedTable(spark, scratch_path(spark, "orders"), base.schema, ["o_orderkey"], buckets=8)
    stored.create(base)
    new_year = 788_918_400 * 1_000_000_000  # 1995 in the updates' order
    stored.merge(updates.where(F.col("v") < new_year), 1, F.col("v"))
    stored.merge(updates.where(F.col("v") >= new_year), 2, F.col("v"))
    return stored.read()


@query("lookup_stored", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey in (17, 4242, 999999999)")
def _lookup_stored(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    stored = keyed_table.KeyedTable(spark, scratch_path(spark, "orders"), rows.schema, ["o_orderkey"], buckets=8)
    stored.create(rows)
    return stored.lookup([(17,), (4242,), (999_999_999,)])


@query("keyset_stored", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey > 4242 order by 1 limit 100")
def _keyset_stored(spark, sf_dir):
    stored = keyed_table.ClusteredTable(spark, scratch_path(spark, "orders"), "o_orderkey")
    stored.write(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), files=8)
    return stored.page(4242, 100)


@query("sink_split_parquet", txn_sql("""
select split, count(*) as rows from (select case when rn < cast(floor(n * 0.7::double) as bigint) then 'train' when rn < cast(floor(n * (0.7::double + 0.15::double)) as bigint) then 'validation' else 'test' end as split
  from (select row_number() over (order by TransactionDT, TransactionID) - 1 as rn, count(*) over () as n from txn)) group by 1"""))
def _split_sink(spark, sf_dir):
    from riskspark.operators import sampling
    path = scratch_path(spark, "splits")
    rows = sampling.split_chronological(txn(spark, sf_dir))
    sinks.write_splits(rows, path, sampling.split_summary(rows))
    written = spark.read.parquet(f"{path}/rows")
    return written.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("sink_report_csv", txn_sql("""
select 'prediction_results' as file, count(*) filter (where copies = 1 and (error_message is null or error_message like 'Behavioral%')) as rows from judged
union all select 'invalid_rows', count(*) filter (where not (copies = 1 and (error_message is null or error_message like 'Behavioral%'))) from judged""", DIRTY, JUDGED))
def _report(spark, sf_dir):
    valid, invalid = contract.quarantine_split(dirty(spark, sf_dir), ordinal="ordinal")
    summary = contract.validate_rows(dirty(spark, sf_dir)).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("error_code").isNull()).alias("valid_rows"))
    path = scratch_path(spark, "report")
    sinks.write_report(valid, invalid, summary, path, ["TransactionID", "TransactionDT", "TransactionAmt", "ProductCD"])
    count = lambda name: spark.read.option("header", True).csv(f"{path}/{name}").agg(
        F.lit(name).alias("file"), F.count(F.lit(1)).alias("rows"))
    return count("prediction_results").unionByName(count("invalid_rows"))
