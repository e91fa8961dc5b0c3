"""Frozen behavioural state, guards and the leakage audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.history_checks import AMOUNT_KEYS, D_UNITS, DISTINCT, KEYED, KEYS, comparable, mean_sql, std_sql
from checks.registry import query, rounded, r, txn_sql
from riskspark.functions import stats
from riskspark.functions.row_features import with_v2_row_features
from riskspark.operators import history
from riskspark.operators import reference_state as ref
from riskspark.operators.bucketed_state import BucketedState
from riskspark.session import scratch_path, write_through
from riskspark.sources.demo_tables import txn

CUT = 86_400 * 20
NEXT = 86_400 * 26


def before(cut=CUT):
    return f"base as (select * from keyed where TransactionDT < {cut})"


def state_cte(key):
    amount = key in AMOUNT_KEYS
    parts = [f"{key} as k", "count(*) as n", "cast(max(TransactionDT) as double) as last"]
    if amount:
        parts += ["count(amt_u) as an", "coalesce(sum(amt_u), 0) as as_", "coalesce(sum(amt_u * amt_u), 0) as aq"]
    if key == "uid_proxy":
        for name, u in D_UNITS.items():
            parts += [f"count({u}) as n_{u}", f"coalesce(sum({u}), 0) as s_{u}", f"coalesce(sum({u} * {u}), 0) as q_{u}"]
        parts += [f"count(distinct coalesce({e}, 'MISSING')) as d_{c}" for c, e in DISTINCT.items()]
    return f"st_{key} as (select {', '.join(parts)} from base group by 1)"


def state_rows():
    """All keyed tables as one long table."""
    out = []
    for key in KEYS:
        amount, uid = key in AMOUNT_KEYS, key == "uid_proxy"
        out.append(f"""select '{key}' as kind, k as key, n, last,
          {'an' if amount else 'cast(null as bigint)'} as amount_n,
          {r(mean_sql('an', 'as_', '1000'), 'amount_mean') if amount else 'cast(null as double) as amount_mean'},
          {r(std_sql('an', 'as_', 'aq', '1000'), 'amount_std') if amount else 'cast(null as double) as amount_std'},
          {'d_DeviceInfo' if uid else 'cast(null as bigint)'} as devices from st_{key}""")
    return " union all ".join(out)


def long_state(state):
    rows = None
    for spec in state.specs:
        table = state.keyed[spec.key]
        p = f"{spec.key}_amount"
        null = F.lit(None)
        n, s, q = (F.col(f"{p}__{x}") for x in "nsq")
        one = table.select(
            F.lit(spec.key).alias("kind"), "key", "n", "last",
            (n if spec.amounts else null.cast("bigint")).alias("amount_n"),
            (rounded(stats.mean(n, s, 1000)) if spec.amounts else null.cast("double")).alias("amount_mean"),
            (rounded(stats.population_std(n, s, q, 1000)) if spec.amounts else null.cast("double")).alias("amount_std"),
            (F.col("DeviceInfo__d") if spec.distinct else null.cast("bigint")).alias("devices"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("ref_build", txn_sql(state_rows(), KEYED, before(), *map(state_cte, KEYS)))
def _build(spark, sf_dir):
    return long_state(ref.build(txn(spark, sf_dir).where(f"TransactionDT < {CUT}")))


@query("ref_membership", txn_sql(" union all ".join(
    f"select distinct '{c}' as \"column\", uid_proxy as key, coalesce({e}, 'MISSING') as value from base" for c, e in DISTINCT.items()), KEYED, before()))
def _membership(spark, sf_dir):
    rows = with_v2_row_features(txn(spark, sf_dir).where(f"TransactionDT < {CUT}"))
    return ref.membership(rows, history.KEY_HISTORIES)


def apply_sql():
    out, joins = ["t.TransactionID"], []
    for key in KEYS:
        a = f"st_{key}"
        joins.append(f"left join {a} on {a}.k = t.{key}")
        out += [f"coalesce({a}.n, 0) as {key}_prior_count", f"t.TransactionDT - {a}.last as {key}_seconds_since_previous"]
        if key in AMOUNT_KEYS:
            m, d = f"({mean_sql(f'{a}.an', f'{a}.as_', 1000)})", f"({std_sql(f'{a}.an', f'{a}.as_', f'{a}.aq', 1000)})"
            p = f"{key}_amount"
            out += [f"coalesce({a}.an, 0) as {p}_prior_numeric_count", r(m, f"{p}_prior_mean"), r(d, f"{p}_prior_std"),
                    r(f"TransactionAmt - {m}", f"{p}_difference"), r(f"TransactionAmt / nullif({m}, 0)", f"{p}_ratio"),
                    r(f"(TransactionAmt - {m}) / nullif({d}, 0)", f"{p}_zscore")]
        if key == "uid_proxy":
            for name, u in D_UNITS.items():
                out += [f"coalesce({a}.n_{u}, 0) as uid_proxy_{name}_prior_numeric_count",
                        r(mean_sql(f"{a}.n_{u}", f"{a}.s_{u}", 86400), f"uid_proxy_{name}_prior_mean"),
                        r(std_sql(f"{a}.n_{u}", f"{a}.s_{u}", f"{a}.q_{u}", 86400), f"uid_proxy_{name}_prior_std")]
            out += [f"coalesce({a}.d_{c}, 0) as uid_proxy_{c}_prior_nunique" for c in DISTINCT]
    return txn_sql(f"select {', '.join(out)} from keyed t {' '.join(joins)} where TransactionDT >= {CUT}", KEYED, before(), *map(state_cte, KEYS))


APPLY_SQL = apply_sql()


@query("ref_apply", APPLY_SQL)
def _apply(spark, sf_dir):
    rows = txn(spark, sf_dir)
    state = ref.build(rows.where(f"TransactionDT < {CUT}"))
    return comparable(ref.apply(rows.where(f"TransactionDT >= {CUT}"), state))


@query("join_reference_lookup", txn_sql(f"""
select t.TransactionID, coalesce(n, 0) as card1_key_prior_count, t.TransactionDT - last as card1_key_seconds_since_previous
from keyed t left join st_card1_key on st_card1_key.k = t.card1_key where TransactionDT >= {CUT}""", KEYED, before(), state_cte("card1_key")))
def _lookup(spark, sf_dir):
    rows = txn(spark, sf_dir)
    state = ref.build(rows.where(f"TransactionDT < {CUT}"), [history.KeyHistory("card1_key")])
    found = ref.apply(rows.where(f"TransactionDT >= {CUT}"), state)
    return found.select("TransactionID", "card1_key_prior_count", "card1_key_seconds_since_previous")


MERGE_SQL = txn_sql(state_rows(), KEYED, before(NEXT), *map(state_cte, KEYS))


@query("ref_merge", MERGE_SQL)
def _merge(spark, sf_dir):
    rows = txn(spark, sf_dir)
    state = ref.build(rows.where(f"TransactionDT < {CUT}"))
    return long_state(ref.merge(state, rows.where(f"TransactionDT >= {CUT} and TransactionDT < {NEXT}")))


@query("ref_merge_buckets", MERGE_SQL)
def _merge_buckets(spark, sf_dir):
    """Two later batches enter bucketed state, the second by a compaction of the buckets that they touch."""
    rows = txn(spark, sf_dir)
    state = ref.build(rows.where(f"TransactionDT < {CUT}"))
    store = BucketedState(spark, scratch_path(spark, "buckets"), state.specs, compact_every=1)
    store.create(state)
    ends = [CUT, CUT + 3 * 86_400, NEXT]
    for batch, (low, high) in enumerate(zip(ends, ends[1:])):
        store.merge(batch, rows.where(f"TransactionDT >= {low} and TransactionDT < {high}"))
    return long_state(store.whole(len(ends) - 1))


@query("ref_cutoff_guard", txn_sql(f"""
select count(*) as rows, count(*) filter (where (e.dt, e.id) >= (t.TransactionDT, t.TransactionID)) as overlapping_rows, true as state_usable
from txn t, (select max(TransactionDT) as dt, arg_max(TransactionID, (TransactionDT, TransactionID)) as id from txn where TransactionDT < {CUT}) e where t.TransactionDT >= {CUT - 86400}"""))
def _guard(spark, sf_dir):
    rows = txn(spark, sf_dir)
    state = ref.build(rows.where(f"TransactionDT < {CUT}"), [history.KeyHistory("card1_key")])
    return ref.cutoff_violations(rows.where(f"TransactionDT >= {CUT - 86400}"), state.meta)


CONTROL = (86_400 * 3, 86_400 * 4)  # the day that the control takes away
FIRST_GONE = [f"""gone_{k} as (select {k} as k, min((TransactionDT, TransactionID)) as at from keyed where TransactionDT >= {CONTROL[0]} and TransactionDT < {CONTROL[1]} group by 1)""" for k in KEYS]


@query("leakage_audit", txn_sql(f"""
select 'past_features_changed' as "check", 0::bigint as violations union all select 'keys_without_first_row', 0::bigint
union all
select 'control_rows_changed', count(*) from keyed t {' '.join(f'left join gone_{k} on gone_{k}.k = t.{k}' for k in KEYS)}
where TransactionDT < {86_400 * 29} and ((TransactionDT >= {CONTROL[0]} and TransactionDT < {CONTROL[1]}) or {' or '.join(f'coalesce(gone_{k}.at < (t.TransactionDT, t.TransactionID), false)' for k in KEYS)})""", KEYED, *FIRST_GONE))
def _leakage(spark, sf_dir):
    """Flip every label and raise every amount of the last two days; earlier rows must not move.

    As a control a whole day is taken away: exactly its rows and the later ones that share a key with it must differ.
    """
    rows = write_through(txn(spark, sf_dir), "audited")
    changed = rows.withColumn("isFraud", 1 - F.col("isFraud")).withColumn(
        "TransactionAmt", F.when(F.col("TransactionDT") >= 86_400 * 29, F.col("TransactionAmt") * 1000).otherwise(F.col("TransactionAmt")))
    upto = F.col("TransactionDT") < 86_400 * 29
    less = rows.where((F.col("TransactionDT") < CONTROL[0]) | (F.col("TransactionDT") >= CONTROL[1]))
    kept = write_through(history.past_digests(rows, upto), "audit-before")
    control = history.leakage_audit(rows, less, upto, before=kept).where(F.col("check") == "past_features_changed")
    return history.leakage_audit(rows, changed, upto, before=kept).unionByName(control.withColumn("check", F.lit("control_rows_changed")))
