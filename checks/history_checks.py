"""Behavioural history, frozen state and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, rounded, r, txn_sql
from riskspark.functions.row_features import with_v2_row_features
from riskspark.operators import history, ordering
from riskspark.sources.demo_tables import txn

KEYED = """
keyed as (
  select *, TransactionDT / 86400.0::double as day,
    coalesce(cast(card1 as varchar), 'MISSING') as card1_key,
    coalesce(cast(card1 as varchar), 'MISSING') || '__' || coalesce(cast(addr1 as varchar), 'MISSING') as card_address_key,
    coalesce(cast(card1 as varchar), 'MISSING') || '__' || coalesce(cast(addr1 as varchar), 'MISSING') || '__' ||
      coalesce(cast(cast(round_even(TransactionDT / 86400.0::double - D1, 0) as bigint) as varchar), 'MISSING') as uid_proxy,
    coalesce(DeviceType, 'MISSING') || '__' || coalesce(DeviceInfo, 'MISSING') as device_key,
    cast(round_even(TransactionAmt * 1000, 0) as hugeint) as amt_u,
    cast(round_even((TransactionDT / 86400.0::double - D4) * 86400, 0) as hugeint) as d4_u,
    cast(round_even((TransactionDT / 86400.0::double - D10) * 86400, 0) as hugeint) as d10_u,
    cast(round_even((TransactionDT / 86400.0::double - D15) * 86400, 0) as hugeint) as d15_u,
    round_even((TransactionAmt - floor(TransactionAmt)) * 100, 0) as cents
  from txn
)
"""
KEYS = ["uid_proxy", "card_address_key", "card1_key", "device_key"]
AMOUNT_KEYS = KEYS[:2]
D_UNITS = {"D4_normalized": "d4_u", "D10_normalized": "d10_u", "D15_normalized": "d15_u"}
DISTINCT = {"P_emaildomain": "P_emaildomain", "DeviceInfo": "DeviceInfo", "transaction_amount_cents": "cast(cents as varchar)"}


def past(key: str) -> str:
    return f"(partition by {key} order by TransactionDT, TransactionID rows between unbounded preceding and 1 preceding)"


def whole(key: str) -> str:
    return f"(partition by {key} order by TransactionDT, TransactionID)"


def mean_sql(n: str, s: str, per: int) -> str:
    return f"case when {n} > 0 then cast({s} as double) / cast({n} as double) / {per} end"


def std_sql(n: str, s: str, q: str, per: int) -> str:
    spread = f"cast(cast({n} as hugeint) * {q} - cast({s} as hugeint) * cast({s} as hugeint) as double)"
    return f"case when {n} >= 2 then sqrt(greatest({spread}, 0.0)) / cast({n} as double) / {per} end"


def sums_cte(key: str, unit: str, name: str, source: str = "keyed") -> str:
    return f"""
{name} as (
  select *, count({unit}) over {past(key)} as n_, coalesce(sum({unit}) over {past(key)}, 0) as s_,
    coalesce(sum({unit} * {unit}) over {past(key)}, 0) as q_
  from {source}
)"""


def features(spark, sf_dir, hot_rows=ordering.CHUNK_ROWS, specs=None):
    return history.history_features(with_v2_row_features(txn(spark, sf_dir)), specs, hot_rows=hot_rows)


def one_key(key: str, **kinds) -> list[history.KeyHistory]:
    return [history.KeyHistory(key, **kinds)]


@query("hist_prior_count", txn_sql("select TransactionID, " + ", ".join(
    f"row_number() over {whole(k)} - 1 as {k}_prior_count" for k in KEYS) + " from keyed", KEYED))
def _prior_count(spark, sf_dir):
    specs = [history.KeyHistory(k) for k in KEYS]
    return features(spark, sf_dir, specs=specs).select("TransactionID", *[f"{k}_prior_count" for k in KEYS])


@query("hist_seconds_since_previous", txn_sql("select TransactionID, " + ", ".join(
    f"cast(TransactionDT - lag(TransactionDT) over {whole(k)} as double) as {k}_seconds_since_previous" for k in KEYS
) + " from keyed", KEYED))
def _seconds(spark, sf_dir):
    specs = [history.KeyHistory(k) for k in KEYS]
    return features(spark, sf_dir, specs=specs).select("TransactionID", *[f"{k}_seconds_since_previous" for k in KEYS])


def amount_sql(columns: list[str]) -> str:
    select = [f"a.TransactionID"]
    for alias, key in zip("ab", AMOUNT_KEYS):
        n, s, q = (f"{alias}.{p}_" for p in "nsq")
        m, d = f"({mean_sql(n, s, 1000)})", f"({std_sql(n, s, q, 1000)})"
        forms = {
            "prior_numeric_count": f"{n} as {key}_amount_prior_numeric_count",
            "prior_mean": r(m, f"{key}_amount_prior_mean"),
            "prior_std": r(d, f"{key}_amount_prior_std"),
            "difference": r(f"a.TransactionAmt - {m}", f"{key}_amount_difference"),
            "ratio": r(f"a.TransactionAmt / nullif({m}, 0)", f"{key}_amount_ratio"),
            "zscore": r(f"(a.TransactionAmt - {m}) / nullif({d}, 0)", f"{key}_amount_zscore"),
        }
        select += [forms[c] for c in columns]
    return txn_sql(
        f"select {', '.join(select)} from a join b using (TransactionID)",
        KEYED, sums_cte("uid_proxy", "amt_u", "a"), sums_cte("card_address_key", "amt_u", "b"),
    )


AMOUNT_SPECS = [history.KeyHistory(k, amounts=True) for k in AMOUNT_KEYS]


@query("hist_prior_numeric_stats", amount_sql(["prior_numeric_count", "prior_mean", "prior_std"]))
def _numeric(spark, sf_dir):
    return features(spark, sf_dir, specs=AMOUNT_SPECS).select(
        "TransactionID", *[f"{k}_amount_prior_numeric_count" for k in AMOUNT_KEYS],
        *[rounded(f"{k}_amount_{c}") for k in AMOUNT_KEYS for c in ("prior_mean", "prior_std")],
    )


@query("hist_amount_deviation", amount_sql(["difference", "ratio", "zscore"]))
def _deviation(spark, sf_dir):
    return features(spark, sf_dir, specs=AMOUNT_SPECS).select(
        "TransactionID", *[rounded(f"{k}_amount_{c}") for k in AMOUNT_KEYS for c in ("difference", "ratio", "zscore")]
    )


def d_stats_sql() -> str:
    ctes, select, joins = [KEYED], ["d0.TransactionID"], []
    for i, (name, unit) in enumerate(D_UNITS.items()):
        ctes.append(sums_cte("uid_proxy", unit, f"d{i}"))
        n, s, q = (f"d{i}.{p}_" for p in "nsq")
        select += [f"{n} as uid_proxy_{name}_prior_numeric_count",
                   r(mean_sql(n, s, 86400), f"uid_proxy_{name}_prior_mean"),
                   r(std_sql(n, s, q, 86400), f"uid_proxy_{name}_prior_std")]
        joins.append(f"d{i}" if i == 0 else f"join d{i} using (TransactionID)")
    return txn_sql(f"select {', '.join(select)} from {' '.join(joins)}", *ctes)


@query("hist_d_stats", d_stats_sql())
def _d_stats(spark, sf_dir):
    specs = one_key("uid_proxy", days=tuple(D_UNITS))
    return features(spark, sf_dir, specs=specs).select(
        "TransactionID", *[f"uid_proxy_{d}_prior_numeric_count" for d in D_UNITS],
        *[rounded(f"uid_proxy_{d}_{c}") for d in D_UNITS for c in ("prior_mean", "prior_std")],
    )


FRESH = f"""
fresh as (
  select *, {", ".join(f"cast(row_number() over (partition by uid_proxy, coalesce({e}, 'MISSING') order by TransactionDT, TransactionID) = 1 as int) as new_{c}" for c, e in DISTINCT.items())}
  from keyed
)"""


@query("hist_prior_nunique", txn_sql("select TransactionID, " + ", ".join(
    f"cast(coalesce(sum(new_{c}) over {past('uid_proxy')}, 0) as bigint) as uid_proxy_{c}_prior_nunique" for c in DISTINCT
) + " from fresh", KEYED, FRESH))
def _nunique(spark, sf_dir):
    return features(spark, sf_dir, specs=one_key("uid_proxy", distinct=tuple(DISTINCT))).select(
        "TransactionID", *[f"uid_proxy_{c}_prior_nunique" for c in DISTINCT]
    )


def causal_sql() -> str:
    """All past-only features in one statement."""
    parts = []
    for k in KEYS:
        parts += [f"row_number() over {whole(k)} - 1 as {k}_prior_count",
                  f"cast(TransactionDT - lag(TransactionDT) over {whole(k)} as double) as {k}_seconds_since_previous"]
    units = [("uid_proxy", "amt_u", "uid_proxy_amount", 1000), ("card_address_key", "amt_u", "card_address_key_amount", 1000)]
    units += [("uid_proxy", u, f"uid_proxy_{d}", 86400) for d, u in D_UNITS.items()]
    for key, unit, prefix, _ in units:
        parts += [f"count({unit}) over {past(key)} as {prefix}_n", f"coalesce(sum({unit}) over {past(key)}, 0) as {prefix}_s",
                  f"coalesce(sum({unit} * {unit}) over {past(key)}, 0) as {prefix}_q"]
    parts += [f"cast(coalesce(sum(new_{c}) over {past('uid_proxy')}, 0) as bigint) as uid_proxy_{c}_prior_nunique" for c in DISTINCT]
    raw = f"raw as (select TransactionID, TransactionAmt, {', '.join(parts)} from fresh)"
    out = ["TransactionID", *[f"{k}_{c}" for k in KEYS for c in ("prior_count", "seconds_since_previous")],
           *[f"uid_proxy_{c}_prior_nunique" for c in DISTINCT]]
    for key, unit, prefix, per in units:
        n, s, q = f"{prefix}_n", f"{prefix}_s", f"{prefix}_q"
        m, d = f"({mean_sql(n, s, per)})", f"({std_sql(n, s, q, per)})"
        out += [f"{n} as {prefix}_prior_numeric_count", r(m, f"{prefix}_prior_mean"), r(d, f"{prefix}_prior_std")]
        if unit == "amt_u":
            out += [r(f"TransactionAmt - {m}", f"{prefix}_difference"), r(f"TransactionAmt / nullif({m}, 0)", f"{prefix}_ratio"),
                    r(f"(TransactionAmt - {m}) / nullif({d}, 0)", f"{prefix}_zscore")]
    return txn_sql(f"select {', '.join(out)} from raw", KEYED, FRESH, raw)


CAUSAL_SQL = causal_sql()
ALL_FEATURES = {n for spec in history.KEY_HISTORIES for n in history.spec_features(spec)}


def comparable(df):
    """The causal features in the form the SQL returns them."""
    names = [c for c in df.columns if c in ALL_FEATURES]
    exact = ("_prior_count", "_seconds_since_previous", "_numeric_count", "_nunique")
    return df.select("TransactionID", *[F.col(n) if n.endswith(exact) else rounded(n) for n in names])


@query("hist_causal_features", CAUSAL_SQL)
def _causal(spark, sf_dir):
    return comparable(features(spark, sf_dir))


@query("hist_causal_features_hot_keys", CAUSAL_SQL)
def _causal_chunked(spark, sf_dir):
    """Hot keys (above 400 rows) are cut into chunks, and the features join the wide rows."""
    return comparable(history.causal_features(txn(spark, sf_dir), hot_rows=400))
