"""Frozen behavioural state: build, look up, merge, guard.

State is four keyed tables of additive integer sums, the distinct (key, value) pairs
behind the distinct counts, and one row of metadata. Sums merge exactly in any order.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.row_features import number, with_v2_row_features
from riskspark.operators.history import KEY_HISTORIES, ROW, KeyHistory, derived_features, distinct_text, source_columns, sum_columns
from riskspark.operators.joins import new_pairs
from riskspark.schema import ID, TIME
from riskspark.session import scratch_path, single_row, write_through

PAIR = ["column", "key", "value"]

# Contract written with the state.
STATE_VERSION = "2.0"
HISTORY_RULE = "strictly_earlier_transactions_only"


@dataclass
class ReferenceState:
    keyed: dict[str, DataFrame]
    pairs: DataFrame
    meta: DataFrame
    specs: list[KeyHistory]


def _sum_names(spec: KeyHistory) -> list[str]:
    return list(sum_columns(spec))


def _key_sums(rows: DataFrame, spec: KeyHistory) -> DataFrame:
    return rows.groupBy(F.col(spec.key).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.max(number(TIME)).alias("last"),
        *[F.sum(measure).alias(name) for name, measure in sum_columns(spec).items()],
    )


def membership(rows: DataFrame, specs: list[KeyHistory]) -> DataFrame:
    """Distinct (column, key, value) of all tracked columns."""
    tracked = [(s.key, c) for s in specs for c in s.distinct]
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(k).alias("key"), distinct_text(c).alias("value")) for k, c in tracked
    ])).alias("p")
    return rows.select(pairs).select("p.*").distinct()


def fresh_pairs(rows: DataFrame, specs: list[KeyHistory], known_pairs: DataFrame | None) -> DataFrame | None:
    """Pairs of rows with row-level features that are not known yet, with the time and id of their first event, as a written table."""
    tracked = [(s.key, c) for s in specs for c in s.distinct]
    if not tracked:
        return None
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(k).alias("key"), distinct_text(c).alias("value")) for k, c in tracked
    ])).alias("p")
    found = rows.select(pairs, TIME, ID).select("p.*", F.struct(TIME, ID).alias("e")).groupBy(*PAIR).agg(F.min("e").alias("e"))
    if known_pairs is not None:
        found = found.join(known_pairs.select(*PAIR), PAIR, "left_anti")
    return write_through(found.select(*PAIR, "e.*"), "state-pairs")


def _pair_counts(pairs: DataFrame, spec: KeyHistory) -> DataFrame:
    """key and one count per tracked column."""
    mine = pairs.where(F.col("column").isin(list(spec.distinct)))
    return mine.groupBy("key").agg(*[F.count_if(F.col("column") == c).alias(f"{c}__d") for c in spec.distinct])


def _metadata(rows: DataFrame) -> DataFrame:
    last = F.max(F.struct(number(TIME).alias("t"), F.col(ID).cast("long").alias("i")))
    return rows.agg(last.alias("_e"), F.count(F.lit(1)).alias("history_row_count")).select(
        F.lit(STATE_VERSION).alias("version"), F.lit(HISTORY_RULE).alias("history_rule"), F.lit(False).alias("uses_target"),
        F.col("_e.t").alias("history_end_transaction_dt"), F.col("_e.i").alias("history_end_transaction_id"), "history_row_count",
    )


def frozen(state: ReferenceState) -> ReferenceState:
    """The state as written tables, so that lookups are planned from their real sizes."""
    path = scratch_path(state.meta.sparkSession, "state")
    save(state, path)
    return load(state.meta.sparkSession, path, state.specs)


def build(df: DataFrame, specs: list[KeyHistory] | None = None) -> ReferenceState:
    """State of all rows in ``df``; the label is never read."""
    if df.isEmpty():
        raise ValueError("there are no rows to build state from: history cannot be empty")
    columns = with_v2_row_features(df).columns
    return frozen(delta(df, [s.present(columns) for s in specs or KEY_HISTORIES], None))


def apply(df: DataFrame, state: ReferenceState) -> DataFrame:
    """Past-only features of new rows from frozen state; absent keys count zero.

    Four left joins on unique keys: small state is broadcast, large state is shuffled and AQE splits the skewed side. Only
    the keys, time and amount go through them; the wide rows are written once with a number and meet their features again by it.
    """
    rows = write_through(with_v2_row_features(df).withColumn(ROW, F.monotonically_increasing_id()), "lookup-rows")
    looked = rows.select(ROW, *source_columns([KeyHistory(s.key) for s in state.specs], rows.columns))
    features = []
    for spec in state.specs:
        names = ["n", "last", *_sum_names(spec), *[f"{c}__d" for c in spec.distinct]]
        table = state.keyed[spec.key].select(F.col("key").alias(spec.key), *[F.col(n).alias(f"_s_{n}") for n in names])
        value_of = {n: F.coalesce(F.col(f"_s_{n}"), F.lit(0)) for n in names}
        value_of["last"] = F.col("_s_last")
        derived = derived_features(spec, value_of)
        features += derived
        looked = looked.join(table, spec.key, "left").withColumns(derived).drop(*[f"_s_{n}" for n in names])
    return rows.join(looked.select(ROW, *features), ROW).drop(ROW)


def cutoff_violations(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows at or before the end of history, and whether the state is usable at all."""
    end = meta.select(
        F.struct(F.col("history_end_transaction_dt").alias("t"), F.col("history_end_transaction_id").alias("i")).alias("_end"),
        (~F.coalesce("uses_target", F.lit(True))).alias("_free"),
    )
    here = F.struct(number(TIME).alias("t"), F.col(ID).cast("long").alias("i"))
    return df.select(here.alias("_row"), single_row(end).alias("_m")).select("_row", "_m.*").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_end") >= F.col("_row")).alias("overlapping_rows"),
        F.coalesce(F.bool_and(F.col("_free") & F.col("_end.t").isNotNull() & F.col("_end.i").isNotNull()), F.lit(False)).alias("state_usable"),
    )


def require_after_cutoff(df: DataFrame, meta: DataFrame) -> None:
    found = cutoff_violations(df, meta).first()  # one row
    if not found["state_usable"]:
        raise ValueError("this state has no end of history or no target exclusion, so it can't be applied")
    if found["overlapping_rows"]:
        raise ValueError("the stored history overlaps the rows to score")


def delta(
    df: DataFrame, specs: list[KeyHistory], known_pairs: DataFrame | None, *, reuse: bool = True, fresh: DataFrame | None = None
) -> ReferenceState:
    """State of new rows alone, with only the pairs that are not known yet; ``fresh`` is ``fresh_pairs`` if the caller has it.

    Four keyed tables, the pairs and the metadata read the rows, so the few columns they
    need are written once; pass ``reuse=False`` when ``df`` is a written table already.
    """
    rows = with_v2_row_features(df)
    rows = rows.select(*source_columns(specs, rows.columns))
    if reuse:
        rows = write_through(rows, "state-source")
    tracked = any(s.distinct for s in specs)
    if tracked and fresh is not None:
        fresh = fresh.select(*PAIR)
    elif tracked:
        fresh = membership(rows, specs)
        if known_pairs is not None:
            fresh = new_pairs(fresh, known_pairs, PAIR)
        fresh = write_through(fresh, "state-pairs")  # read by the counts and as pairs
    else:
        fresh = None
    keyed = {}
    for spec in specs:
        table = _key_sums(rows, spec)
        keyed[spec.key] = table.join(_pair_counts(fresh, spec), "key", "left") if spec.distinct else table
    return ReferenceState(keyed, fresh, _metadata(rows), specs)


def stacked(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def combined_meta(metas: list[DataFrame]) -> DataFrame:
    """Latest end of history and total of rows; parts that read the label or follow another version stay apart."""
    end = F.max(F.struct("history_end_transaction_dt", "history_end_transaction_id"))
    meta = stacked(metas).groupBy("version", "history_rule", "uses_target").agg(end.alias("_e"), F.sum("history_row_count").alias("history_row_count"))
    return meta.select("version", "history_rule", "uses_target", "_e.*", "history_row_count")


def combine(states: list[ReferenceState]) -> ReferenceState:
    """Add up disjoint states: sums per key, union of pairs, latest end of history."""
    first = states[0]

    keyed = {}
    for spec in first.specs:
        tables = [s.keyed[spec.key] for s in states]
        old = tables[0]
        sums = [F.sum(n).cast(old.schema[n].dataType).alias(n) for n in ["n", *_sum_names(spec)]]
        sums += [F.coalesce(F.sum(f"{c}__d"), F.lit(0)).alias(f"{c}__d") for c in spec.distinct]
        keyed[spec.key] = stacked(tables).groupBy("key").agg(F.max("last").alias("last"), *sums).select(*old.columns)
    meta = combined_meta([s.meta for s in states])
    pairs = stacked([s.pairs for s in states]) if first.pairs is not None else None
    return ReferenceState(keyed, pairs, meta, first.specs)


def merge(state: ReferenceState, df: DataFrame, *, check: bool = True) -> ReferenceState:
    """Fold later rows into the state by adding partial sums per key."""
    if check:
        require_after_cutoff(df, state.meta)
    return combine([state, delta(df, state.specs, state.pairs)])


def save(state: ReferenceState, path: str) -> None:
    for key, table in state.keyed.items():
        table.write.mode("overwrite").parquet(f"{path}/key={key}")
    if state.pairs is not None:
        state.pairs.write.mode("overwrite").parquet(f"{path}/pairs")
    state.meta.write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str, specs: list[KeyHistory]) -> ReferenceState:
    keyed = {s.key: spark.read.parquet(f"{path}/key={s.key}") for s in specs}
    pairs = spark.read.parquet(f"{path}/pairs") if any(s.distinct for s in specs) else None
    return ReferenceState(keyed, pairs, spark.read.parquet(f"{path}/meta"), specs)


