"""Strictly-past behavioural features per card, address, device and client key.

Every row sees only earlier rows of its key, in (time, id) order. A key that holds more
rows than one task should sort is cut into order chunks: totals of earlier chunks come
from a small aggregated table, and the window runs inside (key, chunk).
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions import stats
from riskspark.functions.row_features import number, with_v2_row_features
from riskspark.operators.ordering import CHUNK_ROWS, event_order, ordered
from riskspark.schema import AMOUNT, ID, MISSING, TIME
from riskspark.session import write_through

DIGESTS = ["_digest", "_digest_2"]
HOT_BUCKETS = 4096  # of a kind of key, so that few hold many rows by chance
ROW = "_history_row"  # number of a row in the written table; ids may repeat or be missing
PAST, MARK = "_history_past", "_history_mark"
CARRIED = 32  # columns of a row that moves through the shuffles per key as a whole


@dataclass(frozen=True)
class KeyHistory:
    """What is tracked for one key column."""

    key: str
    amounts: bool = False
    days: tuple[str, ...] = ()
    distinct: tuple[str, ...] = ()
    numeric: dict[str, tuple[str, int]] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        if self.amounts:
            self.numeric[f"{self.key}_amount"] = (AMOUNT, stats.AMOUNT_UNITS)
        for column in self.days:
            self.numeric[f"{self.key}_{column}"] = (column, stats.DAY_UNITS)

    def present(self, columns: list[str]) -> "KeyHistory":
        return KeyHistory(
            self.key, self.amounts,
            tuple(c for c in self.days if c in columns), tuple(c for c in self.distinct if c in columns),
        )


# The tracked keys and what is tracked per key.
KEY_HISTORIES = [
    KeyHistory(
        "uid_proxy", amounts=True,
        days=("D4_normalized", "D10_normalized", "D15_normalized"),
        distinct=("P_emaildomain", "DeviceInfo", "transaction_amount_cents"),
    ),
    KeyHistory("card_address_key", amounts=True),
    KeyHistory("card1_key"),
    KeyHistory("device_key"),
]


@dataclass
class KnownState:
    """Totals per key and distinct (column, key, value) pairs from before a batch of rows.

    ``fresh`` is ``reference_state.fresh_pairs`` of the batch, if the caller has it: then the rows needn't meet all known pairs.
    """

    keyed: dict[str, DataFrame]
    pairs: DataFrame | None
    fresh: DataFrame | None = None


def sum_columns(spec: KeyHistory) -> dict[str, Column]:
    """Additive measures of a key: value counts, sums and sums of squares."""
    out: dict[str, Column] = {}
    for prefix, (column, per_one) in spec.numeric.items():
        unit = stats.units(number(column), per_one)
        out[f"{prefix}__n"] = unit.isNotNull().cast("bigint")
        out[f"{prefix}__s"] = F.coalesce(unit, F.lit(0))
        out[f"{prefix}__q"] = F.coalesce(stats.squared(unit), F.lit(0).cast(stats.WIDE))
    return out


def distinct_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def derived_features(spec: KeyHistory, value_of: dict[str, Column]) -> dict[str, Column]:
    """Named features of one key from its raw totals (windowed, frozen or streamed)."""
    key = spec.key
    out = {
        f"{key}_prior_count": value_of["n"],
        f"{key}_seconds_since_previous": number(TIME) - value_of["last"],
    }
    for prefix, (column, per_one) in spec.numeric.items():
        n, s, q = (value_of[f"{prefix}__{part}"] for part in "nsq")
        average, std = stats.mean(n, s, per_one), stats.population_std(n, s, q, per_one)
        out |= {
            f"{prefix}_prior_numeric_count": n,
            f"{prefix}_prior_mean": average,
            f"{prefix}_prior_std": std,
        }
        if column == AMOUNT:
            for name, value in stats.deviations(number(AMOUNT), average, std).items():
                out[f"{prefix}_{name}"] = value
    for column in spec.distinct:
        out[f"{key}_{column}_prior_nunique"] = value_of[f"{column}__d"]
    return out


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = CHUNK_ROWS) -> DataFrame:
    """(kind, value, rows) of every key with more than ``hot_rows`` rows; at most rows / ``hot_rows`` of each kind.

    Rows are counted by hash bucket first, which combines to at most ``HOT_BUCKETS`` groups a kind and task however many keys
    there are. Only keys of buckets that hold more than ``hot_rows`` rows are counted themselves.
    """
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in keys
    ])).alias("p")).select("p.*").withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(HOT_BUCKETS)))
    full = pairs.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot_rows)
    buckets: dict[str, list[int]] = {}
    for r in full.select("kind", "bucket").collect():  # at most HOT_BUCKETS a kind
        buckets.setdefault(r["kind"], []).append(r["bucket"])
    if not buckets:
        return df.sparkSession.createDataFrame([], pairs.drop("bucket").withColumn("rows", F.lit(0).cast("long")).schema)
    wanted = functools.reduce(Column.__or__, [(F.col("kind") == k) & F.col("bucket").isin(found) for k, found in buckets.items()])
    return pairs.where(wanted).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot_rows)


def _window_stage(df: DataFrame, spec: KeyHistory, group: list[str], before: dict[str, Column]) -> DataFrame:
    """One key: windows inside ``group`` plus the totals of earlier chunks in ``before``.

    Among rows of ``_with_marks`` the marks count new values; they share the time of the row that they follow.
    """
    marked = MARK in df.columns
    window = Window.partitionBy(*group).orderBy(*event_order(), *([F.col(MARK)] if marked else []))
    past = window.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    flags = {} if marked else {
        f"_new_{c}": F.row_number().over(Window.partitionBy(*group, f"_v_{c}").orderBy(*event_order())) == 1
        for c in spec.distinct
    }
    staged = df.withColumns(flags) if flags else df

    def total(measure: Column, name: str) -> Column:
        inside = F.coalesce(F.sum(measure).over(past), zero)
        return inside + before[name] if name in before else inside

    rows_before = F.coalesce(F.sum((F.col(MARK) == 0).cast("bigint")).over(past), zero) if marked else F.row_number().over(window) - 1
    value_of = {
        "n": (rows_before + before.get("n", zero)).cast("bigint"),
        "last": F.coalesce(F.lag(number(TIME)).over(window), *([before["last"]] if "last" in before else [])),
    }
    for name, measure in sum_columns(spec).items():
        value_of[name] = total(measure, name)
    for place, c in enumerate(spec.distinct, 1):
        if marked:
            value_of[f"{c}__d"] = total((F.col(MARK) == place).cast("bigint"), f"{c}__d")
            continue
        fresh = F.col(f"_new_{c}")
        for mark in (f"_seen_{c}", f"_known_{c}"):  # met in an earlier chunk or before these rows
            if mark in df.columns:
                fresh = fresh & F.col(mark).isNull()
        value_of[f"{c}__d"] = total(fresh.cast("bigint"), f"{c}__d")
    # Raw totals first, then the derived features, so each window is evaluated once.
    raw = staged.withColumns({f"_w_{name}": value for name, value in value_of.items()})
    raw = raw.where(F.col(MARK) == 0).drop(MARK) if marked else raw
    features = derived_features(spec, {name: F.col(f"_w_{name}") for name in value_of})
    return raw.withColumns(features).drop(*[f"_w_{n}" for n in value_of], *flags)


def _with_marks(df: DataFrame, spec: KeyHistory, fresh: DataFrame) -> DataFrame:
    """The rows (mark 0) and, behind the first event of each new pair, a row that stands for the pair (the number of its column).

    So new values are counted in the window over the key, and the rows need not be dealt by (key, value) as well.
    """
    place = F.element_at(F.create_map(*[F.lit(x) for n, c in enumerate(spec.distinct, 1) for x in (c, n)]), F.col("column"))
    marks = fresh.where(F.col("column").isin(list(spec.distinct))).select(F.col("key").alias(spec.key), TIME, ID, place.alias(MARK))
    return df.withColumn(MARK, F.lit(0)).unionByName(marks, allowMissingColumns=True)


def _with_known_pairs(df: DataFrame, spec: KeyHistory, known: KnownState | None) -> DataFrame:
    """Join which values of a key are already known; pairs are unique, and AQE splits the skewed side."""
    for c in spec.distinct if known is not None else ():
        pairs = known.pairs.where(F.col("column") == c).select(
            F.col("key").alias(spec.key), F.col("value").alias(f"_v_{c}"), F.lit(True).alias(f"_known_{c}"))
        df = df.join(pairs, [spec.key, f"_v_{c}"], "left")
    return df


def _with_known(df: DataFrame, spec: KeyHistory, known: KnownState | None) -> tuple[DataFrame, dict[str, Column]]:
    """Join the totals that are already known of each key; they are unique per key, and AQE splits the skewed side."""
    if known is None:
        return df, {}
    table = known.keyed[spec.key]
    names = [c for c in table.columns if c != "key"]
    state = table.select(F.col("key").alias(spec.key), *[F.col(n).alias(f"_p_{n}") for n in names])
    before = {n: F.coalesce(F.col(f"_p_{n}"), F.lit(0)) for n in names if n != "last"}
    before["last"] = F.col("_p_last")
    return df.join(state, spec.key, "left"), before


def _helpers(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(("_p_", "_b_", "_v_", "_known_", "_seen_", "_new_", "_chunk"))]


def _value_texts(df: DataFrame, spec: KeyHistory) -> DataFrame:
    return df.withColumns({f"_v_{c}": distinct_text(c) for c in spec.distinct}) if spec.distinct else df


def _plain_key(df: DataFrame, spec: KeyHistory, known: KnownState | None) -> DataFrame:
    # The repartition by key lets the join of the totals and the (key, value) windows reuse the key's exchange.
    if spec.distinct and known is not None and known.fresh is not None:
        staged = _with_marks(df, spec, known.fresh)
    else:
        staged = _with_known_pairs(_value_texts(df, spec), spec, known)
    staged, before = _with_known(staged.repartition(spec.key), spec, known)
    result = _window_stage(staged, spec, [spec.key], before)
    return result.drop(*_helpers(result))


def _chunk_of(df: DataFrame, key: str, hot: DataFrame, chunk_rows: int, how: str) -> DataFrame:
    """Chunk number for rows of hot keys, -1 for the others. ``hot`` is a written table, so the planner knows its size."""
    mine = hot.where(F.col("kind") == key).select(F.col("value").alias(key), F.lit(True).alias("_hot"))
    chunk = F.when(F.col("_hot"), F.floor(F.col("_pos") / F.lit(chunk_rows))).otherwise(F.lit(-1))
    return df.join(mine, key, how).withColumn("_chunk", chunk).drop("_hot")


def _chunked_key(
    df: DataFrame, base: DataFrame, spec: KeyHistory, known: KnownState | None, hot: DataFrame, chunk_rows: int
) -> DataFrame:
    """Same result as ``_plain_key`` with hot keys cut into chunks of bounded size.

    Chunk totals are read from ``base``, the written order table, not from the growing plan.
    """
    key = spec.key
    hot_rows = _value_texts(_chunk_of(base, key, hot, chunk_rows, "inner"), spec)
    sums = sum_columns(spec)
    partial = hot_rows.groupBy(key, "_chunk").agg(
        F.count(F.lit(1)).alias("n"), F.max(number(TIME)).alias("last"),
        *[F.sum(measure).alias(name) for name, measure in sums.items()],
    )
    names = ["n", *sums]
    staged = _value_texts(_chunk_of(df, key, hot, chunk_rows, "left"), spec)
    for c in spec.distinct:
        value = f"_v_{c}"
        values = hot_rows.select(key, value, "_chunk").distinct()
        if known is not None:
            old = known.pairs.where(F.col("column") == c).select(F.col("key").alias(key), F.col("value").alias(value))
            values = values.join(old, [key, value], "left_anti")
        first = values.groupBy(key, value).agg(F.min("_chunk").alias("_chunk"))
        counts = first.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias(f"{c}__d"))
        partial = partial.join(counts, [key, "_chunk"], "left")
        names.append(f"{c}__d")
        # Values a later chunk meets again; one row per (key, chunk, value).
        seen = (
            values.join(first.withColumnRenamed("_chunk", "_first"), [key, value])
            .where("_first < _chunk").drop("_first").withColumn(f"_seen_{c}", F.lit(True))
        )
        staged = staged.join(seen, [key, "_chunk", value], "left")
    # At most (rows / chunk_rows + sort partitions) rows per key in this window.
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = partial.select(
        key, "_chunk", F.max("last").over(earlier).alias("_b_last"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_b_{n}") for n in names],
    )
    staged, before = _with_known(_with_known_pairs(staged, spec, known), spec, known)
    joined = staged.repartition(key, "_chunk").join(offsets, [key, "_chunk"], "left")
    totals = {n: F.coalesce(F.col(f"_b_{n}"), F.lit(0)) + before.get(n, F.lit(0)) for n in names}
    totals["last"] = F.coalesce(F.col("_b_last"), before["last"]) if before else F.col("_b_last")
    result = _window_stage(joined, spec, [key, "_chunk"], totals)
    return result.drop(*_helpers(result))


def source_columns(specs: list[KeyHistory], columns: list[str]) -> list[str]:
    """The columns the history of these keys reads."""
    wanted = {TIME, ID, *[s.key for s in specs], *[c for s in specs for c in s.distinct]}
    wanted |= {column for s in specs for column, _ in s.numeric.values()} | {AMOUNT}
    return [c for c in columns if c in wanted]


def _histories(
    base: DataFrame, specs: list[KeyHistory], hot_rows: int, known: KnownState | None,
    after: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Past-only features of the rows of a written table, all its columns kept.

    The key counts, the chunk totals and the windows read the files instead of repeating the joins behind them. ``after``
    changes the rows when the features of a key (its place in ``specs``) are there, before they move on to the next key.
    """
    result = base
    hot = write_through(hot_keys(base, [s.key for s in specs], hot_rows).select("kind", "value"), "hot-keys")
    hot_kinds = {r["kind"] for r in hot.select("kind").distinct().collect()}  # at most one row per tracked key
    if hot_kinds:
        base = result = ordered(base, event_order(), "history-order")
    for at, spec in enumerate(specs):
        if spec.key in hot_kinds:
            result = _chunked_key(result, base, spec, known, hot, hot_rows)
        else:
            result = _plain_key(result, spec, known)
        result = after(result, at) if after else result
    return result.drop("_pos")


def _features_of(rows: DataFrame, specs: list[KeyHistory], hot_rows: int, known: KnownState | None, *keep: str) -> DataFrame:
    """``keep`` and the features: only the dozen source columns are shuffled, once per key."""
    narrow = rows.select(*source_columns(specs, rows.columns), *[c for c in keep if c == ROW])
    return _histories(narrow, specs, hot_rows, known).select(*keep, *[n for s in specs for n in spec_features(s)])


def history_features(
    df: DataFrame, specs: list[KeyHistory] | None = None, *, hot_rows: int = CHUNK_ROWS, known: KnownState | None = None
) -> DataFrame:
    """The id and the past-only features, one row for each row."""
    specs = [s.present(df.columns) for s in specs or KEY_HISTORIES]
    narrow = write_through(df.select(*source_columns(specs, df.columns)), "history-source")
    return _features_of(narrow, specs, hot_rows, known, ID)


def with_history(
    df: DataFrame, specs: list[KeyHistory] | None = None, *, hot_rows: int = CHUNK_ROWS, known: KnownState | None = None
) -> DataFrame:
    """Add past-only features to rows that already carry the row-level features.

    Rows of any width are written once with a number and meet their features again by it, in one join; other columns stay
    out of the shuffles per key. Rows that repeat an id or have none keep a row each. ``known`` adds history from
    before these rows.
    """
    specs = [s.present(df.columns) for s in specs or KEY_HISTORIES]
    rows = write_through(df.withColumn(ROW, F.monotonically_increasing_id()), "history-rows")
    return rows.join(_features_of(rows, specs, hot_rows, known, ROW), ROW).drop(ROW)


def with_row_history(
    df: DataFrame, specs: list[KeyHistory] | None = None, *, hot_rows: int = CHUNK_ROWS, known: KnownState | None = None
) -> DataFrame:
    """Add the row-level and the past-only features to the rows of a written table.

    Rows of at most ``CARRIED`` columns pass the shuffles per key as they are, and the row-level features are derived where
    the result is used, so nothing is written or joined again. Wider rows go through ``with_history``.
    """
    rows = with_v2_row_features(df)
    specs = [s.present(rows.columns) for s in specs or KEY_HISTORIES]
    if len(df.columns) > CARRIED or any(c.startswith("_") for c in df.columns):
        return with_history(rows, specs, hot_rows=hot_rows, known=known)
    base = rows.select(*dict.fromkeys([*df.columns, *source_columns(specs, rows.columns)]))
    found = _histories(base, specs, hot_rows, known)
    # One struct that is never NULL, so that counts of missing values stay those of the row.
    packed = found.select(*df.columns, F.struct(*[n for s in specs for n in spec_features(s)]).alias(PAST))
    return with_v2_row_features(packed).select(*rows.columns, f"{PAST}.*")


def causal_features(df: DataFrame, *, hot_rows: int = CHUNK_ROWS) -> DataFrame:
    """Row-level and past-only features of a whole transaction table, label untouched."""
    return with_history(with_v2_row_features(df), hot_rows=hot_rows)


def spec_features(spec: KeyHistory) -> list[str]:
    """Feature names of one key, in the order ``derived_features`` gives them."""
    names = [f"{spec.key}_prior_count", f"{spec.key}_seconds_since_previous"]
    for prefix, (column, _) in spec.numeric.items():
        parts = ["prior_numeric_count", "prior_mean", "prior_std"]
        parts += ["difference", "ratio", "zscore"] if column == AMOUNT else []
        names += [f"{prefix}_{part}" for part in parts]
    return names + [f"{spec.key}_{c}_prior_nunique" for c in spec.distinct]


def feature_names(columns: list[str]) -> list[str]:
    """Names of the past-only features for a table with these columns."""
    return [n for spec in KEY_HISTORIES for n in spec_features(spec.present(columns))]


def past_digests(df: DataFrame, upto: Column | None = None, *, hot_rows: int = CHUNK_ROWS) -> DataFrame:
    """(uid_proxy, its prior count, two 64-bit digests of id, time, uid_proxy and all past features) of each row.

    A key's features enter the digests where they are made and go; the columns that no later key reads go with them, so
    the rows that move on stay narrow. ``upto`` is a condition on id, time and uid_proxy.
    """
    rows = with_v2_row_features(df)
    specs = [s.present(rows.columns) for s in KEY_HISTORIES]
    base = write_through(rows.select(*dict.fromkeys([*source_columns(specs, rows.columns), "uid_proxy"])), "audit-source")
    first = "uid_proxy_prior_count"

    def digests(names: list[str], so_far: list[Column]) -> list[Column]:
        # A hash passes over NULL, so what is NULL is hashed too.
        values = [*map(F.col, names), *[F.col(n).isNull() for n in names]]
        return [F.xxhash64(d, *values).alias(n) for d, n in zip(so_far, DIGESTS)]

    def folded(result: DataFrame, at: int) -> DataFrame:
        so_far = [F.col(d) for d in DIGESTS] if at else [F.lit(1), F.lit(2)]
        names = [*([] if at else [ID, TIME, "uid_proxy"]), *spec_features(specs[at])]
        later = {ID, TIME, "uid_proxy", first, "_pos"}
        for s in specs[at + 1:]:
            later |= {s.key, *s.distinct, *[column for column, _ in s.numeric.values()]}
        return result.select(*[c for c in result.columns if c in later], *digests(names, so_far))

    found = _histories(base, specs, hot_rows, None, folded)
    return (found if upto is None else found.where(upto)).select("uid_proxy", first, *DIGESTS)


def leakage_audit(df: DataFrame, changed: DataFrame, upto: Column | None = None, *, before: DataFrame | None = None) -> DataFrame:
    """Count past-feature rows that differ between a table and an altered copy of it.

    ``upto`` limits the comparison to rows that must not change (for example all rows
    before the altered one), by id, time or uid_proxy. Zero means nothing leaked. Rows are compared by 128 bits of digest.
    ``before`` is the written ``past_digests(df, upto)`` if the caller has it.
    """
    left = write_through(past_digests(df, upto), "audit-before") if before is None else before
    sides = [d.select(*DIGESTS, F.lit(n).alias("n")) for d, n in ((left, 1), (past_digests(changed, upto), -1))]
    counted = sides[0].unionByName(sides[1]).groupBy(*DIGESTS).agg(F.sum("n").alias("n"))
    leaked = counted.agg(
        F.lit("past_features_changed").alias("check"), F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("violations")
    )
    starts = left.groupBy("uid_proxy").agg(F.min("uid_proxy_prior_count").alias("least")).agg(
        F.lit("keys_without_first_row").alias("check"), F.count_if(F.col("least") != 0).alias("violations")
    )
    return leaked.unionByName(starts)
