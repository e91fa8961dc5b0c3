"""Global order without a single-task window.

A global sort in Spark is range partitioned, so it spreads any distribution of the order
columns (ties are broken by the later columns). ``ordered`` writes the sorted rows with a
position; ``running_totals`` and ``sequence_numbers`` turn positions into cumulative
values by adding the totals of all earlier chunks. A chunk holds at most ``chunk_rows``
rows, so no window group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.schema import ID, TIME
from riskspark.session import write_through

CHUNK_ROWS = 1_000_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits

EVENT_ORDER = [TIME, ID]


def event_order() -> list[Column]:
    return [F.col(c) for c in EVENT_ORDER]


def ordered(df: DataFrame, order: list[Column], label: str = "ordered") -> DataFrame:
    """Rows sorted globally, written once, with an increasing ``_pos``."""
    return write_through(
        df.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id()), label
    )


def running_totals(
    df: DataFrame,
    order: list[Column],
    sums: dict[str, Column],
    *,
    by: list[str] | None = None,
    chunk_rows: int = CHUNK_ROWS,
    presorted: bool = False,
) -> DataFrame:
    """Add inclusive cumulative sums in ``order``, per ``by`` group if given."""
    by = by or []
    base = df if presorted else ordered(df, [F.col(c) for c in by] + order, "totals")
    base = base.withColumn("_chunk", F.floor(F.col("_pos") / F.lit(chunk_rows)))
    keys = by + ["_chunk"]
    totals = base.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    # One row per chunk and group: N / chunk_rows rows in the longest window.
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    inside = Window.partitionBy(*keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    joined = base.join(offsets, keys)
    return joined.select(
        *[c for c in base.columns if c not in {"_chunk"}],
        *[(F.col(f"_o_{n}") + F.sum(c).over(inside)).alias(n) for n, c in sums.items()],
    )


def max_of_earlier(
    df: DataFrame, order: list[Column], value: Column, name: str, *, chunk_rows: int = CHUNK_ROWS, number: str | None = None
) -> DataFrame:
    """Add the largest ``value`` of all rows before a row in ``order``, NULL for the first.

    ``number`` names the numeric column that leads ``order``, if one does. Rows are then cut into chunks by its value, so they
    move once and are neither sorted as a whole nor written; a chunk holds ``chunk_rows`` different numbers at most.
    """
    if number is None:
        base, order = ordered(df, order, "earlier"), [F.col("_pos")]
        base = base.withColumn("_chunk", F.floor(F.col("_pos") / F.lit(chunk_rows)))
    else:  # a missing number comes first in the order
        base = df.withColumn("_chunk", F.coalesce(F.floor(F.col(number) / F.lit(chunk_rows)), F.lit(-1 << 62)))
    # One row per chunk: N / chunk_rows rows in the window over chunks.
    chunks = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = base.groupBy("_chunk").agg(F.max(value).alias("_m")).select("_chunk", F.max("_m").over(chunks).alias("_before"))
    inside = Window.partitionBy("_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return base.join(before, "_chunk").withColumn(name, F.greatest("_before", F.max(value).over(inside))).drop("_chunk", "_pos", "_before")


def sequence_numbers(df: DataFrame, order: list[Column] | None = None, name: str = "sequence_number") -> DataFrame:
    """Add a dense zero-based order number: one range sort, no window over the rows."""
    base = ordered(df, order or event_order(), "sequence").withColumn(
        "_part", F.shiftright("_pos", _ROW_BITS)
    )
    # One row per sorted partition, so both the window and the broadcast are bounded by
    # the number of shuffle partitions.
    counts = base.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return (
        base.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_first") + F.col("_pos") - F.shiftleft("_part", _ROW_BITS))
        .drop("_part", "_first", "_pos")
    )


def fifo_violations(df: DataFrame, sequence: str = "sequence_number") -> DataFrame:
    """Count neighbours out of event order or with a repeated sequence number.

    A row is compared with its predecessor in sequence order. Chunks are compared inside,
    then first-with-previous-last across chunk borders.
    """
    base = ordered(
        df.select(sequence, *EVENT_ORDER), [F.col(sequence), *event_order()], "fifo"
    ).withColumn("_chunk", F.floor(F.col("_pos") / F.lit(CHUNK_ROWS)))
    inside = Window.partitionBy("_chunk").orderBy("_pos")
    key = F.struct(*EVENT_ORDER)
    within = base.select(
        (F.lag(key).over(inside) > key).alias("late"),
        (F.lag(sequence).over(inside) >= F.col(sequence)).alias("stuck"),
    )
    edges = base.groupBy("_chunk").agg(
        F.min_by(key, "_pos").alias("first"), F.max_by(key, "_pos").alias("last"),
        F.min(sequence).alias("first_seq"), F.max(sequence).alias("last_seq"),
    )
    chunks = Window.orderBy("_chunk")
    borders = edges.select(
        (F.lag("last").over(chunks) > F.col("first")).alias("late"),
        (F.lag("last_seq").over(chunks) >= F.col("first_seq")).alias("stuck"),
    )
    return within.unionByName(borders).agg(
        F.count_if("late").alias("order_violations"), F.count_if("stuck").alias("sequence_violations")
    )


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probability: float,
    *,
    by: list[str] | None = None,
    discrete: bool = False,
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact quantile of several numeric columns, one row per (by, column).

    An approximate sketch brackets the wanted rank with its guaranteed error; only values
    inside the bracket are grouped, sorted and counted exactly.
    """
    by = by or []
    long = df.select(
        *by, F.explode(F.map_from_arrays(
            F.array(*[F.lit(c) for c in columns]),
            F.array(*[F.col(c).cast("double") for c in columns]),
        )).alias("column", "value"),
    ).where("value is not null and not isnan(value)")
    keys = by + ["column"]
    margin = 2.0 / accuracy
    low, high = max(0.0, probability - margin), min(1.0, probability + margin)
    brackets = long.groupBy(*keys).agg(
        F.count("value").alias("_n"),
        F.percentile_approx("value", F.array(F.lit(low), F.lit(high)), F.lit(accuracy)).alias("_b"),
    )
    # One row per group and column; the sketch already fits one aggregation buffer each.
    brackets = write_through(brackets, "brackets")
    near = long.join(brackets, keys)
    below = near.groupBy(*keys).agg(F.count_if(F.col("value") < F.col("_b")[0]).alias("_below"))
    inside = (
        near.where(F.col("value").between(F.col("_b")[0], F.col("_b")[1]))
        .groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_c"))
    )
    cumulative = running_totals(inside, [F.col("value")], {"_upto": F.col("_c")}, by=keys)
    ranked = cumulative.join(below, keys).join(brackets.drop("_b"), keys).select(
        *keys, "value", "_n",
        (F.col("_below") + F.col("_upto")).alias("_last"),
        (F.col("_below") + F.col("_upto") - F.col("_c")).alias("_before"),
    )
    if discrete:
        wanted = F.greatest(F.ceil(F.col("_n") * F.lit(probability)), F.lit(1))
        return (
            ranked.where((F.col("_before") < wanted) & (wanted <= F.col("_last")))
            .select(*keys, F.col("value").alias("quantile"))
        )
    position = (F.col("_n") - 1) * F.lit(probability)
    lower, upper = F.floor(position) + 1, F.ceil(position) + 1
    holds = lambda rank: (F.col("_before") < rank) & (rank <= F.col("_last"))
    picked = ranked.where(holds(lower) | holds(upper)).groupBy(*keys).agg(
        F.max(F.when(holds(lower), F.col("value"))).alias("_lo"),
        F.max(F.when(holds(upper), F.col("value"))).alias("_hi"),
        F.max(position - F.floor(position)).alias("_frac"),
    )
    return picked.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("quantile"))
