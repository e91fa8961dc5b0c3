"""Low-latency history of a single key kept in the state store.

The state store hands all new rows of a key to one task, so this suits keys whose rows per
micro-batch stay small. ``scoring.StreamJob`` has no such limit: its windows cut hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskspark.functions import stats
from riskspark.schema import AMOUNT, ID, TIME

OUTPUT = (
    "key string, TransactionID long, prior_count long, seconds_since_previous double, "
    "amount_prior_numeric_count long, amount_prior_mean double, amount_prior_std double"
)
STATE = "n long, last double, vn long, vs long, vq decimal(38,0)"


def _past_of_key(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Emit the past of each new row of one key, then store the new totals."""
    n, last, vn, vs, vq = state.get if state.exists else (0, None, 0, 0, 0)
    parts = list(batches)  # rows of one key in one micro-batch
    held = parts[0] if len(parts) == 1 else pd.concat(parts)
    ids, at = held[ID].to_numpy(), held[TIME].to_numpy()
    order = np.lexsort((ids, at))  # groups are small and many, so plain arrays instead of frames
    ids, times = ids[order], at[order].astype("float64")
    unit = held["unit"].to_numpy()[order]
    here = ~pd.isna(unit)
    values = [int(v) if ok else 0 for v, ok in zip(unit, here)]
    # Python integers keep the sums of squares exact.
    past_n = vn + np.concatenate([[0], np.cumsum(here)[:-1]])
    past_s, past_q, s, q = [], [], int(vs), int(vq)
    for v in values:
        past_s.append(s)
        past_q.append(q)
        s, q = s + v, q + v * v
    previous = np.concatenate([[np.nan if last is None else last], times[:-1]])
    mean = [a / c / stats.AMOUNT_UNITS if c else None for a, c in zip(past_s, past_n)]
    std = [float(max(int(c) * b - a * a, 0)) ** 0.5 / c / stats.AMOUNT_UNITS if c >= 2 else None for a, b, c in zip(past_s, past_q, past_n)]
    state.update((int(n + len(ids)), float(times[-1]), int(vn + here.sum()), s, Decimal(q)))
    yield pd.DataFrame({
        "key": key[0], ID: ids, "prior_count": n + np.arange(len(ids)), "seconds_since_previous": times - previous,
        "amount_prior_numeric_count": past_n, "amount_prior_mean": mean, "amount_prior_std": std,
    })


def keyed_history(stream: DataFrame, key: str) -> DataFrame:
    """Count, gap and amount statistics of each row's key before the row."""
    rows = stream.select(F.col(key).cast("string").alias("key"), ID, TIME, stats.units(F.col(AMOUNT).cast("double"), stats.AMOUNT_UNITS).alias("unit"))
    return rows.groupBy("key").applyInPandasWithState(_past_of_key, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
