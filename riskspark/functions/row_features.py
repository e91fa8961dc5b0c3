"""Row-level features. Version 1 and Version 2 need no learned state."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.schema import (
    AMOUNT, CODE_COLUMNS, D_COLUMNS, ID, LABEL, MISSING, TIME, identity_value_columns,
)

DAY = 86_400
WEEK = 7 * DAY
HOUR = 3_600

# Which source columns each missing-value family counts.
TRANSACTION_FAMILY = [AMOUNT, "ProductCD", "dist1", "dist2"]
CARD_ADDRESS_FAMILY = CODE_COLUMNS + ["card4", "card6"]


def number(name: str) -> Column:
    return F.expr(f"try_cast(`{name}` as double)")


def text_or_missing(name: str, columns: list[str]) -> Column:
    if name not in columns:
        return F.lit(MISSING)
    return F.coalesce(F.col(name).cast("string"), F.lit(MISSING))


def joined_key(columns: list[str], *names: str) -> Column:
    return F.concat_ws("__", *[text_or_missing(n, columns) for n in names])


def null_count(names: list[str]) -> Column:
    total = F.lit(0)
    for name in names:
        total = total + F.col(name).isNull().cast("int")
    return total


def num_missing(columns: list[str]) -> Column:
    return null_count([c for c in columns if c not in {ID, LABEL}])


def family_missing(columns: list[str]) -> dict[str, Column]:
    present = lambda names: [n for n in names if n in columns]
    return {
        "transaction_missing": null_count(present(TRANSACTION_FAMILY)),
        "card_address_missing": null_count(present(CARD_ADDRESS_FAMILY)),
        "identity_missing": null_count(identity_value_columns(columns)),
    }


def amount_features() -> dict[str, Column]:
    amount = number(AMOUNT)
    # greatest() ignores NULL, so a missing amount needs its own branch.
    return {
        "transaction_amount_log1p": F.when(amount.isNotNull(), F.log1p(F.greatest(amount, F.lit(0.0)))),
        "transaction_amount_cents": F.rint((amount - F.floor(amount)) * 100),
    }


def relative_time_features() -> dict[str, Column]:
    seconds = number(TIME)
    return {
        "transaction_relative_day": F.floor(seconds / DAY).cast("double"),
        "transaction_relative_week": F.floor(seconds / WEEK).cast("double"),
        "transaction_relative_hour_phase": F.floor(F.pmod(seconds, F.lit(float(DAY))) / HOUR).cast("double"),
    }


def pair_keys(columns: list[str]) -> dict[str, Column]:
    return {
        "card_1_2": joined_key(columns, "card1", "card2"),
        "address_1_2": joined_key(columns, "addr1", "addr2"),
        "email_pair": joined_key(columns, "P_emaildomain", "R_emaildomain"),
    }


def cyclic_time_features() -> dict[str, Column]:
    seconds = number(TIME)
    day = seconds / DAY
    hour = F.pmod(seconds, F.lit(float(DAY))) / HOUR
    return {
        "transaction_day_continuous": day,
        "transaction_week_sin": F.sin(2 * math.pi * day / 7),
        "transaction_week_cos": F.cos(2 * math.pi * day / 7),
        "transaction_hour_sin": F.sin(2 * math.pi * hour / 24),
        "transaction_hour_cos": F.cos(2 * math.pi * hour / 24),
    }


def normalized_d(columns: list[str]) -> dict[str, Column]:
    return {f"{d}_normalized": number(TIME) / DAY - number(d) for d in D_COLUMNS if d in columns}


def amount_dollars() -> dict[str, Column]:
    return {"transaction_amount_dollars": F.floor(number(AMOUNT)).cast("double")}


def entity_keys(columns: list[str]) -> dict[str, Column]:
    return {
        "card1_key": text_or_missing("card1", columns),
        "card_address_key": joined_key(columns, "card1", "addr1"),
        "card_address_email_key": joined_key(columns, "card1", "addr1", "P_emaildomain"),
        "device_key": joined_key(columns, "DeviceType", "DeviceInfo"),
    }


def uid_proxy(columns: list[str]) -> Column:
    """Client proxy: card, address and the day the account clock started."""
    anchor = F.lit(MISSING)
    if "D1" in columns:
        day_zero = number(TIME) / DAY - number("D1")
        anchor = F.coalesce(F.rint(day_zero).cast("bigint").cast("string"), F.lit(MISSING))
    return F.concat_ws("__", text_or_missing("card1", columns), text_or_missing("addr1", columns), anchor)


def agent_family(name: str) -> Column:
    """First lower-case token of a browser or system text.

    A NULL is filled with ``MISSING`` before lower-casing, so it becomes ``missing``; text
    that does not start with a letter becomes ``MISSING``.
    """
    cleaned = F.trim(F.lower(F.coalesce(F.col(name).cast("string"), F.lit(MISSING))))
    token = F.regexp_extract(cleaned, r"^([a-z][a-z0-9_+.-]*)", 1)
    return F.coalesce(F.nullif(token, F.lit("")), F.lit(MISSING))


def with_v1_features(df: DataFrame) -> DataFrame:
    """All Version 1 features; columns absent from ``df`` are skipped."""
    columns = df.columns
    added = {"num_missing": num_missing(columns), **family_missing(columns)}
    if AMOUNT in columns:
        added |= amount_features()
    if TIME in columns:
        added |= relative_time_features()
    added |= pair_keys(columns)
    return df.withColumns(added)


def with_v2_row_features(df: DataFrame) -> DataFrame:
    """Version 1 features plus the row-level part of Version 2."""
    base = df if "num_missing" in df.columns else with_v1_features(df)
    columns = base.columns
    added = {
        **cyclic_time_features(), **normalized_d(columns), **amount_dollars(),
        **entity_keys(columns), "uid_proxy": uid_proxy(columns),
    }
    for source, feature in (("id_30", "operating_system_family"), ("id_31", "browser_family")):
        if source in columns:
            added[feature] = agent_family(source)
    return base.withColumns(added)


def model_columns(columns: list[str]) -> list[str]:
    """Model inputs: everything but the label and the row identifier."""
    return [c for c in columns if c not in {ID, LABEL}]
