"""A 60-bit hash of an identifier that Spark and SQL engines compute alike."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 60


def id_hash(column: Column) -> Column:
    """The first 15 hex digits of md5 of the identifier's decimal form, as a number; null counts as ''."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def id_hash_sql(column: str) -> str:
    return f"('0x' || substr(md5(coalesce(cast({column} AS VARCHAR), '')), 1, 15))::BIGINT"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, with underscores before them where `df` has such a column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def lowest_hashed(rows: DataFrame, key: str, n: int, total: int) -> pa.Table:
    """At most n of `rows`, of about `total`: those whose `key` hashes lowest, ties by all columns.

    About 2n rows are let through by their hash alone, so that no partition sends n of its own.
    """
    h = F.xxhash64(key)
    bound = -(1 << 63) + int(min(1.0, 2.0 * n / max(1, total)) * ((1 << 64) - 1))
    names = [c for c in rows.columns if c != key]
    some = rows.where(h <= F.lit(min(bound, (1 << 63) - 1)).cast("bigint")).select(h.alias("_h"), *names)
    return some.orderBy("_h", *names).limit(n).drop("_h").toArrow()
