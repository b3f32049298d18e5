"""Canonical rows and digests of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACES = 4  # decimals kept before hashing


def canonical_value(df: DataFrame, name: str, places: int = PLACES) -> Column:
    """Text form of one column: fractions at fixed decimals, ISO dates, NaN as null."""
    dt, c = df.schema[name].dataType, F.col(name)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), F.round(c, places)).cast(T.DecimalType(38, places))
    elif isinstance(dt, T.DecimalType):
        c = F.round(c, places).cast(T.DecimalType(38, places))
    return F.coalesce(c.cast("string"), F.lit("null"))


def canonical_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """`name=value` pairs in name order, so column order does not matter."""
    names = sorted(columns or df.columns)
    return F.concat_ws("|", *[F.concat(F.lit(f"{n}="), canonical_value(df, n)) for n in names])


def hash_sums(row: Column) -> list[Column]:
    """Five sums over the slices of each row's SHA-256: free of order, fixed in size, combined before a shuffle."""
    h = F.sha2(row, 256)
    slices = [F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast(T.DecimalType(20, 0)) for i in range(5)]
    return [F.coalesce(F.sum(x).cast("string"), F.lit("0")) for x in slices]


def table_digest(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(row_count, digest) of a table, or of each group, of any size; nothing is collected."""
    n = F.count(F.lit(1))
    text = F.concat_ws("|", n.cast("string"), *hash_sums(canonical_row(df, columns)))
    return df.groupBy(*(by or [])).agg(n.alias("row_count"), F.sha2(text, 256).alias("digest"))


def result_hash(df: DataFrame, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The digest of each result, as (by, result_hash, row_count)."""
    return table_digest(df, columns, by).withColumnRenamed("digest", "result_hash").select(*(by or []), "result_hash", "row_count")


def keyed_digest(message: Column, key: bytes) -> Column:
    """HMAC-SHA-256 of `message` (RFC 2104), composed of built-in hash functions."""
    import hashlib

    k = hashlib.sha256(key).digest() if len(key) > 64 else key
    k = k.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in k)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)
