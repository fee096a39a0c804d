"""Hashes that make sampling repeatable whatever the partitioning."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType, VariantType


def row_hash(key: Sequence[str], seed: int) -> Column:
    """32 hex digits from the key columns and the seed; NULL keys hash as an empty text."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def content_hash(df: DataFrame) -> Column:
    """32 hex digits from all columns, each hashed by itself; NULL differs from every value."""
    return F.md5(F.concat(*(_value_hash(field) for field in df.schema)))


def _value_hash(field) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (ArrayType, MapType, StructType, VariantType)):
        value = F.to_json(F.struct(value))
    elif not isinstance(field.dataType, BinaryType):
        value = value.cast("string")
    return F.coalesce(F.md5(value), F.lit("-"))


def leading_number(hashed: Column, digits: int) -> Column:
    number = F.conv(F.substring(hashed, 1, digits), 16, 10).cast("bigint")
    return F.coalesce(number, F.lit(0))  # never NULL, so joins on it add no second hashing


def below_fraction(hashed: Column, fraction: float) -> Column:
    """True for this share of all hashes; hex digits compare as text like the numbers they write."""
    if not 0 <= fraction <= 1:
        raise ValueError(f"fraction must lie in [0, 1], got {fraction}")
    if fraction == 1:
        return F.lit(True)
    return F.substring(hashed, 1, 8) < format(int(fraction * 16 ** 8), "08x")
