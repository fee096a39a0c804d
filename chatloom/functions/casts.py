"""Casts of text columns that give NULL, not an error, for unreadable values."""

from pyspark.sql import Column, DataFrame, functions as F

INTEGRAL = {"tinyint", "smallint", "int", "bigint"}

# The whole part of a plain decimal number.
WHOLE_PART = r"^\s*[+-]?\d+(?=(\.\d*)?\s*$)"


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the named columns, keep the rest, in one projection.

    Text goes to a whole number by dropping its decimals ('12.5' gives 12); text that is
    no number, or too large for the type, gives NULL. Picking the whole part by pattern also
    keeps unreadable text away from the cast, where each would cost an exception.
    """
    texts = {name for name, type_ in df.dtypes if type_ == "string"}

    def cast(name):
        if name not in types:
            return F.col(name)
        value = F.col(name)
        if name in texts and types[name] in INTEGRAL:
            value = F.regexp_substr(value, F.lit(WHOLE_PART))
        return value.try_cast(types[name]).alias(name)

    return df.select(*map(cast, df.columns))


def first_result(annotations: Column) -> Column:
    """The ``result`` of the first annotation in an array of structs; NULL where there is none."""
    return F.get(annotations["result"], F.lit(0))
