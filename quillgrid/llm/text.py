"""Column expressions that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone; ``lower`` serves the texts that are all ASCII, where it does just that."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def whole_numbers(df: DataFrame, column: str) -> Column:
    """The column as long, of operators that order or compare ids; ids of another type are refused at once."""
    kind = df.schema[column].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"{column} has to be a whole number, not {kind.simpleString()}")
    return F.col(column).cast("long")


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]
