"""Column helpers whose results differ from Spark's own operators."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def int_div(a: Column, b: Column) -> Column:
    """Quotient of integers, cut towards zero; NULL with NULL, an error for a zero divisor under ANSI."""
    return ((a - a % b) / b).cast("bigint")


def plus(a: Column, b: Column, kind: T.DataType) -> Column:
    """`+`: concatenation for strings, a sum for anything else."""
    return F.concat(a, b) if isinstance(kind, T.StringType) else a + b


def to_text(a: Column, kind: T.DataType) -> Column:
    """Text of a value: floats without an exponent and without a trailing `.0`."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = a.cast("decimal(38,0)").cast("string")
        return F.when(a == F.floor(a), whole).otherwise(F.regexp_replace(a.cast("decimal(38,17)").cast("string"), r"0+$", ""))
    return a.cast("string")


def trunc_int(a: Column) -> Column:
    """Integer part of a float, cut towards zero."""
    return a.cast("bigint")
