"""Result shaping for reports: plain text, numbers and nothing nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flat(field: T.StructField) -> Column:
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.DateType):
        c = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(kind, T.TimestampType):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(kind, T.DecimalType):
        c = c.cast("double")
    elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        c = c.cast("long")
    elif isinstance(kind, T.BooleanType):
        c = c.cast("string")
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        c = F.array_join(c, ",")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        c = F.to_json(c)
    return c.alias(field.name)


def flat(df: DataFrame) -> DataFrame:
    """Dates and times as text, decimals as doubles, nested values as JSON text."""
    return df.select(*[_flat(f) for f in df.schema.fields])
