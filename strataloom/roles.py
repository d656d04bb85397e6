"""Column roles, inferred once, and the clean-up that makes NaN, infinities and nulls one thing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats in which strings count as datetimes (fixed values).
DATETIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd")


@dataclass
class ColumnRoles:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)

    @property
    def all(self) -> list[str]:
        return [*self.numeric, *self.categorical, *self.datetime]


def as_timestamp(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return column.cast("timestamp")
    return F.coalesce(*[F.try_to_timestamp(column.cast("string"), F.lit(f)) for f in DATETIME_FORMATS])


def infer_roles(df: DataFrame, target: str | None = None, sample: int = 100, share: float = 0.7) -> ColumnRoles:
    """Datetime columns first, then numeric ones; the rest is categorical. A string column is a
    datetime if ``share`` of up to ``sample`` non-empty values parse."""
    roles, strings = ColumnRoles(), []
    for f in df.schema.fields:
        if f.name == target:
            continue
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            roles.datetime.append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            roles.numeric.append(f.name)
        else:
            (strings if isinstance(f.dataType, T.StringType) else roles.categorical).append(f.name)
    if strings:
        head = df.select(*strings).limit(sample)
        found = head.agg(
            *[F.sum(F.when(F.trim(c) != "", 1).otherwise(0)).alias(f"n{i}") for i, c in enumerate(strings)],
            *[F.count(as_timestamp(F.col(c), T.StringType())).alias(f"p{i}") for i, c in enumerate(strings)],
        ).first()
        for i, c in enumerate(strings):
            (roles.datetime if found[f"n{i}"] and found[f"p{i}"] >= share * found[f"n{i}"] else roles.categorical).append(c)
    return roles


def normalise(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Numeric columns as doubles with null for NaN and infinities, booleans as strings."""
    done = {c: finite(F.col(f"`{c}`").cast("double")) for c in roles.numeric}
    done |= {c: F.col(f"`{c}`").cast("string") for c in roles.categorical if dict(df.dtypes)[c] == "boolean"}
    return df.withColumns(done) if done else df


def finite(x: Column) -> Column:
    """``x``, or null where it isn't a number within the range of 32-bit floats."""
    return F.when(F.abs(x) <= F.lit(3.402823e38), x)
