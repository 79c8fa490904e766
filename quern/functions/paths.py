"""Dotted field paths as columns of a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from quern.plans.ir import QueryError


@dataclass(frozen=True)
class Field:
    """A resolved path. fans: it goes through all elements of an array, so its column is an array of what it names."""

    column: Column
    type: DataType
    fans: bool = False


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def resolve(df: DataFrame, path: str) -> Field:
    """A column of that very name (case counts), else the longest column name that the path starts with, then steps:

    a field of a struct, a key of a map, an index of an array (null beyond its end), or a field of all its elements.
    """
    schema = {f.name: f.dataType for f in df.schema}
    parts = path.split(".")
    for n in range(len(parts), 0, -1):
        name = ".".join(parts[:n])
        if name in schema:
            found = Field(F.col(quoted(name)), schema[name])
            for step in parts[n:]:
                found = _step(found, step, path)
            return found
    raise QueryError(f"unknown field {path!r}; there are {', '.join(sorted(schema))}")


def _step(at: Field, step: str, path: str) -> Field:
    kind = at.type.elementType if at.fans else at.type
    if isinstance(kind, StructType) and step in kind.fieldNames():
        if at.fans:
            return Field(F.transform(at.column, lambda x: x.getField(step)), ArrayType(kind[step].dataType), True)
        return Field(at.column.getField(step), kind[step].dataType)
    if not at.fans and isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        return Field(F.try_element_at(at.column, F.lit(step)), kind.valueType)
    if not at.fans and isinstance(kind, ArrayType):
        if step.isdigit():
            return Field(F.get(at.column, F.lit(int(step))), kind.elementType)
        return _step(Field(at.column, kind, True), step, path)
    raise QueryError(f"{path!r}: {kind.simpleString()} has no {step!r}")


def without(df: DataFrame, path: str) -> DataFrame:
    """``df`` less a column or a field inside structs."""
    if path in df.columns:
        return df.drop(F.col(quoted(path)))
    resolve(df, path)
    top, _, rest = path.partition(".")
    kind = df.schema[top].dataType
    if not isinstance(kind, StructType):
        raise QueryError(f"{path!r}: fields can be left out of structs only")
    if not rest:
        return df.drop(F.col(quoted(top)))
    return df.withColumn(top, F.col(quoted(top)).dropFields(".".join(quoted(x) for x in rest.split("."))))
