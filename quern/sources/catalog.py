"""What queries can name: entities, their data, and relations between them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quern.plans.ir import QueryError

#: File formats that Spark reads and writes itself.
FORMATS = ("parquet", "orc", "json", "csv", "text", "avro")


@dataclass(frozen=True)
class Relation:
    """``name`` leads from an entity to ``target`` where ``parent_keys`` equal ``child_keys``. many: a list, else one.

    unique: at most one child has the keys (of a relation to one; if not, the first in the sub-query's order counts).
    """

    name: str
    target: str
    parent_keys: tuple[str, ...]
    child_keys: tuple[str, ...]
    many: bool = False
    unique: bool = True


@dataclass
class Entity:
    load: Callable[[SparkSession], DataFrame]
    relations: dict[str, Relation] = field(default_factory=dict)
    key: tuple[str, ...] = ()


class Catalog:
    """Entities by name. ``hooks``: what a custom ``$`` control does to the rows, as (df, value) -> df."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.entities, self.hooks = spark, {}, {}

    def add(self, name: str, source: DataFrame | Callable[[SparkSession], DataFrame], key: tuple[str, ...] = ()) -> Catalog:
        """An entity from a DataFrame or from what makes one; ``key`` breaks ties of order within a relation."""
        self.entities[name] = Entity(source if callable(source) else lambda _: source, key=key)
        return self

    def read(self, name: str, path: str, format: str = "parquet", key: tuple[str, ...] = (), **options: Any) -> Catalog:
        """An entity from files; a schema is read from them unless an option ``schema`` gives it."""
        if format not in FORMATS:
            raise QueryError(f"unknown format {format!r}")
        schema = options.pop("schema", None)

        def load(spark: SparkSession) -> DataFrame:
            nonlocal schema  # read from the files once; which files there are is looked up for each query
            reader = spark.read.format(format).options(**options)
            df = (reader.schema(schema) if schema is not None else reader).load(path)
            schema = df.schema
            return df

        return self.add(name, load, key)

    def relate(self, parent: str, name: str, target: str, keys: Mapping[str, str], many: bool = False, unique: bool = True) -> Catalog:
        """A relation by its keys, parent field to child field."""
        self.entity(parent).relations[name] = Relation(name, target, tuple(keys), tuple(keys.values()), many, unique)
        return self

    def hook(self, control: str, function: Callable[[DataFrame, Any], DataFrame]) -> Catalog:
        self.hooks[control] = function
        return self

    def entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise QueryError(f"unknown entity {name!r}; there are {', '.join(sorted(self.entities))}")
        return self.entities[name]

    def frame(self, name: str) -> DataFrame:
        return self.entity(name).load(self.spark)

    def relation(self, parent: str, name: str) -> Relation:
        relations = self.entity(parent).relations
        if name not in relations:
            raise QueryError(f"{parent!r} has no relation {name!r}; there are {', '.join(sorted(relations)) or 'none'}")
        return relations[name]


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = (), **options: Any) -> None:
    """A result to files."""
    if format not in FORMATS:
        raise QueryError(f"unknown format {format!r}")
    df.write.format(format).mode(mode).options(**options).partitionBy(*partition_by).save(path)
