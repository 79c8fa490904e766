"""From a query to a DataFrame: scan, filter, group, having, order and page, relations, projection.

Everything is declared; pushdown, pruning, join and aggregation strategies are Catalyst's.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.paths import quoted
from quern.operators.predicates import where
from quern.operators.relate import load
from quern.operators.shape import group, grouped_columns, is_grouped, order_of, page, paging, project
from quern.plans.ir import Query, QueryError
from quern.plans.walk import allow
from quern.sources.catalog import Catalog
from quern.sources.url import parse_url
from quern.streaming.guard import check


@dataclass(frozen=True)
class Result:
    """``df``: the rows. ``mode``: the output mode, of a stream."""

    df: DataFrame
    query: Query
    _unpaged: DataFrame
    mode: str | None = None

    def total(self) -> DataFrame:
        """One row, ``count``: how many rows there are without skip and limit."""
        return self._unpaged.agg(F.count("*").alias("count"))

    def count(self) -> int:
        return self.total().first()[0]


class Engine:
    """Runs queries over a catalog. policy: uses that each field may be put to (field -> uses or ``*``)."""

    def __init__(self, catalog: Catalog, null_mode: str = "sql", max_depth: int = 5, policy: Mapping[str, Iterable[str]] | None = None) -> None:
        self.catalog, self.null_mode, self.max_depth, self.policy = catalog, null_mode, max_depth, policy

    def query(self, entity: str, query: Query | Mapping | str) -> Result:
        """The result of a query (its text, dict or Query) over an entity."""
        query = parse_url(query) if isinstance(query, str) else Query.of(query)
        if self.policy is not None:
            allow(query, self.policy)
        controls = query.controls
        df = where(self.catalog.frame(entity), query.filter, self.null_mode)
        for key, value in controls.items():
            if key in self.catalog.hooks:
                df = self.catalog.hooks[key](df, value)
        mode = check(df, query)
        paging(controls)
        if is_grouped(query):
            if controls.get("$with"):
                raise QueryError("$with can't stand beside $groupBy or aggregates")
            groups = group(df, query, null_mode=self.null_mode)
            order = order_of(groups, controls.get("$sort"))
            df = page(groups.orderBy(*order) if order else groups, controls)
            return Result(df.select(*[F.col(quoted(c)) for c in grouped_columns(query)]), query, groups, mode)
        if controls.get("$having"):
            raise QueryError("$having needs $groupBy or aggregates")
        unpaged = df
        relations = [x.name for x in query.relations()]
        sort = controls.get("$sort") or {}
        if relations and (controls.get("$limit") is not None or controls.get("$skip")):
            sort = dict(sort) | {k: 1 for k in self.catalog.entity(entity).key if k not in sort}  # the same page wherever it is planned
        order = order_of(df, sort)
        if order:
            df = df.orderBy(*order)
        df = page(df, controls)
        if relations:
            df = load(df, query, entity, self.catalog, self.null_mode, self.max_depth)
            if order:  # joins don't keep it
                df = df.orderBy(*order_of(df, sort))
        return Result(project(df, controls.get("$select"), relations), query, unpaged, mode)


def check_aggregate(query: Query, dimensions: Iterable[str], measures: Iterable[str]) -> None:
    """Strict form of a grouped query: ``$groupBy`` of dimensions only, aggregates of measures or ``*``, no ``$with``."""
    dims, meas, controls = set(dimensions), set(measures), query.controls
    if not controls.get("$groupBy"):
        raise QueryError("$groupBy is required")
    if controls.get("$with"):
        raise QueryError("$with can't stand beside $groupBy")
    if bad := set(controls["$groupBy"]) - dims:
        raise QueryError(f"not dimensions: {', '.join(sorted(bad))}")
    for x in controls.get("$select") or ():
        name, known = (x["$field"], meas | {"*"}) if isinstance(x, Mapping) else (x, dims)
        if name not in known:
            raise QueryError(f"{name!r} is not a {'measure' if isinstance(x, Mapping) else 'dimension'}")
