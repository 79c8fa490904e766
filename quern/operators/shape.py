"""Projection, grouping, order and paging."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.aggregates import aggregate
from quern.functions.paths import quoted, resolve, without
from quern.operators.predicates import where
from quern.plans.ir import Query, QueryError, aggregate_name


def is_grouped(query: Query) -> bool:
    select = query.controls.get("$select")
    return bool(query.controls.get("$groupBy")) or isinstance(select, (list, tuple)) and any(isinstance(x, Mapping) for x in select)


def project(df: DataFrame, select: Any, keep: list[str] = ()) -> DataFrame:
    """``$select`` without aggregates: a list, a map with a 1 (those alone), or a map of zeros (all others). ``keep`` stays."""
    if not select:
        return df
    if isinstance(select, Mapping):
        if bad := [v for v in select.values() if v not in (0, 1)]:
            raise QueryError(f"$select maps fields to 0 or 1, not {bad[0]!r}")
        if not any(select.values()):
            for path in select:
                df = without(df, path)
            return df
        select = [f for f, on in select.items() if on]
    wanted = [resolve(df, f).column.alias(f) for f in dict.fromkeys(select)]
    return df.select(*wanted, *[F.col(quoted(c)) for c in keep if c not in select])


def group(df: DataFrame, query: Query, extra: dict[str, Column] | None = None, null_mode: str = "sql") -> DataFrame:
    """``$groupBy``, aggregates and ``$having``: all keys and aggregates, under their names. ``extra``: more keys.

    Without keys there is one row, even of no input; without aggregates the distinct keys.
    """
    controls = query.controls
    select = controls.get("$select") or []
    if isinstance(select, Mapping):
        raise QueryError("a grouped query takes $select as a list")
    keys = list(dict.fromkeys(controls.get("$groupBy") or []))
    calls = [x for x in select if isinstance(x, Mapping)]
    if loose := [x for x in select if not isinstance(x, Mapping) and x not in keys]:
        raise QueryError(f"{', '.join(loose)} must be in $groupBy or aggregated")
    names = [aggregate_name(x) for x in calls]
    if clash := {n for n in names if names.count(n) > 1 or n in keys}:
        raise QueryError(f"more than one column would be called {', '.join(sorted(clash))}")
    by = [c.alias(n) for n, c in (extra or {}).items()] + [resolve(df, k).column.alias(k) for k in keys]
    made = [aggregate(x["$fn"], None if x["$field"] == "*" else resolve(df, x["$field"]).column).alias(n) for x, n in zip(calls, names)]
    if not made:
        out = df.select(*by).distinct()
    else:
        out = df.groupBy(*by).agg(*made) if by else df.agg(*made)
    return where(out, controls.get("$having"), null_mode)


def grouped_columns(query: Query) -> list[str]:
    """What a grouped query gives, in order: its ``$select``, or its keys."""
    select = query.controls.get("$select")
    return [aggregate_name(x) if isinstance(x, Mapping) else x for x in select] if select else list(dict.fromkeys(query.controls["$groupBy"]))


def order_of(df: DataFrame, sort: Mapping[str, int] | None) -> list[Column]:
    out = []
    for f, direction in (sort or {}).items():
        if direction not in (1, -1):
            raise QueryError(f"$sort takes 1 or -1 for {f!r}, not {direction!r}")
        column = resolve(df, f).column
        out.append(column.asc() if direction == 1 else column.desc())
    return out


def paging(controls: Mapping[str, Any]) -> tuple[int, int | None]:
    """(skip, limit), both checked."""
    for key in ("$skip", "$limit"):
        value = controls.get(key)
        if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
            raise QueryError(f"{key} takes a whole number from 0: {value!r}")
    return controls.get("$skip") or 0, controls.get("$limit")


def page(df: DataFrame, controls: Mapping[str, Any]) -> DataFrame:
    skip, limit = paging(controls)
    if skip:
        df = df.offset(skip)
    return df if limit is None else df.limit(limit)
