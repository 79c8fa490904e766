"""Relation loading: rows of a related entity nested into those of its parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.paths import quoted, resolve
from quern.operators.predicates import where
from quern.operators.shape import group, grouped_columns, is_grouped, order_of, paging, project
from quern.plans.ir import Query, QueryError
from quern.sources.catalog import Catalog, Relation

#: Parents up to this many (by their $limit) are sent to the children's scan, so that only their children are read on.
FEW = 10_000


def load(df: DataFrame, query: Query, entity: str, catalog: Catalog, null_mode: str = "sql", depth: int = 5) -> DataFrame:
    """``df`` with a column for each relation of the query's ``$with``: a struct (null if there is none), or an array of
    structs in the sub-query's order (empty if there are none). A sub-query's paging counts per parent.

    Few parents by a ``$limit`` are sent to the children's scan; only of an entity with a key, since without one, ties
    could make another choice of parents there."""
    limit = query.controls.get("$limit") if catalog.entity(entity).key else None
    for relation in query.relations():
        if depth < 1:
            raise QueryError(f"relations are nested too deep at {relation.name!r}")
        how = catalog.relation(entity, relation.name)
        if relation.name in df.columns:
            raise QueryError(f"{entity!r} has a column {relation.name!r} of the relation's name")
        names = [f"_k{i}_{relation.name}" for i in range(len(how.parent_keys))]
        parents = [resolve(df, k).column for k in how.parent_keys]
        wanted = df.select(*[p.alias(n) for p, n in zip(parents, names)]).distinct() if limit is not None and limit <= FEW else None
        children = _children(relation, how, names, wanted, catalog, null_mode, depth)
        on = [p == children[n] for p, n in zip(parents, names)]
        df = df.join(children, on, "left").drop(*names)
        if how.many:
            empty = F.array().cast(df.schema[relation.name].dataType)
            df = df.withColumn(relation.name, F.coalesce(F.col(quoted(relation.name)), empty))
    return df


def _children(query: Query, how: Relation, names: list[str], wanted: DataFrame | None, catalog: Catalog, null_mode: str, depth: int) -> DataFrame:
    """One row per parent: its keys and the relation's column."""
    df = where(catalog.frame(how.target), query.filter, null_mode)
    keys: dict[str, Column] = {n: resolve(df, k).column for n, k in zip(names, how.child_keys)}
    if wanted is not None:
        df = df.join(F.broadcast(wanted), [c == wanted[n] for n, c in keys.items()], "left_semi")
    if is_grouped(query):
        if query.controls.get("$with"):
            raise QueryError("$with can't stand beside $groupBy or aggregates")
        df = group(df, query, keys, null_mode)
        columns, ties = grouped_columns(query), [k for k in query.controls.get("$groupBy") or []]
    else:
        relations = [x.name for x in query.relations()]
        df = load(df.withColumns(keys), Query(controls={"$with": query.controls.get("$with") or []}), how.target, catalog, null_mode, depth - 1)
        columns, ties = None, list(catalog.entity(how.target).key)
    order = order_of(df, query.controls.get("$sort")) + [F.col(quoted(t)) for t in ties if t not in (query.controls.get("$sort") or {})]
    skip, limit = paging(query.controls)
    ranked = bool(query.controls.get("$sort")) or skip or limit is not None or not how.many and not how.unique
    if ranked:
        order = order or [F.lit(1)]
        df = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
        if skip:
            df = df.filter(F.col("_rank") > skip)
        if limit is not None or not how.many:
            df = df.filter(F.col("_rank") <= skip + (1 if not how.many else limit))
    own = [*names, *(["_rank"] if ranked else [])]
    if columns is None:
        kept = project(df.drop(*own), query.controls.get("$select"), relations).columns
        shown = project(df, query.controls.get("$select"), [*relations, *own])
        columns = kept
    else:
        shown = df
    value = F.struct(*[F.col(quoted(c)) for c in columns])
    if not how.many:
        return shown.select(*names, value.alias(query.name))
    if ranked:
        listed = F.transform(F.sort_array(F.collect_list(F.struct("_rank", value.alias("_value")))), lambda x: x["_value"])
    else:
        listed = F.collect_list(value)
    return shown.groupBy(*names).agg(listed.alias(query.name))
