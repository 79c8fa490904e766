"""Which queries can run over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quern.operators.shape import is_grouped
from quern.plans.ir import Query, QueryError


def check(df: DataFrame, query: Query) -> str | None:
    """The output mode of a query over a streaming DataFrame (None: it isn't one). Raises for what a stream can't do.

    Filters, projections and limits give ``append``; grouping, with ``$having`` and an order of groups, ``complete``.
    """
    if not df.isStreaming:
        return None
    controls, grouped = query.controls, is_grouped(query)
    for key, bad in (("$skip", bool(controls.get("$skip"))), ("$count", bool(controls.get("$count"))), ("$with", bool(controls.get("$with"))), ("$sort", bool(controls.get("$sort")) and not grouped)):
        if bad:
            raise QueryError(f"{key} can't be used on a stream" + " without grouping" * (key == "$sort"))
    return "complete" if grouped else "append"
