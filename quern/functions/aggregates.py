"""Aggregate functions by name: Spark's own from an allow-list, and registered ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.plans.ir import QueryError

#: Spark aggregate functions of one argument.
BUILT_IN = frozenset("sum count avg min max mean stddev stddev_pop stddev_samp variance var_pop var_samp median mode approx_count_distinct first last any_value count_if skewness kurtosis bool_and bool_or every some bit_and bit_or bit_xor collect_list collect_set".split())
_OWN: dict[str, Callable[[Column], Column]] = {"count_distinct": F.count_distinct, "sum_distinct": F.sum_distinct}


def register(name: str, function: Callable[[Column], Column]) -> None:
    """Make ``name(field)`` mean ``function(column)`` in queries."""
    _OWN[name] = function


def aggregate(name: str, column: Column | None) -> Column:
    """The call's column; None stands for ``*``, which only count takes."""
    if column is None:
        if name != "count":
            raise QueryError(f"{name}(*) isn't an aggregate")
        return F.count("*")
    if name in _OWN:
        return _OWN[name](column)
    if name in BUILT_IN:
        return F.call_function(name, column)
    raise QueryError(f"unknown aggregate function {name!r}")
