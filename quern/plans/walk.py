"""Walking filters, and what a query uses."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any, Protocol, TypeVar

from quern.plans.ir import LOGICAL, Query, QueryError, aggregate_name

R = TypeVar("R")


class Visitor(Protocol[R]):
    """What a filter is turned into, node by node."""

    def comparison(self, field: str, op: str, value: Any) -> R: ...

    def all_of(self, parts: list[R]) -> R: ...

    def any_of(self, parts: list[R]) -> R: ...

    def negated(self, part: R) -> R: ...


def is_leaf(value: Any) -> bool:
    """Whether a field's value is compared as it is: anything but an operator map or a list."""
    return not isinstance(value, (Mapping, list, tuple, set, frozenset))


def comparisons(node: Mapping[str, Any]) -> Iterable[tuple[str, str, Any]]:
    """(field, operator, value) of a node without logical keys; a bare value is an equality."""
    for field, value in node.items():
        if is_leaf(value):
            yield field, "$eq", value
        elif isinstance(value, Mapping):
            yield from ((field, op, x) for op, x in value.items())
        else:
            raise QueryError(f"{field} is given a list; use $in")


def walk(node: Mapping[str, Any] | None, visitor: Visitor[R]) -> R | None:
    """The visitor's result for a filter: None without one, a lone comparison as it is, otherwise joined by all_of."""
    if node is None:
        return None
    logical = [key for key in LOGICAL if key in node]
    if logical:
        if len(node) > 1:
            raise QueryError(f"{logical[0]} stands beside other keys: {sorted(node)}")
        key, inner = logical[0], node[logical[0]]
        if key == "$not":
            if not isinstance(inner, Mapping):
                raise QueryError("$not takes a filter")
            return visitor.negated(walk(inner, visitor))
        if not isinstance(inner, (list, tuple)):
            raise QueryError(f"{key} takes a list of filters")
        parts = [walk(x, visitor) for x in inner]
        return visitor.all_of(parts) if key == "$and" else visitor.any_of(parts)
    parts = [visitor.comparison(*x) for x in comparisons(node)]
    return parts[0] if len(parts) == 1 else visitor.all_of(parts)


class _Uses:
    """Collects (field, operator), giving nothing back."""

    def __init__(self, found: dict[str, set[str]], op: str | None = None) -> None:
        self.found, self.op = found, op

    def comparison(self, field, op, value):
        self.found.setdefault(field, set()).add(self.op or op)

    def all_of(self, parts):
        return None

    any_of = negated = all_of


def compute_insights(filter: Mapping[str, Any] | None = None, controls: Mapping[str, Any] | None = None) -> dict[str, set[str]]:
    """Fields by what is done with them: operators, ``$select``, function names, ``$groupBy``, ``$having``, ``$order``, ``$with``.

    A sort by an aggregate's name counts for the field that it aggregates. What a relation uses comes under
    ``relation.field``.
    """
    found: dict[str, set[str]] = {}
    controls = controls or {}
    walk(filter or {}, _Uses(found))
    named: dict[str, str] = {}

    def add(field: str, use: str) -> None:
        found.setdefault(field, set()).add(use)

    for entry in controls.get("$select") or ():
        if isinstance(entry, Mapping):
            add(entry["$field"], entry["$fn"])
            named[aggregate_name(entry)] = entry["$field"]
        else:
            add(entry, "$select")
    for field in controls.get("$groupBy") or ():
        add(field, "$groupBy")
    walk(controls.get("$having") or {}, _Uses(found, "$having"))
    for field in controls.get("$sort") or ():
        add(named.get(field, field), "$order")
    for entry in controls.get("$with") or ():
        relation = Query.of(entry)
        add(relation.name, "$with")
        for field, uses in get_insights(relation).items():
            for use in uses:
                add(f"{relation.name}.{field}", use)
    return found


def get_insights(query: Query) -> dict[str, set[str]]:
    """A query's insights; computed once and kept on it."""
    if query.insights is None:
        query.insights = compute_insights(query.filter, query.controls)
    return query.insights


def allow(query: Query, policy: Mapping[str, Iterable[str]]) -> None:
    """Raise QueryError for any use of a field that the policy (field -> uses, or ``*``) doesn't list."""
    for field, uses in get_insights(query).items():
        listed = set(policy.get(field, ()))
        if "*" not in listed and (extra := uses - listed):
            raise QueryError(f"{field} may not be used for {', '.join(sorted(extra))}")
