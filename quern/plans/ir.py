"""The query representation: plain dicts for filters and controls, held by a Query.

A filter is ``{field: value}``, ``{field: {op: value}}``, ``{"$and": [...]}``, ``{"$or": [...]}`` or ``{"$not": ...}``.
Controls are keyed ``$select``, ``$groupBy``, ``$having``, ``$sort``, ``$limit``, ``$skip``, ``$count``, ``$with``;
other ``$`` keys pass through.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date, datetime
from typing import Any

#: The operators of comparisons, the logical keys and the aggregate functions every engine knows.
COMPARISONS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$regex", "$exists")
LOGICAL = ("$and", "$or", "$not")
AGGREGATES = ("sum", "count", "avg", "min", "max")


class QuerySyntaxError(SyntaxError):
    """Query text that doesn't follow the grammar."""


class QueryError(ValueError):
    """A query that is well formed but can't be run: an unknown field, relation, operator or function, or a bad value."""


@dataclass(frozen=True)
class Regex:
    """A regular expression as a value: ``/pattern/flags``."""

    pattern: str
    flags: str = ""

    def __str__(self) -> str:
        return f"/{self.pattern}/{self.flags}"

    @classmethod
    def of(cls, value: Any) -> Regex:
        """From a Regex, a compiled pattern, ``/pattern/flags`` text, or text that is a pattern itself."""
        if isinstance(value, Regex):
            return value
        if isinstance(value, re.Pattern):
            return cls(value.pattern, "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if value.flags & f))
        if isinstance(value, str):
            whole = re.fullmatch(r"/((?:\\.|[^\\/])*)/([a-z]*)", value, re.S)
            return cls(whole[1], whole[2]) if whole else cls(value)
        raise QueryError(f"not a regular expression: {value!r}")


@dataclass
class Query:
    """A root query, or (with a name) a relation inside ``$with``."""

    filter: dict[str, Any] = field(default_factory=dict)
    controls: dict[str, Any] = field(default_factory=dict)
    insights: dict[str, set[str]] | None = None
    name: str | None = None

    @classmethod
    def of(cls, value: Query | Mapping[str, Any] | str) -> Query:
        """From a Query, its dict form, or a relation's bare name."""
        if isinstance(value, Query):
            return value
        if isinstance(value, str):
            return cls(name=value)
        if not isinstance(value, Mapping) or not set(value) <= {"filter", "controls", "insights", "name"}:
            raise QueryError(f"a query has filter, controls, insights and name: {value!r}")
        return cls(dict(value.get("filter") or {}), dict(value.get("controls") or {}), value.get("insights"), value.get("name"))

    @classmethod
    def from_json(cls, text: str) -> Query:
        """What ``to_json`` has written."""
        return cls.of(json.loads(text, object_hook=_from_json))

    def to_json(self) -> str:
        """The dict form as JSON. Patterns and moments are ``{"$pattern": …, "$flags": …}`` and ``{"$date": …}``, and come
        back as values; other values without a JSON form become their text."""
        return json.dumps(self.as_dict(), default=_to_json, ensure_ascii=False)

    def relations(self) -> list[Query]:
        return [Query.of(x) for x in self.controls.get("$with") or ()]

    def as_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"name": self.name} if self.name else {}
        controls = dict(self.controls)
        if "$with" in controls:
            controls["$with"] = [x.as_dict() for x in self.relations()]
        return out | {"filter": self.filter, "controls": controls}


def _to_json(value: Any) -> Any:
    if isinstance(value, (Regex, re.Pattern)):
        regex = Regex.of(value)
        return {"$pattern": regex.pattern, "$flags": regex.flags}
    if isinstance(value, date):
        return {"$date": value.isoformat()}
    return sorted(value) if isinstance(value, (set, frozenset)) else str(value)


def _from_json(value: dict[str, Any]) -> Any:
    if value.keys() == {"$pattern", "$flags"}:
        return Regex(value["$pattern"], value["$flags"])
    if value.keys() == {"$date"}:
        return datetime.fromisoformat(value["$date"]) if len(value["$date"]) > 10 else date.fromisoformat(value["$date"])
    return value


def aggregate_name(entry: Mapping[str, Any]) -> str:
    """The output column of an aggregate: its alias, or its function and field."""
    return entry.get("$as") or f"{entry['$fn']}_{'star' if entry['$field'] == '*' else entry['$field']}"
