"""Filters as Boolean columns, or as SQL text."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import date, datetime
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quern.functions.literals import Unfit, literal
from quern.functions.paths import Field, resolve
from quern.plans.ir import COMPARISONS, QueryError, Regex
from quern.plans.walk import walk

_ORDER = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
NULL_MODES = ("sql", "document")


class ToColumn:
    """Visitor that lowers a filter over a DataFrame.

    null_mode ``sql``: a comparison with a null field is unknown, and so is its negation. ``document``: a null field
    is just not equal, so ``$ne``, ``$nin`` and ``$not`` hold for it.
    """

    def __init__(self, df: DataFrame, null_mode: str = "sql") -> None:
        if null_mode not in NULL_MODES:
            raise QueryError(f"null_mode is one of {NULL_MODES}")
        self.df, self.document = df, null_mode == "document"

    def comparison(self, field: str, op: str, value: Any) -> Column:
        if op not in COMPARISONS:
            raise QueryError(f"unsupported operator {op!r} on {field!r}")
        at = resolve(self.df, field)
        if op == "$exists":
            if not isinstance(value, bool):
                raise QueryError("$exists takes true or false")
            return at.column.isNotNull() if value else at.column.isNull()
        if value is None and op in ("$eq", "$ne"):
            return at.column.isNull() if op == "$eq" else at.column.isNotNull()
        if isinstance(at.type, ArrayType):
            return self._any_element(at, field, op, value)
        return self._scalar(at, field, op, value)

    def _any_element(self, at: Field, field: str, op: str, value: Any) -> Column:
        """A comparison with an array holds if it does for one element; a negated one if for none."""
        plain = {"$ne": "$eq", "$nin": "$in"}.get(op, op)
        found = F.exists(at.column, lambda x: F.coalesce(self._scalar(Field(x, at.type.elementType), field, plain, value), F.lit(False)))
        if plain == op:
            return found
        return ~F.coalesce(found, F.lit(False)) if self.document else ~found

    def _scalar(self, at: Field, field: str, op: str, value: Any) -> Column:
        column = at.column
        if isinstance(value, (Regex, re.Pattern)) and op in ("$eq", "$ne", "$regex"):
            return self._negated(matches(column, value)) if op == "$ne" else matches(column, value)
        if op == "$regex":
            return matches(column, value)
        if op in ("$in", "$nin"):
            return self._listed(at, field, op, value)
        try:
            fit = literal(value, at.type)
        except Unfit:
            if op in _ORDER:
                raise QueryError(f"{field} ({at.type.simpleString()}) has no order with {value!r}") from None
            same = F.lit(False)
            return same if op == "$eq" else F.lit(True) if self.document else column.isNotNull()
        if op == "$eq":
            return column == fit
        if op == "$ne":
            return ~column.eqNullSafe(fit) if self.document else column != fit
        return getattr(column, _ORDER[op])(fit)

    def _listed(self, at: Field, field: str, op: str, values: Any) -> Column:
        if not isinstance(values, (list, tuple, set, frozenset)):
            raise QueryError(f"{op} takes a list, not {values!r}")
        column, known, null, patterns = at.column, [], False, []
        for x in values:
            if x is None:
                null = True
            elif isinstance(x, (Regex, re.Pattern)):
                patterns.append(matches(column, x))
            else:
                try:
                    known.append(literal(x, at.type))
                except Unfit:
                    pass
        if op == "$in":
            parts = ([column.isin(known)] if known else []) + patterns + ([column.isNull()] if null else [])
            return reduce(or_, parts) if parts else F.lit(False)
        if not values:
            return F.lit(True)
        parts = [self._negated(p) for p in ([column.isin(known)] if known else []) + patterns]
        if null or not parts and not self.document:
            parts.append(column.isNotNull())
        return reduce(and_, parts) if parts else F.lit(True)

    def _negated(self, part: Column) -> Column:
        return ~F.coalesce(part, F.lit(False)) if self.document else ~part

    def all_of(self, parts: list[Column]) -> Column:
        return reduce(and_, parts) if parts else F.lit(True)

    def any_of(self, parts: list[Column]) -> Column:
        return reduce(or_, parts) if parts else F.lit(False)

    def negated(self, part: Column) -> Column:
        return self._negated(part)


def java_pattern(value: Any) -> str:
    """A Java regular expression with its flags inside; flags that only steer repeated matching are dropped."""
    regex = Regex.of(value)
    unknown = set(regex.flags) - set("imsuxgy")
    if unknown:
        raise QueryError(f"unknown flags {''.join(sorted(unknown))!r} of {regex}")
    flags = "".join(c for c in "imsux" if c in regex.flags)
    return (f"(?{flags})" if flags else "") + regex.pattern


def matches(column: Column, value: Any) -> Column:
    """Whether the pattern is found anywhere in the column's text."""
    return column.cast("string").rlike(java_pattern(value))


def where(df: DataFrame, filter: Mapping[str, Any] | None, null_mode: str = "sql") -> DataFrame:
    return df.filter(walk(filter, ToColumn(df, null_mode))) if filter else df


class ToSql:
    """Visitor that renders a filter as SQL text, literals quoted."""

    _SIGN = {"$eq": "=", "$ne": "<>", "$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}

    def __init__(self, quote: str = '"') -> None:
        self.quote = quote

    def _name(self, field: str) -> str:
        return ".".join(self.quote + p.replace(self.quote, self.quote * 2) + self.quote for p in field.split("."))

    def literal(self, value: Any) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).upper()
        if isinstance(value, datetime):
            return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
        if isinstance(value, date):
            return f"DATE '{value.isoformat()}'"
        if isinstance(value, (int, float)):
            return repr(value)
        return "'" + str(value).replace("'", "''") + "'"

    def comparison(self, field: str, op: str, value: Any) -> str:
        name = self._name(field)
        if op == "$exists":
            return f"{name} IS {'NOT ' if value else ''}NULL"
        if value is None and op in ("$eq", "$ne"):
            return f"{name} IS {'NOT ' if op == '$ne' else ''}NULL"
        if op == "$regex" or isinstance(value, (Regex, re.Pattern)):
            found = f"regexp_matches({name}, {self.literal(java_pattern(value))})"
            return f"NOT {found}" if op == "$ne" else found
        if op in ("$in", "$nin"):
            known, null = [self.literal(x) for x in value if x is not None], None in value
            if op == "$in":
                parts = ([f"{name} IN ({', '.join(known)})"] if known else []) + ([f"{name} IS NULL"] if null else [])
                return f"({' OR '.join(parts)})" if parts else "FALSE"
            parts = ([f"{name} NOT IN ({', '.join(known)})"] if known else []) + ([f"{name} IS NOT NULL"] if null else [])
            return f"({' AND '.join(parts)})" if parts else "TRUE"
        if op not in self._SIGN:
            raise QueryError(f"unsupported operator {op!r} on {field!r}")
        return f"{name} {self._SIGN[op]} {self.literal(value)}"

    def all_of(self, parts: list[str]) -> str:
        return "(" + " AND ".join(parts) + ")" if parts else "TRUE"

    def any_of(self, parts: list[str]) -> str:
        return "(" + " OR ".join(parts) + ")" if parts else "FALSE"

    def negated(self, part: str) -> str:
        return f"(NOT {part})"


def sql_text(filter: Mapping[str, Any] | None) -> str:
    return walk(filter, ToSql()) if filter else "TRUE"
