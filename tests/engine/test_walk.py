"""Walking filters, and insights."""

import re
from datetime import date
from decimal import Decimal
from uuid import uuid4

import pytest

from quern import Query, QueryError, Regex, allow, compute_insights, get_insights, is_leaf, parse_url, walk
from quern.operators.predicates import sql_text


class Recorder:
    def __init__(self):
        self.calls = []

    def comparison(self, *x):
        self.calls.append(x)
        return x[0] + x[1]

    def all_of(self, parts):
        return ("and", *parts)

    def any_of(self, parts):
        return ("or", *parts)

    def negated(self, part):
        return ("not", part)


@pytest.mark.parametrize(
    "filter,expected",
    [
        (None, None),
        ({}, ("and",)),
        ({"a": 1}, "a$eq"),
        ({"a": None}, "a$eq"),
        ({"a": 1, "b": {"$gt": 2, "$lt": 3}}, ("and", "a$eq", "b$gt", "b$lt")),
        ({"$or": [{"a": 1}, {"$not": {"b": {"$in": [1]}}}]}, ("or", "a$eq", ("not", "b$in"))),
        ({"$and": []}, ("and",)),
        ({"$and": [{}, {"a": {"$foo": 1}}]}, ("and", ("and",), "a$foo")),
    ],
)
def test_walk(filter, expected):
    assert walk(filter, Recorder()) == expected


@pytest.mark.parametrize("bad", [{"$and": [{"a": 1}], "b": 1}, {"$and": None}, {"$not": [1]}, {"a": [1, 2]}, {"$or": {"a": 1}}])
def test_malformed_filters_are_refused(bad):
    with pytest.raises(QueryError):
        walk(bad, Recorder())


def test_leaves():
    assert all(map(is_leaf, [None, 1, 1.5, "x", True, date.today(), Decimal(1), uuid4(), b"x", Regex("a"), re.compile("a")]))
    assert not any(map(is_leaf, [{}, {"$gt": 1}, [], (1,)]))


def test_insights_of_text_and_of_dicts_agree():
    text = "a>1&b{1}&!(c~=/x/)&$select=sum(amount):total,region&$groupBy=region&$having=total>5&$sort=-total,region&$with=owner,tasks(x=1&$with=comments(body~=Great))"
    expected = {
        "a": {"$gt"}, "b": {"$in"}, "c": {"$regex"}, "amount": {"sum", "$order"}, "region": {"$select", "$groupBy", "$order"}, "total": {"$having"},
        "owner": {"$with"}, "tasks": {"$with"}, "tasks.x": {"$eq"}, "tasks.comments": {"$with"}, "tasks.comments.body": {"$regex"},
    }
    query = parse_url(text)
    assert query.insights == expected
    assert compute_insights(query.filter, query.as_dict()["controls"]) == expected
    assert query.relations()[1].insights == {"x": {"$eq"}, "comments": {"$with"}, "comments.body": {"$regex"}}


def test_insights_are_computed_once():
    query = Query({"a": 1}, {"$select": {"x": 0}, "$with": ["p"]})
    assert get_insights(query) is get_insights(query) and query.insights == {"a": {"$eq"}, "x": {"$select"}, "p": {"$with"}}
    assert compute_insights({}, {"$select": [{"$fn": "count", "$field": "*"}]}) == {"*": {"count"}}
    assert compute_insights({}, {"$select": [{"$fn": "sum", "$field": "m"}], "$sort": {"sum_m": 1}}) == {"m": {"sum", "$order"}}


def test_policies():
    query = parse_url("a=1&b>2&$select=c")
    allow(query, {"a": ["$eq"], "b": "*", "c": ["$select"]})
    with pytest.raises(QueryError):
        allow(query, {"a": ["$eq"], "b": ["$lt"], "c": ["$select"]})


def test_sql_text():
    assert sql_text({"$or": [{"a": 1, "b": {"$ne": None}}, {"$not": {"c": {"$in": ["x'y", None]}}}]}) == """(("a" = 1 AND "b" IS NOT NULL) OR (NOT ("c" IN ('x''y') OR "c" IS NULL)))"""
    assert sql_text({"a": {"$regex": "/x/i"}}) == "regexp_matches(\"a\", '(?i)x')" and sql_text({}) == "TRUE"
