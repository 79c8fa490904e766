"""A query engine on Spark: compact URL or dict queries, compiled to DataFrames."""

from quern.functions.aggregates import register
from quern.plans.compile import Engine, Result, check_aggregate
from quern.plans.ir import Query, QueryError, QuerySyntaxError, Regex
from quern.plans.walk import allow, compute_insights, get_insights, is_leaf, walk
from quern.sources.catalog import Catalog, Relation, write
from quern.sources.lexer import lex
from quern.sources.url import parse_filter, parse_url
from quern.sources.url_builder import build_url

__all__ = ["Catalog", "Engine", "Query", "QueryError", "QuerySyntaxError", "Regex", "Relation", "Result", "allow", "build_url", "check_aggregate", "compute_insights", "get_insights", "is_leaf", "lex", "parse_filter", "parse_url", "register", "walk", "write"]
