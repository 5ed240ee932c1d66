"""From expression trees to Spark columns and key sources.

A condition is one of: a predicate (a column), a key source (search, similarity, graph walk) that
becomes a left semi join, or a plain value, which a query ignores.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphmill.errors import EvaluationError
from graphmill.functions.content import like, triple_key
from graphmill.plans.expressions import Call, Items, Literal, Mapping, Node, Quoted, Symbol, to_text, to_value

KEY = {"knowledge": "name", "statement": "triple"}
COLUMNS = {"subject", "predicate", "object", "triple", "name", "created_at", "tr_start", "tr_end"}
TIMES = {"created_at", "tr_start", "tr_end"}
WILDCARD = "$*"
COMPARISONS = {"$eq": operator.eq, "$ne": operator.ne, "$gt": operator.gt, "$lt": operator.lt, "$gte": operator.ge, "$lte": operator.le}


@dataclass(frozen=True)
class Predicate:
    column: Column


@dataclass(frozen=True)
class Search:
    text: str


@dataclass(frozen=True)
class Similar:
    text: str


@dataclass(frozen=True)
class Walk:
    subject: str
    predicate: str | None
    depth: int


@dataclass(frozen=True)
class Value:
    value: Any


Condition = Predicate | Search | Similar | Walk | Value


@dataclass
class Options:
    limit: int = 100
    offset: int = 0
    catalog: str | None = None


@dataclass
class Query:
    """A whole query: which table, what must hold, and how much of it."""

    target: str
    predicates: list[Column] = field(default_factory=list)
    sources: list[Search | Similar | Walk] = field(default_factory=list)
    options: Options = field(default_factory=Options)


def json_field(name: str) -> Column:
    """A field of the content as text; dots go deeper.  JSON null and malformed content give null."""
    if not name or "'" in name:
        raise EvaluationError(f"not a field name: {name!r}")
    return F.get_json_object("content", f"$.{name}")


def field_column(name: str) -> Column:
    bare = name.lstrip("$")
    return F.col(bare) if bare in COLUMNS else json_field(bare)


def _name(node: Node) -> str:
    if isinstance(node, Symbol):
        return node.name
    if isinstance(node, Literal) and isinstance(node.value, str):
        return node.value
    raise EvaluationError(f"expected a field name, got {to_text(to_value(node))}")


def _text(node: Node) -> str:
    return to_text(to_value(node))


def _arity(call: Call, n: int) -> None:
    if len(call.args) != n:
        raise EvaluationError(f"{call.op} takes {n} argument{'s' * (n != 1)}, not {len(call.args)}")


def _all(columns: list[Column]) -> Column:
    return reduce(operator.and_, columns) if columns else F.lit(True)


def _pattern(node: Node, what: str) -> str | None:
    """A string, or None for the wildcard."""
    value = to_value(node)
    if not isinstance(value, str):
        raise EvaluationError(f"{what} must be a string or {WILDCARD}")
    return None if value == WILDCARD and isinstance(node, Symbol | Literal) else value


def condition(node: Node) -> Condition:
    match node:
        case Literal(value):
            return Value(value)
        case Quoted(inner):
            return Value(to_value(inner))
        case Symbol() | Items() | Mapping():
            raise EvaluationError(f"{to_text(to_value(node))} is no condition")
    return _operator(node)


def _predicates(call: Call) -> list[Column]:
    found = [condition(a) for a in call.args]
    for part in found:
        if not isinstance(part, Predicate):
            raise EvaluationError(f"{call.op} takes predicates, not {type(part).__name__.lower()}")
    return [p.column for p in found]


def _operator(call: Call) -> Condition:
    op, args = call.op, call.args
    if op in KEY_OPERATORS:
        return condition(args[0]) if len(args) == 1 else Predicate(F.lit(True))
    if op == "$and":
        return Predicate(_all(_predicates(call)))
    if op == "$or":
        parts = _predicates(call)
        return Predicate(reduce(operator.or_, parts) if parts else F.lit(True))
    if op == "$not":
        _arity(call, 1)
        return Predicate(~_predicates(call)[0])
    if op in COMPARISONS:
        if len(args) == 1:
            return condition(args[0])
        _arity(call, 2)
        return Predicate(COMPARISONS[op](field_column(_name(args[0])), F.lit(_text(args[1]))))
    if op == "$contains":
        _arity(call, 2)
        return Predicate(like(json_field(_name(args[0])), f"%{_text(args[1])}%"))
    if op == "$like":
        _arity(call, 2)
        column = field_column(_name(args[0]))
        return Predicate(like(column.cast("string") if _name(args[0]).lstrip("$") in TIMES else column, _text(args[1])))
    if op == "$content":
        _arity(call, 1)
        if not isinstance(args[0], Mapping):
            raise EvaluationError("$content takes an object")
        return Predicate(_all([json_field(k) == to_text(v) for k, v in args[0].value.items()]))
    if op in ("$search", "$similar"):
        if not args:
            raise EvaluationError(f"{op} takes a text")
        return (Search if op == "$search" else Similar)(_text(args[0]))
    if op == "$k-hop":
        _arity(call, 3)
        subject, depth = to_value(args[0]), to_value(args[2])
        if not isinstance(subject, str):
            raise EvaluationError("the subject of $k-hop must be a string")
        if not isinstance(depth, int) or isinstance(depth, bool) or depth <= 0:
            raise EvaluationError("the depth of $k-hop must be a positive integer")
        return Walk(subject, _pattern(args[1], "the predicate of $k-hop"), depth)
    if op == "$triple":
        _arity(call, 3)
        parts = [_pattern(a, "each part of $triple") for a in args]
        if all(p is None for p in parts):
            raise EvaluationError("$triple needs at least one part that is no wildcard")
        if all(p is not None for p in parts):
            return Predicate(F.col("triple") == triple_key(*parts))
        return Predicate(_all([F.col(c) == p for c, p in zip(("subject", "predicate", "object"), parts) if p is not None]))
    raise EvaluationError(f"unknown operator {op}")


KEY_OPERATORS = {"$knowledge": "knowledge", "$statement": "statement"}


def _options(meta: dict) -> Options:
    options = Options()
    if isinstance(meta.get("catalog"), str):
        options.catalog = meta["catalog"]
    for name in ("limit", "offset"):
        value = meta.get(name)
        if isinstance(value, int) and not isinstance(value, bool):
            setattr(options, name, value)
    return options


def compile_query(node: Node) -> Query:
    """A whole query; the root must be ``$knowledge`` or ``$statement``."""
    if not isinstance(node, Call) or node.op not in KEY_OPERATORS:
        raise EvaluationError("a query begins with $knowledge or $statement")
    query = Query(KEY_OPERATORS[node.op], options=_options(node.meta))
    for arg in node.args:
        part = condition(arg)
        if isinstance(part, Predicate):
            query.predicates.append(part.column)
        elif isinstance(part, Walk) and query.target != "statement":
            raise EvaluationError("$k-hop walks statements only")
        elif not isinstance(part, Value):
            query.sources.append(part)
    return query
