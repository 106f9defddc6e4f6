"""A strict gate for SQL: Spark's own parser, and a walk of its unresolved plan.

Accepted are: columns or ``*`` with aliases; one relation, or an inner join of two
on one equality; one ``=`` or ``BETWEEN`` with literals; one grouping key with one
of SUM, COUNT and AVG of a column. All else is a SQLSyntaxError in strict mode;
Spark runs it in permissive mode.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

#: Words that can't be aliases in strict mode.
RESERVED = frozenset("where left right full inner outer cross semi anti join on group order having limit union select from between and".split())


class SQLSyntaxError(ValueError):
    """SQL outside the strict surface."""


@dataclass(frozen=True)
class Item:
    """A column or an aggregate of the select list."""

    column: str
    alias: str | None = None
    function: str | None = None


@dataclass(frozen=True)
class Predicate:
    """``column = value`` or ``column BETWEEN lower AND upper``."""

    column: str
    values: tuple[Any, ...]

    @property
    def kind(self) -> str:
        return "eq" if len(self.values) == 1 else "between"


@dataclass(frozen=True)
class Query:
    relations: tuple[str, ...]
    items: tuple[Item, ...]
    on: tuple[str, str] | None = None
    where: Predicate | None = None
    group: str | None = None
    aliases: tuple[str, ...] = field(default=())


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _children(node) -> list:
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _fail(what: str):
    raise SQLSyntaxError(what)


def _column(e) -> str:
    if _name(e) != "UnresolvedAttribute":
        _fail(f"a column is asked for, not {e.toString()}")
    return ".".join(_list(e.nameParts()))


def _literal(e) -> Any:
    if _name(e) == "UnaryMinus":
        return -_literal(_children(e)[0])
    if _name(e) != "Literal" or e.value() is None:
        _fail(f"a literal is asked for, not {e.toString()}")
    kind, text = e.dataType().typeName(), str(e.value())
    if kind == "boolean":
        _fail("there are no boolean literals")
    return text if kind == "string" else float(text) if kind.startswith(("decimal", "double", "float")) else int(text)


def _function(e) -> tuple[str, list] | None:
    if _name(e) != "UnresolvedFunction":
        return None
    if e.isDistinct():
        _fail("DISTINCT isn't allowed")
    return ".".join(_list(e.nameParts())).lower(), _children(e)


def _predicate(e) -> Predicate:
    if _name(e) == "EqualTo":
        left, right = _children(e)
        return Predicate(_column(left), (_literal(right),))
    if (f := _function(e)) and f[0] == "between" and len(f[1]) == 3:
        return Predicate(_column(f[1][0]), (_literal(f[1][1]), _literal(f[1][2])))
    _fail(f"one = or BETWEEN is allowed, not {e.toString()}")


def _item(e) -> Item:
    kind = _name(e)
    if kind == "UnresolvedStar":
        return Item("*")
    if kind == "UnresolvedAlias":
        return _item(_children(e)[0])
    if kind == "Alias":
        inner = _item(_children(e)[0])
        return Item(inner.column, e.name(), inner.function)
    if f := _function(e):
        if f[0] not in ("sum", "count", "avg") or len(f[1]) != 1:
            _fail(f"no such aggregate: {e.toString()}")
        return Item(_column(f[1][0]), None, f[0])
    return Item(_column(e))


def _relation(node) -> tuple[str, str]:
    alias = None
    if _name(node) == "SubqueryAlias":
        alias = node.alias()
        if alias.lower() in RESERVED:
            _fail(f"{alias} can't be an alias")
        node = _children(node)[0]
    if _name(node) != "UnresolvedRelation":
        _fail("one table, or a join of two, is allowed")
    table = ".".join(_list(node.multipartIdentifier()))
    return table, alias or table


def parse_sql(sql: str, spark: SparkSession | None = None) -> Query:
    """The query, or SQLSyntaxError if it lies outside the strict surface."""
    spark = spark or SparkSession.active()
    try:
        node = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise SQLSyntaxError(str(e).split("\n")[0]) from None
    group = None
    if _name(node) == "Aggregate":
        keys = _list(node.groupingExpressions())
        if len(keys) != 1:
            _fail("one grouping key is allowed")
        group = _column(keys[0])
        items = [_item(e) for e in _list(node.aggregateExpressions())]
    elif _name(node) == "Project":
        items = [_item(e) for e in _list(node.projectList())]
    else:
        _fail(f"{_name(node)} isn't allowed")
    calls = [i for i in items if i.function]
    if (group is None and calls) or (group is not None and len(calls) != 1):
        _fail("one aggregate with GROUP BY, or none without, is allowed")
    if group is not None and any(not i.function and i.column != group for i in items):
        _fail("beside the aggregate only the grouping key is allowed")
    if any(i.column == "*" for i in items) and len(items) > 1:
        _fail("* stands alone")
    node, where, on = _children(node)[0], None, None
    if _name(node) == "Filter":
        where, node = _predicate(node.condition()), _children(node)[0]
    if _name(node) == "Join":
        left, right = map(_relation, _children(node))
        condition = node.condition()
        if _name(node.joinType()) != "Inner" or condition.isEmpty() or _name(condition.get()) != "EqualTo":
            _fail("an inner join on one equality is allowed")
        on = tuple(_column(e) for e in _children(condition.get()))
        if left[1] == right[1]:
            _fail("both sides need different aliases")
        relations = (left, right)
    else:
        relations = (_relation(node),)
    known = {a for _, a in relations}
    for c in [*(i.column for i in items), *(on or ()), *([where.column] if where else ()), *([group] if group else ())]:
        if "." in c and c.rsplit(".", 1)[0] not in known:
            _fail(f"unknown alias in {c}")
    return Query(tuple(t for t, _ in relations), tuple(items), on, where, group, tuple(a for _, a in relations))
