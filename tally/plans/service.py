"""Running and explaining SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate
from .sqlgate import Query, SQLSyntaxError, parse_sql


#: Names of the steps.
SCAN, JOIN, EQUAL, RANGE, GROUP, PROJECT = "table_scan", "sort_merge_join", "equality_index", "range_index_binary_search", "hash_group_by", "project"


def explain(sql: str, spark: SparkSession | None = None) -> list[str]:
    """A query's steps by name: the access path of its filter, its join, grouping and projection."""
    q = parse_sql(sql, spark)
    steps = [f"{SCAN}({q.relations[0]})"]
    if q.on:
        steps.append(f"{JOIN}({', '.join(q.relations)})")
    elif q.where:
        steps.append(f"{EQUAL if q.where.kind == 'eq' else RANGE}({q.where.column})")
    return [*steps, GROUP if q.group else PROJECT]


def physical_steps(df: DataFrame) -> list[str]:
    """The operators of the physical plan, from the top, as Catalyst names them."""
    names, plan = [], df._jdf.queryExecution().sparkPlan()
    stack = [plan]
    while stack:
        node = stack.pop()
        names.append(node.nodeName())
        below = node.children()
        stack += [below.apply(i) for i in reversed(range(below.size()))]
    return names


def execute(sql: str, spark: SparkSession | None = None, strict: bool = True) -> DataFrame:
    """The query's lazy result; columns are named as written. SUM is a double in strict mode."""
    spark = spark or SparkSession.active()
    if not strict:
        return spark.sql(sql)
    return _build(spark, parse_sql(sql, spark))


def _build(spark: SparkSession, q: Query) -> DataFrame:
    sides = [spark.table(t).alias(a) for t, a in zip(q.relations, q.aliases, strict=True)]
    df = sides[0] if len(sides) == 1 else sides[0].join(sides[1], F.col(q.on[0]) == F.col(q.on[1]))
    if q.where:
        at = F.col(q.where.column)
        df = df.where(at == F.lit(q.where.values[0]) if q.where.kind == "eq" else at.between(*q.where.values))
    if q.group:
        call = next(i for i in q.items if i.function)
        flat = df.select(F.col(q.group).alias(q.group), F.col(call.column).alias("__value"))
        out = aggregate.aggregate(flat, q.group, call.function, "__value", call.alias or f"{call.function}({call.column})")
        return out
    if q.items == (replace(q.items[0], column="*"),) and q.items[0].column == "*":
        if len(sides) == 1:
            return df.select("*")
        both = zip(("left", "right"), q.aliases, q.relations, strict=True)
        return df.select(*[F.col(f"{a}.`{c}`").alias(f"{side}.{c}") for side, a, t in both for c in spark.table(t).columns])
    return df.select(*[F.col(i.column).alias(i.alias or i.column) for i in q.items])


def query(sql: str, spark: SparkSession | None = None, strict: bool = True) -> dict:
    """What a query service answers: success, plan and rows, or an error. Rows are collected here, at the edge."""
    try:
        return {"success": True, "plan": explain(sql, spark) if strict else physical_steps(execute(sql, spark, False)), "rows": [r.asDict() for r in execute(sql, spark, strict).collect()]}
    except (SQLSyntaxError, KeyError, ValueError, PySparkException) as e:
        return {"success": False, "error": str(e)}
