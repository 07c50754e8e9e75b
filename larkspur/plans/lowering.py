"""SELECT statements to DataFrames: the one place where plans are built.

Only the logical plan is declared here. Which side of a join is broadcast, how aggregates are
split and what is pushed into the scan is left to Catalyst and adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import EngineError, missing_column
from larkspur.functions.types import NUMERIC, Literal, kind_of
from larkspur.plans.syntax import Aggregate, ColumnRef, Comparison, Condition, InSubquery, Join, Select

#: What Spark takes as the sum of LIMIT and OFFSET.
MOST_ROWS = (1 << 31) - 1

Resolve = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Field:
    """A column of an intermediate result: where it comes from and under which name the DataFrame has it."""

    table: str | None
    column: str
    name: str
    type: T.DataType


class Scope:
    """Resolves references against fields."""

    def __init__(self, fields: list[Field]):
        self.fields = fields

    def find(self, ref: ColumnRef) -> Field:
        found = [f for f in self.fields if f.column == ref.column and ref.table in (None, f.table)]
        if not found:
            raise missing_column(ref.column, ref.table)
        if len(found) > 1:
            raise EngineError(f"Column reference '{ref}' is ambiguous")
        return found[0]

    def operand(self, value: ColumnRef | Literal) -> tuple[Column, int | None]:
        """The value and its kind; NULL has none."""
        if isinstance(value, Literal):
            return value.column(), value.kind
        field = self.find(value)
        return F.col(field.name), kind_of(field.type)


_OPERATORS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def comparison(term: Comparison, scope: Scope) -> Column:
    """A comparison. Values of different kinds are never equal and ordered by their kinds, so that it is
    a constant where both are present; no cast can fail."""
    (left, left_kind), (right, right_kind) = scope.operand(term.left), scope.operand(term.right)
    if left_kind is None or right_kind is None:
        return F.lit(None).cast("boolean")
    apply = _OPERATORS[term.op]
    if left_kind != right_kind:
        return F.when(left.isNotNull() & right.isNotNull(), F.lit(bool(apply(left_kind, right_kind))))
    return apply(left, right)


def predicate(terms: Condition, scope: Scope) -> Column:
    """A conjunction without subqueries, as UPDATE, DELETE and CHECK have it."""
    out = None
    for term in terms:
        if not isinstance(term, Comparison):
            raise EngineError("WHERE clause must be a comparison expression")
        one = comparison(term, scope)
        out = one if out is None else out & one
    return F.lit(True) if out is None else out


def scope_of(df: DataFrame, table: str) -> Scope:
    """Scope of a DataFrame whose columns keep their names."""
    return Scope([Field(table, f.name, f"`{f.name.replace('`', '``')}`", f.dataType) for f in df.schema])


def _renamed(df: DataFrame, table: str, mark: str) -> tuple[DataFrame, list[Field]]:
    """The table with names of its own for all columns, so that joins are never ambiguous."""
    fields = [Field(table, f.name, f"{mark}{k}", f.dataType) for k, f in enumerate(df.schema)]
    return df.toDF(*[f.name for f in fields]), fields


def _source(select: Select, resolve: Resolve, null_safe: bool) -> tuple[DataFrame, list[Field]]:
    if not isinstance(select.source, Join):
        return _renamed(resolve(select.source), select.source, "l")
    join = select.source
    left, left_fields = _renamed(resolve(join.left), join.left, "l")
    right, right_fields = _renamed(resolve(join.right), join.right, "r")
    if join.left == join.right:  # each side of a self-join has a schema of its own
        a, b = Scope(left_fields).find(join.left_on), Scope(right_fields).find(join.right_on)
    else:
        scope = Scope(left_fields + right_fields)
        a, b = scope.find(join.left_on), scope.find(join.right_on)
    if a not in left_fields or b not in right_fields:
        raise EngineError(f"JOIN must compare a column of '{join.left}' with one of '{join.right}', in this order")
    x, y = F.col(a.name), F.col(b.name)
    if kind_of(a.type) != kind_of(b.type):
        on = F.lit(False)
    else:
        on = x.eqNullSafe(y) if null_safe else x == y
    return left.join(right, on, "inner"), left_fields + right_fields


def _member(df: DataFrame, term: InSubquery, scope: Scope, resolve: Resolve) -> DataFrame:
    """``value IN (subquery)`` as a left semi join."""
    inner = lower(term.query, resolve)
    if len(inner.columns) != 1:
        raise EngineError("Subquery must return exactly one column")
    value, kind = scope.operand(term.value)
    inner = inner.toDF("__member")
    if kind is None or kind != kind_of(inner.schema[0].dataType):
        return df.filter(F.lit(False))
    return df.join(inner, value == F.col("__member"), "left_semi")


def _aggregate(item: Aggregate, scope: Scope) -> Column:
    if item.target is None:
        return F.count(F.lit(1))
    field = scope.find(item.target)
    value = F.col(field.name)
    if item.func in ("SUM", "AVG"):
        if kind_of(field.type) != NUMERIC:
            raise EngineError("Aggregate expects numeric values")
        value = value.cast("double")
    return {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[item.func](value)


def _grouped(df: DataFrame, select: Select, scope: Scope, label) -> tuple[DataFrame, list[tuple[Field, str]]]:
    if select.items is None:
        raise EngineError("SELECT * cannot be used with GROUP BY or aggregates")
    keys = [scope.find(ref) for ref in select.group_by]
    out, aggregates = [], []
    for k, item in enumerate(select.items):
        name = f"o{k}"
        if isinstance(item, Aggregate):
            aggregates.append(_aggregate(item, scope).alias(name))
            out.append((Field(None, str(item), name, None), str(item)))
            continue
        field = scope.find(item)
        if not keys:
            raise EngineError("Non-aggregate columns require GROUP BY")
        if field not in keys:
            raise EngineError(f"Column '{item.column}' must appear in GROUP BY")
        out.append((Field(field.table, field.column, field.name, field.type), label(field)))
    names = list(dict.fromkeys(f.name for f in keys))
    if not names:
        return df.agg(*aggregates), out
    return (df.groupBy(*names).agg(*aggregates) if aggregates else df.select(*names).distinct()), out


def _cut(df: DataFrame, offset: int, limit: int | None) -> DataFrame:
    """OFFSET and LIMIT. Spark counts their sum in 31 bits; beyond that rows are numbered, partition after partition in
    their order."""
    if offset + (limit or 0) <= MOST_ROWS:
        df = df.offset(offset) if offset else df
        return df if limit is None else df.limit(limit)
    end = float("inf") if limit is None else offset + limit
    numbered = df.rdd.zipWithIndex()
    return df.sparkSession.createDataFrame(numbered.filter(lambda row: offset <= row[1] < end).map(lambda row: row[0]), df.schema)


def lower(select: Select, resolve: Resolve, null_safe: bool = False) -> DataFrame:
    """The DataFrame of a SELECT. ``null_safe`` lets NULL keys of a join meet.

    Order of operations: FROM, JOIN, WHERE, aggregation or projection, DISTINCT, ORDER BY on output
    columns, OFFSET, LIMIT."""
    df, fields = _source(select, resolve, null_safe)
    scope = Scope(fields)
    for term in select.where:
        if isinstance(term, InSubquery):
            df = _member(df, term, scope, resolve)
        elif isinstance(term, Comparison):
            df = df.filter(comparison(term, scope))
        else:
            raise EngineError("WHERE clause must be a comparison expression")
    qualified = isinstance(select.source, Join)
    label = lambda f: f"{f.table}.{f.column}" if qualified else f.column
    if select.group_by or any(isinstance(i, Aggregate) for i in select.items or ()):
        df, out = _grouped(df, select, scope, label)
    else:
        shown = fields if select.items is None else [scope.find(ref) for ref in select.items]
        out = [(f, label(f)) for f in shown]
    # outputs get names of their own until the end: a column may be shown twice
    df = df.select(*[F.col(f.name).alias(f"s{k}") for k, (f, _) in enumerate(out)])
    if select.distinct:
        df = df.distinct()
    if select.order_by:
        visible = [Field(f.table, f.column, f"s{k}", f.type) for k, (f, _) in enumerate(out) if f.type is not None]
        order = []
        for ref, ascending in select.order_by:
            if not any(f.column == ref.column and ref.table in (None, f.table) for f in visible):
                raise EngineError(f"ORDER BY column '{ref}' must appear in select list")
            column = F.col(Scope(visible).find(ref).name)
            order.append(column.asc_nulls_first() if ascending else column.desc_nulls_last())
        df = df.orderBy(*order)
    df = _cut(df, select.offset or 0, select.limit)
    return df.toDF(*[name for _, name in out])
