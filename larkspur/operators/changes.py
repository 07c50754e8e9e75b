"""UPDATE and DELETE as DataFrame transformations of a whole table (copy on write)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.errors import EngineError, missing_column
from larkspur.functions.types import Literal, assign, assign_column, constant
from larkspur.plans.lowering import predicate, scope_of
from larkspur.plans.syntax import Condition, InSubquery, Update
from larkspur.sources.catalog import Table


def hits(df: DataFrame, table: str, where: Condition) -> Column:
    """Whether a row is meant: unknown counts as no."""
    if any(isinstance(t, InSubquery) for t in where):
        raise EngineError("WHERE clause must be a comparison expression")
    return F.coalesce(predicate(where, scope_of(df, table)), F.lit(False))


def new_values(df: DataFrame, name: str, table: Table, update: Update) -> dict[str, Column]:
    """By assigned column, its new value from the row as it was."""
    scope, out = scope_of(df, name), {}
    for column, value in update.changes:
        declared = table.type_of(column)
        if declared is None:
            raise missing_column(column, name)
        if column in out:
            raise EngineError(f"Duplicate assignment for column '{column}'")
        if isinstance(value, Literal):
            out[column] = constant(assign(value, declared), declared)
        else:
            field = scope.find(value)
            out[column] = assign_column(F.col(field.name), table.type_of(field.column), declared)
    return out


def after_update(df: DataFrame, hit: Column, values: dict[str, Column]) -> DataFrame:
    """All rows as they will be."""
    return df.select(*[(F.when(hit, values[c]).otherwise(F.col(f"`{c}`")) if c in values else F.col(f"`{c}`")).alias(c) for c in df.columns])


def after_delete(df: DataFrame, hit: Column) -> DataFrame:
    return df.filter(~hit)
