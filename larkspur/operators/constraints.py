"""Declared constraints as queries for rows that break them, all run before anything is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.errors import EngineError
from larkspur.plans.lowering import predicate, scope_of
from larkspur.plans.parser import parse_condition
from larkspur.sources.catalog import Index, Manifest, Table


def quoted(name: str) -> str:
    return f"`{name}`"


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys without NULL that more than one row has."""
    keys = [F.col(quoted(c)) for c in columns]
    present = df.dropna(subset=[quoted(c) for c in columns])
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, target: str) -> DataFrame:
    """Child rows whose key, if any, no parent row has."""
    keys = parent.select(F.col(quoted(target)).alias("__key"))
    return child.filter(F.col(quoted(column)).isNotNull()).join(keys, F.col(quoted(column)) == F.col("__key"), "left_anti")


def referenced(parent: DataFrame, target: str, child: DataFrame, column: str) -> DataFrame:
    """Parent rows whose key some child row has; NULL is never a reference."""
    keys = child.select(F.col(quoted(column)).alias("__key"))
    return parent.join(keys, F.col(quoted(target)) == F.col("__key"), "left_semi")


def nulls(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(quoted(column)).isNull())


def failing(df: DataFrame, table: str, check: str) -> DataFrame:
    """Rows for which a CHECK isn't true; an unknown outcome fails as well."""
    holds = predicate(parse_condition(check), scope_of(df, table))
    return df.filter(~F.coalesce(holds, F.lit(False)))


def _refuse(bad: DataFrame, message: str) -> None:
    if not bad.isEmpty():
        raise EngineError(message, "invalid_data")


class Rules:
    """The constraints on one table in a manifest; ``read`` gives any table's rows."""

    def __init__(self, manifest: Manifest, table: str, read):
        self.manifest, self.name, self.read = manifest, table, read
        self.table: Table = manifest.table(table)

    def new_rows(self, rows: DataFrame) -> None:
        """What can be judged from new or changed rows and other tables."""
        for column in self.table.not_null:
            _refuse(nulls(rows, column), f"NOT NULL constraint violation on column '{column}'")
        for check in self.table.checks:
            _refuse(failing(rows, self.name, check), f"CHECK constraint violation: {check}")
        for column, parent, target in self.table.foreign_keys:
            _refuse(orphans(rows, column, self.read(parent), target), f"Foreign key violation on column '{column}': no such value in {parent}({target})")

    def _keys(self) -> list[tuple[list[str], str]]:
        own = [([c], f"Unique constraint violation on column '{c}'") for c in self.table.unique]
        indexes = [i for i in self.manifest.indexes_of(self.name) if i.unique]
        return own + [(i.columns, f"Unique constraint violation on index '{i.name}': duplicate key value") for i in indexes]

    def added(self, rows: DataFrame, stored: DataFrame) -> None:
        """Keys of appended rows: among themselves, and against stored rows by a semi join that the
        few new rows keep small."""
        for columns, message in self._keys():
            _refuse(duplicates(rows, columns), message)
            same = None
            keys = stored.select(*[F.col(quoted(c)).alias(f"__k{n}") for n, c in enumerate(columns)])
            for n, c in enumerate(columns):
                one = F.col(quoted(c)) == F.col(f"__k{n}")
                same = one if same is None else same & one
            _refuse(rows.join(keys, same, "left_semi"), message)

    def whole(self, rows: DataFrame, changed: set[str]) -> None:
        """Keys of a table as it will be, where a changed column is part of them."""
        for columns, message in self._keys():
            if changed & set(columns):
                _refuse(duplicates(rows, columns), message)

    def released(self, rows: DataFrame, changed: set[str] | None = None) -> None:
        """Rows whose keys go away must not be referenced by another table."""
        for child, table in self.manifest.tables.items():
            for column, parent, target in table.foreign_keys:
                if parent == self.name and (changed is None or target in changed):
                    _refuse(referenced(rows, target, self.read(child), column), f"Foreign key restrict: {self.name}({target}) is referenced by {child}({column})")


def refuse_duplicates(df: DataFrame, index: Index) -> None:
    """For building a unique index."""
    _refuse(duplicates(df, index.columns), f"Cannot create unique index: duplicate values found in columns ({', '.join(index.columns)})")
