"""Statements of the dialect as plain data."""

from __future__ import annotations

from dataclasses import dataclass

from larkspur.functions.types import Literal


@dataclass(frozen=True)
class ColumnRef:
    column: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.column}" if self.table else self.column


@dataclass(frozen=True)
class Comparison:
    """``op`` is one of ``= != < <= > >=``."""

    op: str
    left: ColumnRef | Literal
    right: ColumnRef | Literal

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class InSubquery:
    value: ColumnRef | Literal
    query: Select

    def __str__(self) -> str:
        return f"{self.value} IN (subquery)"


#: A conjunction: comparisons, memberships, or bare operands (which are refused when it is run).
Condition = tuple


def condition_text(terms: Condition) -> str:
    return " AND ".join(map(str, terms))


@dataclass(frozen=True)
class Aggregate:
    """``func`` is COUNT, SUM, AVG, MIN or MAX; ``target`` None stands for ``*``."""

    func: str
    target: ColumnRef | None

    def __str__(self) -> str:
        return f"{self.func}({self.target or '*'})"


@dataclass(frozen=True)
class Join:
    left: str
    right: str
    left_on: ColumnRef
    right_on: ColumnRef


@dataclass(frozen=True)
class Select:
    items: tuple | None  # None stands for *
    source: str | Join
    distinct: bool = False
    where: Condition = ()
    group_by: tuple[ColumnRef, ...] = ()
    order_by: tuple[tuple[ColumnRef, bool], ...] = ()  # with True for ascending
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    primary_key: bool = False
    unique: bool = False
    not_null: bool = False
    references: tuple[str, str] | None = None
    check: Condition = ()


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class AlterTable:
    """``action`` is add, drop, rename_column or rename_table."""

    table: str
    action: str
    column: str | ColumnDef | None = None
    to: str | None = None


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: tuple[str, ...]
    method: str = "BTREE"
    unique: bool = False


@dataclass(frozen=True)
class DropIndex:
    name: str


@dataclass(frozen=True)
class Insert:
    table: str
    rows: tuple[tuple[Literal, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    changes: tuple[tuple[str, ColumnRef | Literal], ...]
    where: Condition = ()


@dataclass(frozen=True)
class Delete:
    table: str
    where: Condition = ()


@dataclass(frozen=True)
class Transaction:
    """``command`` is BEGIN, COMMIT or ROLLBACK."""

    command: str


Statement = Select | CreateTable | DropTable | AlterTable | CreateIndex | DropIndex | Insert | Update | Delete | Transaction
