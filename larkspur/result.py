"""What a statement gives back."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from larkspur.functions.types import render


@dataclass
class Result:
    """``kind`` is the statement's; a SELECT has a lazy DataFrame, its column names and plan steps."""

    kind: str
    message: str = ""
    count: int = 0
    df: DataFrame | None = None
    column_names: list[str] = field(default_factory=list)
    plan: list[str] = field(default_factory=list)

    def rows(self) -> list[tuple]:
        """All rows, at the driver."""
        return [tuple(r) for r in self.df.collect()] if self.df is not None else []

    def explain(self) -> str:
        """Spark's physical plan."""
        return self.df._jdf.queryExecution().explainString(self.df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def __str__(self) -> str:
        if self.df is None:
            return self.message
        rows = self.rows()
        head = ["Plan:", *[f"  - {p}" for p in self.plan], ""] if self.plan else []
        body = [" | ".join(map(render, r)) for r in rows]
        return "\n".join([*head, " | ".join(self.column_names), "-" * 10 * len(self.column_names), *body, f"{len(rows)} row(s) returned"])


def counted(n: int, verb: str) -> str:
    return f"{n} row{'' if n == 1 else 's'} {verb}"
