"""A prompt: ``python -m larkspur.repl [folder]``. SQL lines, and .commit, .vacuum [table|all], .exit."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from larkspur.session import Engine


def respond(engine: Engine, line: str) -> list[str]:
    """What the prompt prints for one line."""
    line = line.strip()
    try:
        if line == ".commit":
            engine.flush_all()
            return ["Changes committed"]
        if line.startswith(".vacuum"):
            what = line.split()[1] if len(line.split()) > 1 else "all"
            n = engine.vacuum_all() if what == "all" else engine.vacuum_table(what)
            return [f"Vacuum removed {n} row(s)."]
        if line.startswith("."):
            return [f"Unknown command: {line}"]
        return [str(r) for r in engine.execute_many(line)]
    except Exception as e:  # the prompt goes on after any failed statement
        return [f"Error: {e}"]


def main(folder: str = "./data", lines=None) -> None:
    spark = SparkSession.builder.appName("larkspur").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, folder)
    for name, schema in engine.list_tables():
        print(f"{name}({', '.join(f.name for f in schema)})")
    for name, table, columns, method, unique in engine.list_indexes():
        print(f"{name}: {'UNIQUE ' if unique else ''}{method} on {table}({', '.join(columns)})")
    while True:
        print("sql> ", end="", flush=True)
        line = sys.stdin.readline() if lines is None else next(lines, "")
        if not line or line.strip() == ".exit":
            break
        if line.strip():
            print("\n".join(respond(engine, line)), flush=True)
    engine.flush_all()


if __name__ == "__main__":
    main(*sys.argv[1:2])
