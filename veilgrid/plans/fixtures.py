"""Small inline tables, given alike to Spark and to SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]"}


def sql_value(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(sql_value, value)) + "]"
    if isinstance(value, str):
        if any(ord(c) < 32 for c in value):
            return "(" + " || ".join(f"chr({ord(c)})" if ord(c) < 32 else sql_value(c) for c in value) + ")"
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def sql_list(values) -> str:
    return ", ".join(map(sql_value, values))


class Fixture:
    """A named table of literal rows."""

    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.name, self.schema, self.rows = name, schema, rows
        self.columns = [tuple(c.strip().rsplit(" ", 1)) for c in schema.split(",")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def cte(self) -> str:
        names = [f"c{k}" for k in range(len(self.columns))]
        picked = ", ".join(f"CAST({c} AS {_TYPES[kind]}) AS {name}" for c, (name, kind) in zip(names, self.columns))
        if not self.rows:
            nothing = ", ".join(f"CAST(NULL AS {_TYPES[kind]}) AS {name}" for name, kind in self.columns)
            return f"{self.name} AS (SELECT {nothing} WHERE FALSE)"
        rows = ",\n    ".join("(" + sql_list(r) + ")" for r in self.rows)
        return f"{self.name} AS (SELECT {picked} FROM (VALUES\n    {rows}) AS t({', '.join(names)}))"


def with_(*parts: Fixture | str) -> str:
    return "WITH " + ",\n".join(p.cte if isinstance(p, Fixture) else p for p in parts) + "\n"
