"""Query registry and the shared bindings of operator inputs onto the test tables.

A binding is one SELECT text that both Spark SQL and DuckDB accept, so the Spark query and its DuckDB check start
from the same input rows. Only the operator under test differs between the two sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

BINDINGS: dict[str, str] = {}

#: Bindings that many steps read: each is written once per session, folder and text of its statement.
STORED: set[str] = set()
_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def bind(name: str, sql: str, stored: bool = False) -> None:
    BINDINGS[name] = sql
    if stored:
        STORED.add(name)


def _reads(sql: str, name: str) -> bool:
    return re.search(rf"(?i)\b(FROM|JOIN)\s+{name}\b", sql) is not None


def _needs(sql: str) -> list[str]:
    return [n for n in BINDINGS if _reads(sql, n)]


class Tables:
    """Lazy access to test tables and bindings for one (session, folder)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.cache = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.cache:
            if name in TABLES:
                self.cache[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in BINDINGS:
                sql = BINDINGS[name]
                inputs = [n for n in (*TABLES, *BINDINGS) if _reads(sql, n)]
                for n in inputs:
                    sql = re.sub(rf"(?i)\b(FROM|JOIN)\s+{n}\b", r"\1 {" + n + "}", sql)
                key = (self.spark.sparkContext.applicationId, self.folder, with_bindings(f"SELECT * FROM {name}"))
                if key not in _TABLES:
                    frame = self.spark.sql(sql, **{n: getattr(self, n) for n in inputs})
                    if name in STORED:
                        frame = _TABLES[key] = cut_lineage(frame)
                    self.cache[name] = frame
                else:
                    self.cache[name] = _TABLES[key]
            else:
                raise AttributeError(name)
        return self.cache[name]


def _duckdb(sql: str) -> str:
    """The three spellings that differ between the engines."""
    sql = sql.replace("array(", "list_value(").replace("AS STRING)", "AS VARCHAR)")
    return re.sub(r"sha2\((.*), 256\)", r"sha256(\1)", sql)


def with_bindings(sql: str) -> str:
    """Prefix a DuckDB statement with the bindings it uses, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _needs(text):
            if name not in order:
                visit(BINDINGS[name])
                order.append(name)

    visit(sql)
    ctes = [f"{n} AS MATERIALIZED ({_duckdb(BINDINGS[n])})" for n in order]
    body = sql.strip()
    if not ctes:
        return body
    head = re.match(r"(?is)WITH\s+(RECURSIVE\s+)?", body)
    if head:
        return f"WITH {head.group(1) or ''}" + ",\n".join(ctes) + ",\n" + body[head.end():]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` and its DuckDB statement under ``name``."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_bindings(sql)
        return fn
    return register
