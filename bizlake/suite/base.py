"""Registering queries and binding the domain tables to the test tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.joins import ROWS_SENT, never_sent
from ..session import spread, tune
from .bindings import BINDINGS

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


#: Bindings with costly rows; the test tables are single-block files.
WIDE = ["reg", "codes", "fin_raw", "org_raw"]

#: Tables that grow and that a binding joins with larger ones.
JOINED = {"voc": "part"}

#: What bindings of ``orders`` read many times in branches, where Spark would work it out each time.
PRICE, PRICE_COLUMN = "CAST(o_totalprice AS DECIMAL(18,2))", "_price"


class Tables:
    """Test tables and domain bindings of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in BINDINGS:
            raise AttributeError(name)
        text = BINDINGS[name]
        used = {n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))}
        if name in WIDE:
            used = {n: spread(df) for n, df in used.items()}
        if (side := JOINED.get(name)) and used[side].count() > ROWS_SENT:  # the files tell
            used[side] = never_sent(used[side])
        if "orders" in used and PRICE in text:
            used["orders"] = used["orders"].withColumn(PRICE_COLUMN, F.expr(PRICE))
            text = text.replace(PRICE, PRICE_COLUMN)
        return self.spark.sql(text, **used)


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function under ``name`` with its SQL counterpart."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(build, sql)
        return build

    return register


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name].build(Tables(tune(spark), folder))


def _needed(text: str, found: dict[str, str]) -> None:
    for name, binding in BINDINGS.items():
        if name not in found and re.search(rf"\b{name}\b", text):
            _needed(binding, found)
            found[name] = re.sub(r"\{(\w+)\}", r"\1", binding)


def oracle(name: str) -> str | None:
    """The SQL of a query, with the bindings it uses as leading WITH entries."""
    text = QUERIES[name].sql
    if text is None:
        return None
    found: dict[str, str] = {}
    _needed(text, found)
    entries = [f"{n} AS (\n{b.strip()}\n)" for n, b in found.items()]
    body = text.strip()
    if body[:5].upper() == "WITH ":
        entries.append(body[5:])
        return "WITH " + ",\n".join(entries)
    return ("WITH " + ",\n".join(entries) + "\n" if entries else "") + body
