"""Registered queries: one Spark callable and, where SQL can say it, one DuckDB text each.

`out` lists the result columns as `name[:kind]`: d = date as text, i = integer,
b = boolean, s = text, a digit = double rounded to that many places.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.catalog.oracle import CTES, with_ctes
from panelspark.sources.star import Star


@dataclass
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def _cols(out: str) -> list[tuple[str, str]]:
    return [(t.split(":")[0], (t.split(":") + [""])[1]) for t in out.split()]


def shape(df: DataFrame, out: str) -> DataFrame:
    cols = []
    for name, kind in _cols(out):
        c = F.col(name)
        if kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "b":
            c = c.cast("boolean")
        elif kind.isdigit():
            c = F.round(c.cast("double"), int(kind)) + F.lit(0.0)
        cols.append(c.alias(name))
    return df.select(*cols)


def shape_sql(body: str, out: str) -> str:
    cols = []
    for name, kind in _cols(out):
        c = name
        if kind == "d":
            c = f"strftime({name}, '%Y-%m-%d')"
        elif kind == "i":
            c = f"CAST({name} AS BIGINT)"
        elif kind == "b":
            c = f"CAST({name} AS BOOLEAN)"
        elif kind.isdigit():
            c = f"round(CAST({name} AS DOUBLE), {kind}) + 0.0::DOUBLE"
        cols.append(f"{c} AS {name}")
    return f"SELECT {', '.join(cols)} FROM ({body})"


def query(name: str, out: str, ctes: str = "", sql: str | None = None):
    """Register fn(star) under `name`; `ctes` names the derived tables `sql` reads."""

    def deco(fn: Callable[[Star], DataFrame]):
        text = with_ctes(ctes.split(), shape_sql(sql, out)) if sql is not None else None
        REGISTRY[name] = Entry(lambda spark, path: shape(fn(Star(spark, path)), out), text)
        return fn

    return deco


def add_cte(name: str, deps: str, sql: str) -> None:
    CTES[name] = (deps.split(), sql)
