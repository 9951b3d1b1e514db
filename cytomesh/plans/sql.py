"""Queries in SQL that Spark runs over DataFrames and DuckDB runs over the same tables.

@name refers to a driver table or to a view of VIEWS. A few functions are spelled differently
by the engines; MEDIAN and PCT are written once and rendered for each.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cytomesh.session import table

#: name -> SQL text; filled by plans.views and the query modules.
VIEWS: dict[str, str] = {}
#: name -> DataFrame that Spark takes in place of a view's SQL; the oracle keeps the SQL.
FORMS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_NAME = re.compile(r"@(\w+)")


def _render(sql: str, percentile: str) -> str:
    """percentile: the engine's name of the exact, interpolating percentile."""
    sql = re.sub(r"MEDIAN\(", "PCT(50, ", sql)
    sql = re.sub(r"PCT\((\d+), ([^()]*(?:\([^()]*\)[^()]*)*)\)", lambda m: f"{percentile}({m[2]}, {int(m[1]) / 100})", sql)
    return re.sub(r"(?<![\w.'])\d+\.\d+(?![\w.'])", r"\g<0>e0", sql)  # doubles, not decimals


def _spark(sql: str) -> str:
    return _render(sql, "percentile")


def _duck(sql: str) -> str:
    return _render(sql, "quantile_cont")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query's DataFrame; its views are inlined, so Catalyst sees one plan."""
    names = dict.fromkeys(_NAME.findall(sql))
    parts = {n: view(spark, sf_dir, n) for n in names}
    return spark.sql(_NAME.sub(r"{\1}", _spark(sql)), **parts)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or driver table by name."""
    from cytomesh.plans import relational  # noqa: F401  (fills VIEWS)

    if name in FORMS:
        return FORMS[name](spark, sf_dir)
    return frame(spark, sf_dir, VIEWS[name]) if name in VIEWS else table(spark, sf_dir, name)


def duck(sql: str) -> str:
    """The query as one DuckDB statement with its views as common table expressions."""
    order: dict[str, str] = {}

    def need(text: str) -> None:
        for n in _NAME.findall(text):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order[n] = _NAME.sub(r"\1", _duck(VIEWS[n]))

    need(sql)
    body = _NAME.sub(r"\1", _duck(sql))
    if not order:
        return body
    views = ", ".join(f"{n} as ({text})" for n, text in order.items())
    if m := re.match(r"\s*with\s+recursive\s+", body, re.I):
        return f"with recursive {views}, {body[m.end():]}"
    if m := re.match(r"\s*with\s+", body, re.I):
        return f"with {views}, {body[m.end():]}"
    return f"with {views} {body}"


def query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: frame(spark, sf_dir, sql)
