"""Registered queries: a name, a Spark plan over the derived views, and its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.plans.views import VIEW_SQL, Views
from newsloom.session import use_utc


@dataclass(frozen=True)
class Query:
    build: Callable[[Views], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}
NAMES = r"\bv_\w+\b"


def query(name: str, sql: str | None = None):
    """Register ``build(views)`` under ``name``."""
    def add(build: Callable[[Views], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(build, sql)
        return build
    return add


def tidy(df: DataFrame) -> DataFrame:
    """One spelling per kind of value, so that two engines can be compared:
    bigint, double, and text for dates and timestamps."""
    def spell(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            return c.cast("bigint").alias(name)
        if kind == "float" or kind.startswith("decimal"):
            return c.cast("double").alias(name)
        if kind == "date":
            return c.cast("string").alias(name)
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
        return c
    return df.select(*[spell(n, k) for n, k in df.dtypes])


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(REGISTRY[name].build(Views(use_utc(spark), sf_dir)))
    run.__name__ = name
    return run


def oracle(sql: str) -> str:
    """Prefix a query with the views it uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for view in dict.fromkeys(re.findall(NAMES, text)):
            if view in VIEW_SQL and view not in needed and view != own:
                visit(VIEW_SQL[view], view)
                needed.append(view)

    visit(sql)
    body = sql.strip()
    own = ""
    match = re.match(r"WITH\s+(?:RECURSIVE\s+)?", body)
    # A view that names itself is recursive; the others are computed once.
    views = [
        f"{v} AS {'' if v in re.findall(NAMES, VIEW_SQL[v]) else 'MATERIALIZED '}({VIEW_SQL[v]})" for v in needed
    ]
    if match:
        own = body[match.end():]
        return "WITH RECURSIVE " + ",\n".join([*views, own])
    return ("WITH RECURSIVE " + ",\n".join(views) + "\n" if views else "") + body
