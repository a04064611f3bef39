"""Registered queries and, where SQL can say the same, their oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.plans.inputs import Inputs, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, uses: tuple[str, ...] = (), oracle: str | None = None):
    """Registers a function of :class:`Inputs`; ``oracle`` may name the tables of ``uses``."""

    def add(f: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if oracle:
            clause = with_clause(uses)
            body = oracle.strip()
            if body.startswith("WITH RECURSIVE "):
                clause, body = clause.replace("WITH ", "WITH RECURSIVE ", 1), body.replace("RECURSIVE ", "", 1)
            if body.startswith("WITH "):
                ORACLES[name] = (clause + ",\n" if clause else "WITH ") + body[5:]
            else:
                ORACLES[name] = f"{clause}\n{body}"
        return f

    return add


for _part in ("tabular", "sequences", "graphs", "tagging", "scores", "texts", "visits", "views", "browsing", "judgements", "upkeep", "dialogue", "algorithms", "pairs", "summaries", "records"):
    importlib.import_module(f"colloquy.plans.{_part}")
