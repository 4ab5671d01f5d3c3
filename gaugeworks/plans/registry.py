"""All registered queries of the library proper, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.plans import agents, code, composite, history, reports, tables, texts

_ALL = history.QUERIES | texts.QUERIES | tables.QUERIES | code.QUERIES | agents.QUERIES | reports.QUERIES | composite.QUERIES
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: build for name, (build, _) in _ALL.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql}
FLAGSHIP = composite.composite
