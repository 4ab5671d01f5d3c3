"""Scoring configuration as data: categories, metrics, breakpoints, tiers, and project settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

Breakpoints = tuple[tuple[float, float], ...]


class Metric(NamedTuple):
    """One metric of a category: its weight there and its value-to-score breakpoints."""

    category: str
    name: str
    weight: float
    breakpoints: Breakpoints


def falling(*values: float, scores: tuple[float, ...] = (10, 8, 6, 3, 1)) -> Breakpoints:
    """Lower is better: scores fall as values rise."""
    return tuple(zip(map(float, values), map(float, scores), strict=True))


def rising(*values: float, scores: tuple[float, ...] = (1, 3, 6, 8, 10)) -> Breakpoints:
    """Higher is better: scores rise with values."""
    return tuple(zip(map(float, values), map(float, scores), strict=True))


# Category weights, tiers, and each metric's weight and breakpoints.
CATEGORY_WEIGHTS = {"C1": 0.25, "C2": 0.10, "C3": 0.20, "C4": 0.15, "C5": 0.10, "C6": 0.15, "C7": 0.10}
TIERS = (("Agent-Ready", 8.0), ("Agent-Assisted", 6.0), ("Agent-Limited", 4.0), ("Agent-Hostile", 0.0))
SHARE = rising(0, 30, 50, 80, 100)
PRESENT = rising(0, 1, scores=(3, 10))
TESTED = (1, 4, 6, 8, 10)
AGENT = rising(1, 4, 7, 10, scores=(1, 4, 7, 10))
METRICS = (
    Metric("C1", "complexity_avg", 0.25, falling(1, 5, 10, 20, 40)),
    Metric("C1", "func_length_avg", 0.20, falling(5, 15, 30, 60, 100)),
    Metric("C1", "file_size_avg", 0.15, falling(50, 150, 300, 500, 1000)),
    Metric("C1", "afferent_coupling_avg", 0.15, falling(0, 2, 5, 10, 20)),
    Metric("C1", "efferent_coupling_avg", 0.10, falling(0, 2, 5, 10, 20)),
    Metric("C1", "duplication_rate", 0.15, falling(0, 3, 8, 15, 50)),
    Metric("C2", "type_annotation_coverage", 0.30, SHARE),
    Metric("C2", "naming_consistency", 0.25, rising(0, 70, 85, 95, 100)),
    Metric("C2", "magic_number_ratio", 0.20, falling(0, 5, 15, 30, 50)),
    Metric("C2", "type_strictness", 0.15, PRESENT),
    Metric("C2", "null_safety", 0.10, SHARE),
    Metric("C3", "max_dir_depth", 0.20, falling(1, 3, 5, 7, 10)),
    Metric("C3", "module_fanout_avg", 0.20, falling(0, 3, 6, 10, 15)),
    Metric("C3", "circular_deps", 0.25, falling(0, 1, 3, 5, 10, scores=(10, 6, 3, 2, 1))),
    Metric("C3", "import_complexity_avg", 0.15, falling(1, 2, 4, 6, 8)),
    Metric("C3", "dead_exports", 0.20, falling(0, 5, 15, 30, 50)),
    Metric("C4", "readme_word_count", 0.15, rising(0, 100, 300, 500, 1000)),
    Metric("C4", "comment_density", 0.20, rising(0, 5, 10, 15, 25)),
    Metric("C4", "api_doc_coverage", 0.25, SHARE),
    Metric("C4", "changelog_present", 0.10, PRESENT),
    Metric("C4", "examples_present", 0.15, PRESENT),
    Metric("C4", "contributing_present", 0.10, PRESENT),
    Metric("C4", "diagrams_present", 0.05, rising(0, 1, scores=(5, 10))),
    Metric("C5", "churn_rate", 0.20, falling(50, 100, 300, 600, 1000)),
    Metric("C5", "temporal_coupling_pct", 0.25, falling(0, 5, 15, 25, 30)),
    Metric("C5", "author_fragmentation", 0.20, falling(1, 2, 4, 6, 8)),
    Metric("C5", "commit_stability", 0.15, rising(0.5, 1, 3, 7, 14)),
    Metric("C5", "hotspot_concentration", 0.20, falling(20, 30, 50, 70, 80)),
    Metric("C6", "test_to_code_ratio", 0.25, rising(0, 0.2, 0.5, 0.8, 1.5, scores=TESTED)),
    Metric("C6", "coverage_percent", 0.30, rising(0, 30, 50, 70, 90, scores=TESTED)),
    Metric("C6", "test_isolation", 0.15, rising(0, 40, 60, 80, 95, scores=TESTED)),
    Metric("C6", "assertion_density_avg", 0.15, rising(0, 1, 2, 3, 5, scores=TESTED)),
    Metric("C6", "test_file_ratio", 0.15, rising(0, 0.3, 0.5, 0.7, 0.9, scores=TESTED)),
    Metric("C7", "task_execution_consistency", 0.20, AGENT),
    Metric("C7", "code_behavior_comprehension", 0.25, AGENT),
    Metric("C7", "cross_file_navigation", 0.25, AGENT),
    Metric("C7", "identifier_interpretability", 0.15, AGENT),
    Metric("C7", "documentation_accuracy_detection", 0.15, AGENT),
)

SCHEMA = "category string, category_weight double, metric string, weight double, breakpoints array<struct<value:double,score:double>>"


@dataclass(frozen=True)
class ScoringConfig:
    """Category weights and metrics, with the tiers from best to worst."""

    categories: dict[str, float] = field(default_factory=lambda: dict(CATEGORY_WEIGHTS))
    metrics: tuple[Metric, ...] = METRICS
    tiers: tuple[tuple[str, float], ...] = TIERS

    def frame(self, spark: SparkSession) -> DataFrame:
        """The configuration as a table of one row a metric (a few dozen rows)."""
        rows = [(m.category, float(self.categories[m.category]), m.name, m.weight, list(m.breakpoints)) for m in self.metrics if m.category in self.categories]
        return spark.createDataFrame(rows, SCHEMA)

    def with_weights(self, weights: dict[str, float]) -> ScoringConfig:
        """Category weights overlaid; unknown categories are ignored."""
        known = {k: float(v) for k, v in weights.items() if k in self.categories}
        return replace(self, categories=self.categories | known)


@dataclass(frozen=True)
class ProjectConfig:
    """A project's settings: version, category weights and the threshold for the composite."""

    version: int = 0
    weights: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0
    languages: tuple[str, ...] = ()
    metrics: dict[str, dict] = field(default_factory=dict)

    def check(self) -> ProjectConfig:
        """Raise unless the version is known and no number is negative."""
        if self.version not in (0, 1):
            raise ValueError(f"unsupported configuration version {self.version}")
        if bad := [k for k, v in self.weights.items() if v < 0]:
            raise ValueError(f"negative weight for {', '.join(sorted(bad))}")
        if self.threshold < 0:
            raise ValueError("negative threshold")
        return self


def parse_settings(text: str) -> dict:
    """Settings from YAML if that library is there, else from JSON."""
    try:
        import yaml
    except ImportError:
        return json.loads(text or "{}") or {}
    return yaml.safe_load(text) or {}


def project_config(text: str) -> ProjectConfig:
    """A checked project configuration from a document's text."""
    raw = parse_settings(text)
    scoring = raw.get("scoring") or {}
    return ProjectConfig(
        version=int(raw.get("version") or 0),
        weights={str(k): float(v) for k, v in (scoring.get("weights") or {}).items()},
        threshold=float(scoring.get("threshold") or 0),
        languages=tuple(raw.get("languages") or ()),
        metrics=raw.get("metrics") or {},
    ).check()


def scoring_overlay(text: str, base: ScoringConfig | None = None) -> ScoringConfig:
    """Scoring settings laid over the defaults: category weights, metric weights and breakpoints."""
    base = base or ScoringConfig()
    raw = parse_settings(text)
    categories = dict(base.categories)
    metrics = {(m.category, m.name): m for m in base.metrics}
    for name, got in (raw.get("categories") or {}).items():
        if "weight" in got:
            categories[name] = float(got["weight"])
        for m in got.get("metrics") or ():
            old = metrics.get((name, m["name"]))
            points = tuple((float(b["value"]), float(b["score"])) for b in m["breakpoints"]) if m.get("breakpoints") else (old.breakpoints if old else ())
            metrics[name, m["name"]] = Metric(name, m["name"], float(m.get("weight", old.weight if old else 0)), points)
    tiers = tuple((t["name"], float(t["min_score"])) for t in raw["tiers"]) if raw.get("tiers") else base.tiers
    return ScoringConfig(categories, tuple(metrics.values()), tiers)
