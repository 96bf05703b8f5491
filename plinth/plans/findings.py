"""What could not be computed as asked: reported, never guessed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKER, WARNING, INFO, APPEARANCE, COSMETIC = "BLOCKER", "WARNING", "INFO", "APPEARANCE", "COSMETIC"
#: The codes that callers match on.
CODES = (
    "measure-unresolved", "color-unresolved", "filter-governed-by-dashboard", "filter-not-pushed",
    "relative-date-not-pushed", "topn-not-pushed", "topn-column-missing", "topn-order-of-ops",
    "view-order-filter-not-pushed", "view-order-filter-pushed", "empty-result", "filter-widget-unmapped",
    "window-in-kpi", "measure-query-failed", "image-marks", "window-ordering", "panel-as-color", "panel-capped",
    "rank-table-fallback", "row-cap", "category-cap", "treemap-fallback", "dim-skipped", "geo-missing",
    "geo-unmapped", "map-fallback", "window-dim-dropped", "non-data-sheet", "datasource-unmapped", "blend-partial",
    "forecast-dropped", "subtotals-dropped", "viz-in-tooltip", "axis-scale", "render-failed", "device-layouts",
    "calc-untranslated", "story-unsupported",
)

#: What a finding takes from a sheet's score.
LOST = {BLOCKER: 0.5, WARNING: 0.15, INFO: 0.05}


class Refused(ValueError):
    """The request has no exact answer; ``code`` and ``reason`` say why."""

    def __init__(self, code: str, reason: str):
        super().__init__(f"{code}: {reason}")
        self.code, self.reason = code, reason


@dataclass(frozen=True)
class Finding:
    severity: str
    sheet: str
    code: str
    message: str


@dataclass
class Findings:
    """Each distinct finding once, in the order in which they came. What only the data can tell is looked up
    when the findings are asked for, not while a sheet is planned."""

    found: dict[Finding, None] = field(default_factory=dict)
    pending: list[tuple[Callable[[], bool], Finding]] = field(default_factory=list)

    def add(self, severity: str, sheet: str, code: str, message: str, when: Callable[[], bool] | None = None) -> None:
        if code not in CODES:
            raise ValueError(f"unknown finding code {code}")
        if when is None:
            self.found.setdefault(Finding(severity, sheet, code, message))
        else:
            self.pending.append((when, Finding(severity, sheet, code, message)))

    @property
    def rows(self) -> dict[Finding, None]:
        while self.pending:
            when, finding = self.pending.pop(0)
            if when():
                self.found.setdefault(finding)
        return self.found

    def codes(self) -> list[str]:
        return [f.code for f in self.rows]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f.severity, f.sheet, f.code, f.message) for f in self.rows], "severity string, sheet string, code string, message string")

    def score(self, sheet: str) -> float:
        """1 less 0.5 a blocker, 0.15 a warning and 0.05 an information, 0.3 at least; 0 if it failed."""
        own = [f for f in self.rows if f.sheet == sheet]
        if any(f.code == "render-failed" for f in own):
            return 0.0
        return max(0.3, 1 - sum(LOST.get(f.severity, 0) for f in own))


def scored(findings: DataFrame) -> DataFrame:
    """``findings``: (severity, sheet, code). The score of each sheet in it."""
    lost = F.lit(0.0)
    for severity, size in LOST.items():
        lost = F.when(F.col("severity") == severity, size).otherwise(lost)
    score = F.when(F.max(F.col("code") == "render-failed"), 0.0).otherwise(F.greatest(F.lit(0.3), 1 - F.sum(lost)))
    return findings.groupBy("sheet").agg(score.alias("score"))
