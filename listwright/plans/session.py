"""An immutable workspace: read, map, score, find duplicates, decide, export."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.schema import THRESHOLD
from ..operators import dedup, mapping, records, report, review
from ..sources import leads


@dataclass(frozen=True)
class Workspace:
    spark: SparkSession
    parsed: leads.Leads
    mapping: dict[str, str | None]
    rubric: tuple | None = None
    threshold: float = THRESHOLD
    ledger: tuple[review.Event, ...] = field(default=())

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Workspace:
        return cls.of(spark, leads.read_leads(spark, path))

    @classmethod
    def of_text(cls, spark: SparkSession, text: str) -> Workspace:
        return cls.of(spark, leads.leads_from_text(spark, text))

    @classmethod
    def sample(cls, spark: SparkSession) -> Workspace:
        return cls.of(spark, leads.load_sample(spark))

    @classmethod
    def of(cls, spark: SparkSession, parsed: leads.Leads) -> Workspace:
        return cls(spark, parsed, mapping.suggest_mapping(parsed.headers))

    def map(self, **fields: str | None) -> Workspace:
        return replace(self, mapping=self.mapping | fields)

    def with_rubric(self, rubric) -> Workspace:
        return replace(self, rubric=None if rubric is None else tuple(rubric))

    def with_threshold(self, value) -> Workspace:
        return replace(self, threshold=dedup.clamp_threshold(value) or self.threshold)

    def decide(self, *events: review.Event) -> Workspace:
        return replace(self, ledger=self.ledger + events)

    def reset(self) -> Workspace:
        """Without decisions and rubric; the threshold stays."""
        return replace(self, ledger=(), rubric=None, mapping=mapping.suggest_mapping(self.parsed.headers))

    def built(self) -> DataFrame:
        """Records before decisions; duplicates are sought among all of them."""
        chosen = mapping.confirm_mapping(self.parsed.headers, self.mapping)
        return records.build_records(mapping.named_rows(self.parsed.rows, self.parsed.headers), chosen)

    def records(self) -> DataFrame:
        return review.apply_effects(self.built(), review.effects_frame(self.spark, review.fold_ledger(self.ledger)))

    def groups(self) -> DataFrame:
        return dedup.find_duplicates(self.built(), self.threshold)[0]

    def resolutions(self) -> DataFrame:
        state = review.fold_ledger(self.ledger)
        return review.surviving(review.resolutions_frame(self.spark, state), self.groups())

    def preview(self) -> DataFrame:
        return records.preview(self.records(), self.rubric)

    def kpi_row(self) -> DataFrame:
        return report.kpi_row(self.records(), self.parsed.malformed, self.groups(), self.resolutions(), self.rubric)

    def export(self, kind: str = "cleaned") -> str:
        return report.export_text(self.records(), kind, self.rubric)
