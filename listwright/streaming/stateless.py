"""The stateless stages over a stream of rows: they are plain projections, so nothing else is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.records import build_records, scored


def scored_stream(rows: DataFrame, mapping: dict[str, str | None], rubric=None, id_column: str = "id") -> DataFrame:
    """Scored records of a streaming (or batch) DataFrame with a column a header."""
    return scored(build_records(rows, mapping, id_column), rubric)
