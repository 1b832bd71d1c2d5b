"""Figures and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import rubric as rubrics
from ..functions import text
from ..functions.schema import EXPORT_HEADERS
from ..sources.exports import write_lines
from .records import active, scored, shown_name


def kpis(records: DataFrame, rubric=None) -> DataFrame:
    """One row: total, excluded, ready (of the active), active, unusable domains (of all)."""
    return scored(records, rubric).agg(
        F.count("*").alias("total"), F.count_if("excluded").alias("excluded"),
        F.count_if(~F.col("excluded") & F.col("result.ready")).alias("ready"), F.count_if(~F.col("excluded")).alias("active"),
        F.count_if((F.col("domain") != "") & F.col("domain_extracted").isNull()).alias("unusable_domains"),
    )


def kpi_row(records: DataFrame, malformed: DataFrame, groups: DataFrame, resolutions: DataFrame, rubric=None) -> DataFrame:
    """All seven figures in one row."""
    open_ = groups.join(resolutions, "group_key", "left_anti")
    return (
        kpis(records, rubric)
        .crossJoin(malformed.agg(F.count("*").alias("malformed")))  # one row each
        .crossJoin(groups.agg(F.count("*").alias("groups")))
        .crossJoin(open_.agg(F.count("*").alias("unresolved")))
        .select("total", "malformed", "groups", "unresolved", "excluded", F.concat_ws(" / ", "ready", "active").alias("ready"), "unusable_domains")
    )


def export_rows(records: DataFrame, kind: str = "cleaned", rubric=None) -> DataFrame:
    """id and the 16 export columns of active records; any kind but cleaned means those that are not ready."""
    rows = scored(active(records), rubric)
    if kind != "cleaned":
        rows = rows.where(~F.col("result.ready"))
    r = F.col("result")
    values = [
        shown_name(), F.coalesce("domain_extracted", "domain"),
        *map(F.col, ("email", "first_name", "last_name", "title", "phone", "industry", "employee_count", "country", "state", "city", "linkedin")),
        r["score"], F.when(r["ready"], "yes").otherwise("no"), rubrics.missing_required(r),
    ]
    return rows.select("id", *[v.alias(h) for v, h in zip(values, EXPORT_HEADERS)])


def export_counts(records: DataFrame, rubric=None) -> DataFrame:
    """One row: rows of the cleaned export and of that of records that are not ready."""
    return scored(active(records), rubric).agg(F.count("*").alias("cleaned"), F.count_if(~F.col("result.ready")).alias("needs_enrichment"))


def csv_lines(export: DataFrame) -> DataFrame:
    """id and the line of each export row."""
    return export.select("id", text.csv_line(*[F.col(f"`{h}`") for h in EXPORT_HEADERS]).alias("line"))


def to_csv(headers: list[str] | tuple[str, ...], rows: list) -> str:
    """Small tables (rows as lists or dicts) as text: commas, CRLF between lines, none at the end."""

    def cell(v) -> str:
        v = "" if v is None else str(v)
        return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\r\n') else v

    lines = [headers, *([r.get(h) for h in headers] if isinstance(r, dict) else r for r in rows)]
    return "\r\n".join(",".join(map(cell, line)) for line in lines)


def header_line() -> str:
    return to_csv(EXPORT_HEADERS, [])


def export_text(records: DataFrame, kind: str = "cleaned", rubric=None) -> str:
    """The whole export as one text, in id order; for lists a person downloads."""
    rows = export_rows(records, kind, rubric).orderBy("id").drop("id")
    return to_csv(EXPORT_HEADERS, [list(r) for r in rows.toLocalIterator()])


def write_export(records: DataFrame, path: str, kind: str = "cleaned", rubric=None, mode: str = "append") -> int:
    """The export in parts in id order, for lists of any size; put together they are export_text, byte for byte.

    The number of rows it returns is observed as they are written.
    """
    seen = Observation()
    rows = csv_lines(export_rows(records, kind, rubric)).orderBy("id").observe(seen, F.count(F.lit(1)).alias("rows"))
    write_lines(rows, path, header_line(), mode)
    return seen.get["rows"]
