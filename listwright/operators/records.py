"""Records: canonical columns, derived ones, and the views that are scored and shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rubric as rubrics
from ..functions import text
from ..functions.schema import KEYS, REASONS, column_of


def build_records(rows: DataFrame, mapping: dict[str, str | None], id_column: str = "id") -> DataFrame:
    """Records of rows by header (or of any DataFrame, with its columns as headers)."""

    def source(key: str) -> Column:
        return text.trimmed(F.col(f"`{mapping[key]}`")) if mapping.get(key) else F.lit("")

    base = rows.select(F.col(id_column).cast("long").alias("id"), *[source(k).alias(column_of(k)) for k in KEYS])
    return base.select(
        "id", "company", text.normalize_company(F.col("company")).alias("normalized_company"), "domain",
        text.domain_of(F.col("domain"), F.col("email")).alias("domain_extracted"), "email", text.is_likely_email(F.col("email")).alias("email_valid"),
        *[column_of(k) for k in KEYS[3:]],
        F.lit(False).alias("excluded"), F.lit(None).cast("string").alias("exclude_reason"), F.lit(None).cast("long").alias("merged_into"),
    )


def active(records: DataFrame) -> DataFrame:
    return records.where(~F.col("excluded"))


def score_view() -> dict[str, Column]:
    """What a record shows to the rubric: normalised company, extracted domain, email only if valid."""
    return rubrics.columns_by_field() | {
        "company": F.col("normalized_company"), "domain": F.col("domain_extracted"), "email": F.when(F.col("email_valid"), F.col("email"))
    }


def scored(records: DataFrame, rubric=None) -> DataFrame:
    """Records with result, a struct of score, missing and ready.  No shuffle, no join."""
    return records.withColumn("result", rubrics.score(score_view(), rubric))


def shown_name() -> Column:
    name = F.when(F.col("normalized_company") != "", F.col("normalized_company")).otherwise(F.col("company"))
    return name


def preview(records: DataFrame, rubric=None) -> DataFrame:
    """The table a reviewer sees, one row a record."""
    r = F.col("result")
    missing = F.size(F.filter(r["missing"], lambda m: m["required"]))
    name = shown_name()
    nonblank = lambda c: F.when(F.col(c) != "", F.col(c))
    return scored(records, rubric).select(
        (F.col("id") + 1).alias("row"),
        F.when(name == "", "(blank)").otherwise(name).alias("company"),
        F.coalesce("domain_extracted", F.when(F.col("domain") != "", F.concat(F.lit("invalid: "), F.substring("domain", 1, 24))).otherwise("missing")).alias("domain"),
        "email", F.concat_ws(" ", nonblank("first_name"), nonblank("last_name")).alias("contact"), "title",
        r["score"].alias("score"), text.score_band(r["score"]).alias("band"),
        F.when(r["ready"], "ready").otherwise(F.concat(missing.cast("string"), F.lit(" missing"))).alias("readiness"),
        F.when(~F.col("excluded"), "active").when(F.col("merged_into").isNotNull(), F.concat(F.lit("merged → #"), (F.col("merged_into") + 1).cast("string"))).otherwise("discarded").alias("status"),
    )


def reason_label(reason: Column) -> Column:
    label = reason
    for code, words in REASONS.items():
        label = F.when(reason == code, words).otherwise(label)
    return label
