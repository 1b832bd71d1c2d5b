"""Completeness rubric, compiled to one struct column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .schema import KEYS, LABELS, column_of
from .text import percent, present


@dataclass(frozen=True)
class Item:
    field: str
    label: str
    weight: float = 0
    required: bool = False
    included: bool = True


#: Weights of the default rubric; the first three fields are required.
DEFAULT = tuple(
    Item(field, LABELS[field], weight, required)
    for field, weight, required in (("company", 25, True), ("domain", 25, True), ("email", 20, True), ("firstName", 10, False), ("lastName", 10, False), ("title", 10, False))
)


def all_rows() -> list[Item]:
    """A row for each canonical field; those not in the default rubric weigh 5 and are left out."""
    default = {i.field: i for i in DEFAULT}
    return [default.get(k) or Item(k, LABELS[k], 5, False, False) for k in KEYS]


def weight_from_text(text: str) -> int:
    """Leading integer of what was typed, 0 if there is none or it is negative."""
    import re

    m = re.match(r"\s*([+-]?[0-9]+)", text or "")
    return max(0, int(m[1])) if m else 0


def weight_of(c: Column) -> Column:
    """weight_from_text of a column."""
    return F.greatest(F.lit(0), F.coalesce(F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0)))


def active(items: list[Item]) -> list[Item]:
    return [i for i in items if i.included]


def score(view: dict[str, Column], rubric: list[Item] | tuple[Item, ...] | None = None) -> Column:
    """struct<score, missing, ready> of a record seen as columns by field.

    No rubric means the default one; an empty rubric scores 0 and is never ready.
    """
    items = DEFAULT if rubric is None else rubric
    kind = "array<struct<field:string,label:string,required:boolean>>"
    if not len(items):
        return F.struct(F.lit(0).alias("score"), F.array().cast(kind).alias("missing"), F.lit(False).alias("ready"))
    total, earned, ready, missing = 0.0, F.lit(0.0), F.lit(True), []
    for i in items:
        weight = float(i.weight) if isinstance(i.weight, (int, float)) and not isinstance(i.weight, bool) else 0.0
        here = present(view[i.field]) if i.field in view else F.lit(False)
        total += weight
        earned = earned + F.when(here, weight).otherwise(0.0)
        if i.required:
            ready = ready & here
        missing.append(F.when(~here, F.struct(F.lit(i.field).alias("field"), F.lit(i.label).alias("label"), F.lit(bool(i.required)).alias("required"))))
    return F.struct(
        percent(earned, F.lit(total)).alias("score"), F.array_compact(F.array(*missing)).cast(kind).alias("missing"), ready.alias("ready")
    )


def missing_required(result: Column) -> Column:
    """Labels of the required fields that are missing, joined."""
    return F.array_join(F.transform(F.filter(result["missing"], lambda m: m["required"]), lambda m: m["label"]), "; ")


def columns_by_field() -> dict[str, Column]:
    return {k: F.col(column_of(k)) for k in KEYS}
