"""Headers to canonical fields, settled while the plan is built."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.schema import FIELDS, KEYS
from ..sources.leads import SPACES


class MappingError(ValueError):
    """The mapping lacks a mandatory field or names an unknown header."""


def normalize_header(h: str | None) -> str:
    return re.sub(f"[{SPACES}]+", " ", re.sub("[_-]+", " ", (h or "").strip(SPACES).lower()))


def normalized_header(c: Column) -> Column:
    """normalize_header of a column."""
    return F.regexp_replace(F.regexp_replace(F.lower(text.trimmed(c)), "[_-]+", " "), rf"{text.SPACE}+", " ")


def place_of(headers: Column, key: str) -> Column:
    """Where the value of a canonical field stands in a column of headers, from 1 (0: nowhere).

    The first header that fits gives the name, the last header of that name the place.
    """
    aliases = next(a for k, _, a in FIELDS if k == key)
    fits = F.filter(headers, lambda h: normalized_header(h).isin(*aliases))
    last = F.size(headers) - F.array_position(F.reverse(headers), fits[0]) + 1
    return F.when(F.size(fits) > 0, last).otherwise(0).cast("int")


def suggest_mapping(headers: list[str]) -> dict[str, str | None]:
    """For each field the first header, not yet used, whose normal form is one of its aliases."""
    found: dict[str, str | None] = {}
    for key, _, aliases in FIELDS:
        fits = (h for h in headers if h not in found.values() and normalize_header(h) in aliases)
        found[key] = next(fits, None)
    return found


def confirm_mapping(headers: list[str], mapping: dict[str, str | None]) -> dict[str, str | None]:
    """The mapping of all fields, if company is mapped; a header may serve several fields."""
    unknown = [h for h in mapping.values() if h and h not in headers]
    if unknown or set(mapping) - set(KEYS):
        raise MappingError(f"unknown headers or fields: {unknown or sorted(set(mapping) - set(KEYS))}")
    if not mapping.get("company"):
        raise MappingError("Map the company column before going on.")
    return {k: mapping.get(k) for k in KEYS}


def named_rows(rows: DataFrame, headers: list[str]) -> DataFrame:
    """rows(id, fields) with a column a header; of equal headers the last counts."""
    last = {h: i for i, h in enumerate(headers)}
    return rows.select("id", *[F.coalesce(F.try_element_at("fields", F.lit(i + 1)), F.lit("")).alias(h) for h, i in last.items()])
