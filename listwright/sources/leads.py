"""Tolerant reader of delimited contact lists.

Rules and messages are here, for texts that are values; splits.py reads files by them, in as
many tasks as a file has splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import cut

SPACES = "\t\n\x0b\x0c\r \xa0                　﻿"
DELIMITERS = (",", ";", "\t")
DELIMITER_NAMES = dict(zip(DELIMITERS, ("comma", "semicolon", "tab")))
EXTENSIONS = ("csv", "tsv", "txt")
LINE_END = re.compile(r"\r\n|\r|\n")
INSIDE = re.compile(r'[^"]+|""|"')
#: Messages of the reader.
UNTERMINATED = "Unterminated quoted field at end of file — last record may be truncated."
NOT_TEXT, EMPTY, NO_ROWS = "Input is not text.", "File is empty.", "File has no rows."
RAGGED = "Expected {} columns, found {}."


class ParseError(ValueError):
    """The list cannot be imported."""


@dataclass
class Parsed:
    delimiter: str = ","
    headers: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    malformed: list[tuple[int, str, str]] = field(default_factory=list)
    total: int = 0
    error: str | None = None


def strip_bom(text):
    return text[1:] if isinstance(text, str) and text.startswith("﻿") else text


def detect_delimiter(text: str) -> str:
    """The most frequent candidate outside quotes in the first ten physical lines; ties go to the earlier one."""
    head = "\n".join(LINE_END.split(text, maxsplit=10)[:10])
    bare = "".join(head.split('"')[::2])  # every quote toggles
    return max(DELIMITERS, key=lambda d: (bare.count(d), -DELIMITERS.index(d)))


def records(text: str, delimiter: str) -> Iterator[tuple[int, list[str], int]]:
    """Start line, fields, and the current line if the text ends inside quotes (else 0), of every record."""
    plain = re.compile(rf'[^"\r\n{re.escape(delimiter)}]+|\r\n?|.|\n')
    fields, parts, quoted, line, start, at = [], [], False, 1, 1, 0
    while at < len(text):
        m = (INSIDE if quoted else plain).match(text, at)
        token, at = m[0], m.end()
        if quoted:
            if token == '"':
                quoted = False
            else:
                parts.append('"' if token == '""' else token)
                line += token.count("\n")
        elif token == '"':
            quoted = True
        elif token == delimiter or token[0] in "\r\n":
            fields.append("".join(parts))
            parts = []
            if token != delimiter:
                yield start, fields, 0
                fields, line = [], line + 1
                start = line
        else:
            parts.append(token)
    if fields or any(parts):
        yield start, [*fields, "".join(parts)], line if quoted else 0


def parse(text) -> Parsed:
    """Headers, well-formed rows and malformed ones; errors are values."""
    if not isinstance(text, str):
        return Parsed(error=NOT_TEXT)
    text = strip_bom(text)
    if not text.strip(SPACES):
        return Parsed(error=EMPTY)
    out = Parsed(delimiter=detect_delimiter(text))
    found = list(records(text, out.delimiter))
    open_end = found[-1][2] if found else 0
    while found and found[-1][1] == [""]:
        found.pop()
    if not found:
        out.error = NO_ROWS
        return out
    out.headers = [h.strip(SPACES) for h in found[0][1]]
    data, width = found[1:], len(out.headers)
    out.total = len(data)
    for line, fields, _ in data:
        if len(fields) == 1 and not fields[0].strip(SPACES):
            continue
        if len(fields) == width:
            out.rows.append(fields)
        else:
            out.malformed.append((line, out.delimiter.join(fields), RAGGED.format(width, len(fields))))
    if open_end:
        out.malformed.append((data[-1][0] if data else open_end, "(end of file)", UNTERMINATED))
    return out


def rows_to_maps(headers: list[str], rows: list[list[str]]) -> list[dict[str, str]]:
    """Rows by header: what is missing is empty, of equal headers the last counts."""
    return [{h: (r[i] if i < len(r) else "") for i, h in enumerate(headers)} for r in rows]


PARSED = T.StructType([
    T.StructField("source_file", T.StringType()), T.StructField("delimiter", T.StringType()), T.StructField("headers", T.ArrayType(T.StringType())),
    T.StructField("total", T.LongType()), T.StructField("error", T.StringType()), T.StructField("id", T.LongType()), T.StructField("fields", T.ArrayType(T.StringType())),
    T.StructField("line", T.IntegerType()), T.StructField("raw", T.StringType()), T.StructField("reason", T.StringType()),
])


def parse_texts(texts: DataFrame) -> DataFrame:
    """One row for the file (id and line null), each well-formed row (id) and each malformed one (line) of texts(source_file, value)."""

    def run(batches):
        for batch in batches:
            for name, text in zip(batch["source_file"], batch["value"]):
                p = parse(text)
                rows = [(name, p.delimiter, p.headers, p.total, p.error, None, None, None, None, None)]
                rows += [(name, None, None, None, None, i, r, None, None, None) for i, r in enumerate(p.rows)]
                rows += [(name, None, None, None, None, None, None, *m) for m in p.malformed]
                for k in range(0, len(rows), 10_000):
                    out = pd.DataFrame(rows[k : k + 10_000], columns=PARSED.names)
                    yield out.astype({"total": "Int64", "id": "Int64", "line": "Int32"})

    return texts.select("source_file", "value").mapInPandas(run, PARSED)


class ListRows:
    """Table function: a row for each well-formed record of a text (id and fields) and each malformed one (line, raw, reason)."""

    def eval(self, text: str):
        p = parse(text)
        for i, fields in enumerate(p.rows):
            yield i, fields, None, None, None
        for line, raw, reason in p.malformed:
            yield None, None, line, raw, reason


def register_table_function(spark: SparkSession, name: str = "leads") -> None:
    """SELECT ... FROM texts, LATERAL leads(texts.value): the reader's rules in SQL."""
    spark.udtf.register(name, F.udtf(ListRows, returnType="id long, fields array<string>, line int, raw string, reason string"))


@dataclass
class Leads:
    """A parsed list: headers and delimiter as values, rows and malformed rows as DataFrames."""

    headers: list[str]
    delimiter: str
    total: int
    rows: DataFrame  # id, fields
    malformed: DataFrame  # line, raw, reason
    n_rows: int  # counted by the job that checks the list
    n_malformed: int

    def summary(self) -> str:
        return f"{self.n_rows} rows, {DELIMITER_NAMES[self.delimiter]} delimited, {self.n_malformed} malformed"


def from_parsed(parsed: DataFrame) -> Leads:
    """Checks what an import needs: no parse error, headers, and at least one well-formed row."""
    parsed = cut(parsed)  # parsed once, for these checks and what follows
    head = parsed.agg(
        F.first(F.when(F.col("headers").isNotNull(), F.struct("delimiter", "headers", "total", "error")), True).alias("head"),
        F.count("id").alias("n_rows"), F.count("line").alias("n_malformed"),
    ).select("head.*", "n_rows", "n_malformed").first()
    if head.headers is None:
        raise ParseError(EMPTY)
    if head.error:
        raise ParseError(head.error)
    if not head.headers or not head.n_rows:
        raise ParseError("No data rows found.")
    rows, malformed = parsed.where("id is not null").select("id", "fields"), parsed.where("line is not null").select("line", "raw", "reason")
    return Leads(list(head.headers), head.delimiter, head.total, rows, malformed, head.n_rows, head.n_malformed)


def read_leads(spark: SparkSession, path: str) -> Leads:
    """A csv, tsv or txt file of any size (UTF-8; bytes that are not become U+FFFD), read in splits."""
    from .splits import split_leads

    if path.rsplit(".", 1)[-1].lower() not in EXTENSIONS:
        raise ParseError("Only .csv, .tsv and .txt files are read.")
    return split_leads(spark, path)


def leads_from_text(spark: SparkSession, text: str) -> Leads:
    return from_parsed(parse_texts(spark.createDataFrame([("text", text)], "source_file string, value string")))


def load_sample(spark: SparkSession) -> Leads:
    """The list that comes with the package, read like any other text."""
    from importlib.resources import files

    return leads_from_text(spark, files("listwright.sources").joinpath("sample.csv").read_bytes().decode("utf-8"))


def read_leads_fast(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Spark's own CSV reader, for clean files only: splits, but has no malformed channel."""
    df = spark.read.csv(path, header=True, sep=delimiter, escape='"', multiLine=False)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
