"""Lists read in splits: a file of any size by as many tasks as Spark cuts it into.

Spark deals out byte ranges that end at line feeds.  Whether such a range begins inside quotes
depends on all before it, so a first pass gives for each range what it does to either state:
how the state, the line number and the record that is open go on.  These few numbers are put
together in order, and a second pass reads every range from its true state, with its true line
number.  A record that goes over the end of its range is left in pieces, which are put together
and read by themselves.  Text is never shuffled but for these pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.schema import FIELDS
from ..operators.lineage import cut
from ..operators.mapping import place_of
from .leads import DELIMITER_NAMES, EMPTY, EXTENSIONS, NO_ROWS, RAGGED, SPACES, UNTERMINATED, Leads, ParseError, detect_delimiter, records

#: Ranges up to this number go to the tasks as a small table, as the scheduler's own list of them does.
RANGES_SENT = 200_000
BREAK = re.compile(r"\r\n?|\n")


def outside(text: str, inside: bool) -> Iterator[tuple[int, str]]:
    """Place and text of the stretches outside quotes; every quote turns the state."""
    at = 0
    for k, stretch in enumerate(text.split('"')):
        if (k % 2 == 1) == inside:
            yield at, stretch
        at += len(stretch) + 1


def first_end(text: str, inside: bool) -> int:
    """Place behind the first end of a record, 0 if there is none."""
    for at, stretch in outside(text, inside):
        if m := BREAK.search(stretch):
            return at + m.end()
    return 0


def last_end(text: str, inside: bool) -> int:
    """Place behind the last end of a record, 0 if there is none."""
    found = 0
    for at, stretch in outside(text, inside):
        place = max(stretch.rfind("\n"), stretch.rfind("\r"))
        if place >= 0:
            found = at + place + 1
    return found


def lines_of(text: str, inside: bool) -> int:
    """Lines the text goes on by: all line feeds, and outside quotes lone carriage returns."""
    lone = sum(s.count("\r") - s.count("\r\n") for _, s in outside(text, inside)) if "\r" in text else 0
    return text.count("\n") + lone


def summary(text: str) -> tuple:
    """What a range does: turns the state or not; lines and whether a record ends in it, for either state; whether it is blank."""
    return text.count('"') % 2, lines_of(text, False), lines_of(text, True), first_end(text, False) > 0, first_end(text, True) > 0, not text.strip(SPACES)


def pieces(text: str, inside: bool, line: int, final: bool, delimiter: str) -> Iterator[tuple]:
    """('record', line, fields, line where an open quote ends or 0) of what lies in the range, ('head' or 'tail', line, text, 0) of what does not."""
    start = first_end(text, True) if inside else 0
    if inside and not start:
        yield "head", line, text, 0
        return
    if inside:
        yield "head", line, text[:start], 0
        line += lines_of(text[:start], True)
    body = text[start:]
    end = len(body) if final else last_end(body, False)
    for at, fields, open_end in records(body[:end], delimiter):
        yield "record", line + at - 1, fields, open_end and line + open_end - 1
    if end < len(body):
        yield "tail", line + lines_of(body[:end], False), body[end:], 0


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of its range), value and octets of the lines of path, in the order of the file within each range."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), meta["file_size"].alias("size"), F.make_valid_utf8("value").alias("value"), F.octet_length("value").alias("octets")
    )


def ranges(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """Each range's constant columns, its text (line feeds included, one too many at the end of some files) and its octets."""
    rows = (r for b in batches for r in zip(*(b[c] for c in columns), b["value"], b["octets"]))
    k = len(columns)
    for key, found in groupby(rows, key=itemgetter(*range(k))):
        held, octets = [], 0
        for r in found:
            held.append(r[k])
            octets += r[k + 1] + 1
        text = "\n".join(held) + "\n"
        yield key, text.removeprefix("﻿") if key[1] == 0 else text, octets


SUMMARY = "file string, start long, size long, octets long, turn int, lines0 int, lines1 int, ends0 boolean, ends1 boolean, blank boolean, delimiter string, headers array<string>"


def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for key, text, octets in ranges(batches, ["file", "start", "size"]):
        delimiter = headers = None
        if key[1] == 0:
            delimiter = detect_delimiter(text)
            first = next(records(text[: first_end(text, False) or len(text)], delimiter), None)
            headers = [h.strip(SPACES) for h in first[1]] if first else []
        yield pd.DataFrame([(*key, octets, *summary(text), delimiter, headers)], columns=[c.split()[0] for c in SUMMARY.split(", ")])


def states(found: DataFrame) -> DataFrame:
    """Of each range: inside (the state it begins in), line, owner (the range in which the record that is open began), final, open (whether the file's last line has no end), delimiter, width."""
    order = Window.partitionBy("file").orderBy("start")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = found.withColumn("inside", F.coalesce(F.sum("turn").over(before), F.lit(0)) % 2 == 1)
    s = s.withColumn("line", 1 + F.coalesce(F.sum(F.when(F.col("inside"), F.col("lines1")).otherwise(F.col("lines0"))).over(before), F.lit(0)))
    s = s.withColumn("final", F.lead("start").over(order).isNull())
    goes_on = (F.col("inside") != (F.col("turn") == 1)) & (~F.col("inside") | F.col("ends1")) & ~F.col("final")
    s = s.withColumn("owner", F.max(F.when(goes_on, F.col("start"))).over(before))
    # a byte order mark is not part of the lines
    s = s.withColumn("open", F.col("final") & (F.sum("octets").over(upto) > F.col("size")))
    head = lambda c: F.first(c, True).over(upto)
    return s.select("file", "start", "inside", F.col("line").cast("int").alias("line"), "owner", "final", "open", head("delimiter").alias("delimiter"), head("headers").alias("headers"), F.min("blank").over(upto).alias("blank"))


READ = "file string, start long, kind string, place int, line int, text string, fields array<string>, open_end int, delimiter string, width int"


def reading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in READ.split(", ")]
    columns = ["file", "start", "inside", "line", "owner", "final", "open", "delimiter", "width"]
    for (file, start, inside, line, owner, final, open_, delimiter, width), text, _ in ranges(batches, columns):
        held = []
        if open_:
            text = text[:-1]
        for place, (kind, at, what, open_end) in enumerate(pieces(text, bool(inside), int(line), bool(final), delimiter)):
            whole = kind == "record"
            # pieces belong to the range in which their record begins; there they come last
            mine = int(owner) if kind == "head" else start
            held.append((file, mine, kind, place if kind != "head" else int(start), at, None if whole else what, what if whole else None, open_end, delimiter, width))
            if len(held) == 5000:
                yield pd.DataFrame(held, columns=names)
                held = []
        yield pd.DataFrame(held, columns=names)


def read_ranges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The lists' states, a row a range, and all records: file, start, place, line, fields, open_end, width; both kept."""
    source = lines(spark, path)
    known = cut(states(source.mapInPandas(summaries, SUMMARY)))
    small = known.select("file", "start", "inside", "line", F.coalesce("owner", F.lit(-1)).alias("owner"), "final", "open", "delimiter", F.size("headers").alias("width"))
    sent = F.broadcast(small) if small.count() <= RANGES_SENT else small.hint("merge")
    read = cut(source.drop("size").join(sent, ["file", "start"]).mapInPandas(reading, READ))

    @F.pandas_udf("struct<line int, fields array<string>, open_end int>")
    def joined(text: pd.Series, line: pd.Series, delimiter: pd.Series) -> pd.DataFrame:
        out = []
        for t, k, d in zip(text, line, delimiter):
            one = next(records(t, d), None)
            out.append((k, one[1], one[2] and k + one[2] - 1) if one else (k, None, 0))
        return pd.DataFrame(out, columns=["line", "fields", "open_end"])

    order = F.array_sort(F.collect_list(F.struct(F.when(F.col("kind") == "tail", -1).otherwise(F.col("place")).alias("at"), "text", "line")))
    torn = read.where("kind <> 'record'").groupBy("file", "start", "delimiter", "width").agg(order.alias("p"))
    torn = torn.select("file", "start", F.lit((1 << 31) - 1).alias("place"), joined(F.array_join(F.transform("p", lambda x: x["text"]), ""), F.col("p")[0]["line"], F.col("delimiter")).alias("r"), "width")
    torn = torn.select("file", "start", "place", "r.line", "r.fields", "r.open_end", "width").where("fields is not null")
    whole = read.where("kind = 'record'").select("file", "start", "place", "line", "fields", "open_end", "width")
    return known, whole.unionByName(torn)


def numbered(rows: DataFrame, keep: Column) -> DataFrame:
    """rows where keep, with id, counting from 0 in each file: by range, then by place; offsets are a row a range."""
    kept = rows.where(keep)
    counts = kept.groupBy("file", "start").agg(F.count("*").alias("n"))
    offsets = counts.select("file", "start", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("file", "start").orderBy("place")) - 1
    return kept.withColumn("_local", local).join(offsets, ["file", "start"]).withColumn("id", F.col("_offset") + F.col("_local")).drop("_offset", "_local")


def split_leads(spark: SparkSession, path: str) -> Leads:
    """What leads.parse gives of one file, with rows and malformed rows as DataFrames; no string holds the file."""
    known, found = read_ranges(spark, path)
    heads = known.where("start = 0").select("file", "delimiter", "headers", "blank").limit(2).collect()
    if len(heads) > 1:
        raise ParseError("One list at a time; read_lists takes several.")
    if not heads or heads[0].blank:
        raise ParseError(EMPTY)
    head = heads[0]
    found = numbered(found, F.lit(True)).withColumnRenamed("id", "n")  # n = 0: the headers
    alone = (F.size("fields") == 1) & (F.col("fields")[0] == "")
    blank = (F.size("fields") == 1) & (T.trimmed(F.col("fields")[0]) == "")
    told, fits = (F.col("n") > 0) & ~blank, F.size("fields") == F.col("width")
    ends = found.agg(
        F.max(F.when(~alone, F.col("n"))).alias("last"), F.max_by("line", F.when(~alone, F.col("n"))).alias("line"), F.max_by("open_end", "n").alias("open_end"),
        F.count_if(told & fits).alias("n_rows"), F.count_if(told & ~fits).alias("n_malformed"),
    ).first()
    if ends.last is None:
        raise ParseError(NO_ROWS)
    if not head.headers or not ends.n_rows:
        raise ParseError("No data rows found.")
    data = found.where(told)
    rows = numbered(data.drop("n"), fits).select("id", "fields")
    reason = F.format_string(RAGGED.replace("{}", "%d"), "width", F.size("fields"))
    malformed = data.where(~fits).select("line", F.array_join("fields", head.delimiter).alias("raw"), reason.alias("reason"))
    if ends.open_end:
        line = ends.line if ends.last > 0 else ends.open_end
        malformed = malformed.unionByName(spark.createDataFrame([(line, "(end of file)", UNTERMINATED)], "line int, raw string, reason string"))
    return Leads(list(head.headers), head.delimiter, ends.last, rows, malformed, ends.n_rows, ends.n_malformed + bool(ends.open_end))


def list_summaries(spark: SparkSession, path: str) -> DataFrame:
    """A row a list: source_file, rows (well-formed), delimiter (its name), malformed, error; counted in one pass over all lists.

    Blank lists have no delimiter and an error, files without a byte no row; a list whose last quote is
    open has one malformed record more.
    """
    known, found = read_ranges(spark, path)
    heads = known.where("start = 0").select("file", "delimiter", "headers", "blank")
    blank = (F.size("fields") == 1) & (T.trimmed(F.col("fields")[0]) == "")
    alone = (F.size("fields") == 1) & (F.col("fields")[0] == "")
    place, fits = F.struct("start", "place"), F.size("fields") == F.col("width")
    # the first record of a list holds its headers and is taken off again
    told = lambda c: F.count_if(c) - F.min_by(c.cast("long"), place)
    counts = found.groupBy("file").agg(told(~blank & fits).alias("rows"), told(~blank & ~fits).alias("ragged"), F.max_by("open_end", place).alias("open_end"), F.count_if(~alone).alias("filled"))
    name = F.create_map(*[F.lit(x) for pair in DELIMITER_NAMES.items() for x in pair])
    error = F.when(F.col("blank"), EMPTY).when(F.coalesce("filled", F.lit(0)) == 0, NO_ROWS).when(F.coalesce("rows", F.lit(0)) == 0, "No data rows found.")
    return heads.join(counts, "file", "left").select(
        F.col("file").alias("source_file"), F.coalesce("rows", F.lit(0)).alias("rows"), F.when(~F.col("blank"), name[F.col("delimiter")]).alias("delimiter"),
        F.coalesce(F.col("ragged") + F.when(F.col("open_end") > 0, 1).otherwise(0), F.lit(0)).alias("malformed"), error.alias("error"),
    )


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """Rows of several lists, each mapped by its own headers: source_file, row, id (of all lists) and a column a canonical field.

    The mapping is data: each list's headers give the places of the fields, which are joined to
    its rows.  id holds the list's number, by name, above 40 bits and the row below.  Lists
    without a company column or without well-formed rows give none.
    """
    known, found = read_ranges(spark, path)
    heads = known.where("start = 0 and not blank")
    number = (F.row_number().over(Window.orderBy("file")) - 1).cast("long")  # a row a list
    placed = heads.select("file", number.alias("list"), *[place_of(F.col("headers"), k).alias(k) for k, _, _ in FIELDS]).where("company > 0")
    ordered = numbered(found, F.lit(True)).where("id > 0").drop("id")
    fits = (F.size("fields") == F.col("width")) & ~((F.size("fields") == 1) & (T.trimmed(F.col("fields")[0]) == ""))
    rows = numbered(ordered, fits).select("file", F.col("id").alias("row"), "fields").join(placed, "file")
    value = lambda k: F.when(F.col(k) > 0, F.try_element_at("fields", F.col(k))).otherwise("").alias(k)
    return rows.select(F.col("file").alias("source_file"), "row", (F.shiftleft("list", 40) + F.col("row")).alias("id"), *[value(k) for k, _, _ in FIELDS])
