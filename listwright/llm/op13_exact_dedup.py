"""Exact duplicates by a tree of sorted digest runs.

A document's key is the SHA-256 of its normalised text, verified by the text's length and a
second checksum beside it.  Each part of the table gives a run: its keys in order, each with
the smallest identifier it has seen (here the row that stays) and the number of rows.  Runs
are exchanged in rounds as in a binomial tree, FAN runs at a time: in each round a run keeps
one slice of the keys and sends the others to the partners that keep those, and what meets is
merged.  A round fixes the next bits of the run's number by bits of the key, so after all
rounds every run holds one slice of the keys, and no task ever held more than its slice.

Results go back the same way: classes are joined to the runs' keys, and those to the rows of
each run, so a text that a third of all rows share meets its rows run by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Runs that meet in one merge, as a power of two; the most runs, as a power of two.
FAN_BITS, MOST_BITS = 4, 14
SPACES = r"[\x20\x09-\x0D]+"
#: Nulls come last among identifiers.
KEY = ("sha", "bytes", "sum")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, "")


def digested(docs: DataFrame, runs: int) -> DataFrame:
    """run, row, doc_id, the key (sha, bytes, sum) and the number of code points of every row of docs.

    row is a number of the row's own; the table is written, so that runs and rows stay what they are.
    """
    text = F.col("_normal")
    rows = docs.select(
        F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"), F.monotonically_increasing_id().alias("row"), "doc_id",
        F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("points"), normalised(F.col("text")).alias("_normal"),
    )
    # F.transform binds the normalised text once
    found = F.transform(F.array(text), lambda t: F.struct(F.unhex(F.sha2(t.cast("binary"), 256)).alias("sha"), F.octet_length(t).alias("bytes"), F.xxhash64(t).alias("sum")))[0]
    return written(rows.withColumn("_key", found).select("run", "row", "doc_id", "points", *[F.col("_key")[c].alias(c) for c in KEY]), "digests")


def better() -> Column:
    """What is smallest of the row that stays: most code points, then doc_id, nulls last."""
    return F.struct((-F.col("points")).alias("fewer"), F.col("doc_id").isNull().alias("blank"), "doc_id", "row")


def slice_of(sha: Column, low: int, bits: int) -> Column:
    """Bits of the key, counted from its front, as a number: the bits low to low + bits."""
    first = F.conv(F.hex(F.substring(sha, 1, 4)), 16, 10).cast("long")
    return F.shiftright(first, 32 - low - bits).bitwiseAND(F.lit((1 << bits) - 1))


def merged(runs: DataFrame, run_bits: int) -> DataFrame:
    """One row a key, the best of all runs with the number of rows, after the rounds of exchange.

    runs(run, key, best, n) has each key once a run; run lies below 2^run_bits.
    """
    state, low = runs, 0
    while low < run_bits:
        bits = min(FAN_BITS, run_bits - low)
        mask = ((1 << bits) - 1) << low
        target = F.col("run").bitwiseAND(F.lit(~mask)).bitwiseOR(F.shiftleft(slice_of(F.col("sha"), low, bits), low).cast("int"))
        sent = state.withColumn("run", target.cast("int")).repartitionById(1 << run_bits, "run").sortWithinPartitions("run", *KEY)
        # dealt by run and in order of keys: this merges where the rows are
        state = sent.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        low += bits
    return state


def run_bits_of(docs: DataFrame, runs: int | None) -> int:
    """The power of two for the number of runs: as many as the session's shuffle partitions, or those asked for."""
    asked = runs or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_BITS, max(0, (asked - 1).bit_length()))


def copies(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs(doc_id, text).

    Texts are equal if they are the same without ASCII white space; null counts as empty, and
    all empty texts are one group.  Of a group the row with the most code points in its text
    stays, then the one with the smallest doc_id; a null doc_id comes last, and is keep_id
    only where all of the group's are null.  Of rows that are alike in both exactly one has
    kept.  Very long texts are digested whole.  Other columns are ignored whatever their
    names; an empty table gives no rows.
    """
    bits = run_bits_of(docs, runs)
    rows = digested(docs, 1 << bits)
    own = rows.select("run", *KEY, better().alias("best")).groupBy("run", *KEY).agg(F.min("best").alias("best"), F.count("*").alias("n"))
    classes = merged(own, bits).select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("kept_row"), F.col("n").alias("group_size"))
    known = rows.select("run", *KEY).distinct().join(classes, list(KEY))
    back = rows.join(known, ["run", *KEY])
    return back.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("kept_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
