"""Ordered funnels over client timelines.

Timelines (client, time) are range-partitioned, so a frequent client's is cut into chunks like
the rest.  A chunk is read once, from its end to its start, and gives every row the time to
the client's next row of each kind; what lies beyond the time limit of a funnel is of no use,
so these are short numbers.  For the clients at its two ends a chunk publishes the first row
of each kind.  A suffix scan over these summaries (in blocks of FAN chunks, then blocks of
blocks) says what comes first behind a chunk, and only rows so near the end of their chunk
that something behind it is within the limit take it over.

Every row then knows its successors.  An attempt follows them by lookups: a step's row is
joined by (client, time) to the row that knows what comes next, and rows nobody reaches are
never looked up.  Order statistics are found by counts in three digits of the time, the
leading one first, so no group's times are ever brought together.  All these joins are merges of
shuffled rows: no side is sent to the executors whole, however small it may look.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discard, written

#: Chunks that one window of the suffix scan reads.
FAN = 64
#: Bits of a time that one pass of the order statistics settles.
DIGIT = 10


@dataclass(frozen=True)
class Funnel:
    name: str
    steps: tuple[str, ...]
    excluding: str | None = None


FUNNELS = (
    Funnel("A", ("view", "click", "view", "purchase"), "error"),
    Funnel("B", ("signup", "view", "click", "purchase"), "error"),
    Funnel("C", ("click", "click", "purchase", "view"), "signup"),
)
#: Microseconds from the first step in which all others have to come; the share of the order statistic in per cent.
WITHIN, PERCENT = 5 * 60 * 1_000_000, 25


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a time with or without a zone; the session's zone changes nothing of the latter."""
    c, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if not isinstance(kind, T.TimestampNTZType):
        c = c.try_cast("timestamp_ntz")
    day = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return ((day * 24 + F.hour(c)) * 60 + F.minute(c)) * 60_000_000 + second


def timeline(clicks: DataFrame, kinds: list[str]) -> DataFrame:
    """client_id, t and mask (a bit for each of at most 31 kinds) of the rows without nulls; one row a client and time."""
    bit = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(1 << i))])[F.col("kind").cast("string")]
    rows = clicks.select(F.col("client_id").try_cast("long").alias("client_id"), micros(clicks, "arrived_at").alias("t"), bit.alias("bit"))
    return rows.dropna().groupBy("client_id", "t").agg(F.bit_or("bit").alias("mask"))


def next_of(k: int) -> str:
    return f"next{k}"


def chunked(rows: DataFrame, kinds: int, within: int, chunks: int | None = None) -> DataFrame:
    """The rows with their successors within their chunk, and each chunk's summaries; written.

    next<k> is the time to the client's next row of kind k, null if that is not within the
    limit, or not in the chunk.  open: the row's client may go on in the next chunk, within the limit.
    Summaries have mask null, t the chunk's last time of the client, and in next<k> the
    time of the first row of kind k.
    """
    names = ["chunk", "client_id", "t", "mask", *map(next_of, range(kinds)), "open"]
    schema = pa.schema([("chunk", pa.int32()), ("client_id", pa.int64()), ("t", pa.int64()), ("mask", pa.int32()), *[(next_of(k), pa.int64()) for k in range(kinds)], ("open", pa.bool_())])
    none = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        first, end = np.full(kinds, none), 0  # of the client that is being read: first row of each kind so far, last time
        client = largest = None

        def out(client, t, mask, found, open_) -> pa.RecordBatch:
            n = len(client)
            columns = [pa.array(np.full(n, chunk, np.int32)), pa.array(client), pa.array(t), mask]
            columns += [pa.array(found[k], mask=found[k] == none) for k in range(kinds)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(open_)], schema=schema)

        def summary() -> pa.RecordBatch:
            return out(np.array([client]), np.array([end]), pa.nulls(1, pa.int32()), first[:, None].copy(), np.array([False]))

        for batch in batches:
            who, t, mask = (batch.column(c).to_numpy() for c in ("client_id", "t", "mask"))
            n = len(who)
            if not n:
                continue
            if largest is None:
                client = largest = who[0]
                end = t[0]
            if who[0] != client:
                if client == largest:
                    yield summary()
                client, end = who[0], t[0]
                first[:] = none
            # runs of one client; within a run the last place before i that has kind k holds the next time
            starts = np.concatenate(([0], np.flatnonzero(who[1:] != who[:-1]) + 1))
            run_of = np.repeat(starts, np.diff(np.append(starts, n)))
            place, found, known = np.arange(n), np.empty((kinds, n), np.int64), np.empty((kinds, n), np.int64)
            for k in range(kinds):
                latest = np.maximum.accumulate(np.where((mask >> k) & 1, place, -1))
                known[k] = np.where(latest >= run_of, t[latest], np.where(run_of == 0, first[k], none))  # the row itself included
                found[k, 0] = first[k]
                found[k, 1:] = np.where(starts_after(starts, n), none, known[k, :-1])
            away = np.where(found == none, none, found - t)
            away[away > within] = none
            # near enough to the end of its chunk for something behind it
            open_ = (who == largest) & (end - t <= within) & (found == none).any(axis=0)
            yield out(who, t, pa.array(mask.astype(np.int32)), away, open_)
            if who[-1] != client:  # a run has ended in this batch
                if client == largest:
                    last = starts[1] - 1
                    first = known[:, last].copy()
                    yield summary()
                client, end = who[-1], t[starts[-1]]
            first = known[:, n - 1].copy()
        if client is not None:
            yield summary()

    dealt = rows.repartitionByRange(*([chunks] if chunks else []), "client_id", "t").sortWithinPartitions(F.desc("client_id"), F.desc("t"))
    kind = ", ".join(f"{next_of(k)} long" for k in range(kinds))
    found = dealt.mapInArrow(run, f"chunk int, client_id long, t long, mask int, {kind}, open boolean")
    return written(found.select(*names), "chunks")


def starts_after(starts: np.ndarray, n: int) -> np.ndarray:
    """For the places 1 to n - 1: whether a new client begins there."""
    new = np.zeros(n, bool)
    new[starts] = True
    return new[1:]


def behind(summaries: DataFrame, kinds: int, fan: int = FAN) -> DataFrame:
    """chunk, client_id and in later<k> the first time of each kind in the client's later chunks: an exclusive suffix scan.

    Windows read fan chunks of a client; whole blocks are summed up and scanned in the same
    way, one level after another, until one block holds all that there are.
    """
    names = [next_of(k) for k in range(kinds)]
    most = summaries.agg(F.max("chunk").alias("m")).first().m or 0
    level = summaries.select("client_id", F.col("chunk").alias("at"), *names)
    rows, step = summaries.select("client_id", "chunk"), 1
    while True:
        block = F.floor(F.col("at") / fan).cast("int")
        later = Window.partitionBy("client_id", block).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
        here = level.select("client_id", F.col("at").alias("place"), *[F.min(n).over(later).alias(f"_{n}") for n in names])
        # each later block starts behind every row of this one, so the least of both levels is the first
        rows = rows.withColumn("place", F.floor(F.col("chunk") / step).cast("int")).join(here.hint("merge"), ["client_id", "place"], "left")
        old = [c for c in rows.columns if c in ("later" + n[4:] for n in names)]
        rows = rows.select("client_id", "chunk", *[(F.least(f"later{n[4:]}", f"_{n}") if old else F.col(f"_{n}")).alias(f"later{n[4:]}") for n in names])
        if most // step < fan:
            return rows
        level = level.groupBy("client_id", block.alias("at")).agg(*[F.min(n).alias(n) for n in names])
        step *= fan


def successors(clicks: DataFrame, kinds: list[str], within: int, chunks: int | None = None, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """client_id, t, mask and next<k>, the time to the client's next row of kind k if within the limit; and the written table it reads."""
    n = len(kinds)
    table = chunked(timeline(clicks, kinds), n, within, chunks)
    names = [next_of(k) for k in range(n)]
    carried = behind(table.where("mask is null"), n, fan)
    rows = table.where("mask is not null")
    ends = rows.where("open").join(carried.hint("merge"), ["chunk", "client_id"], "left")

    def late(k: int) -> Column:
        away = F.col(f"later{k}") - F.col("t")
        return F.coalesce(next_of(k), F.when(away <= within, away)).alias(next_of(k))

    closed = rows.where("not open").select("client_id", "t", "mask", *names)
    return closed.unionByName(ends.select("client_id", "t", "mask", *map(late, range(n)))), table


def choose(f: Column, funnels: tuple[Funnel, ...], value) -> Column:
    """value(funnel) of the funnel with the number in f."""
    out = F.lit(None).cast("long")
    for i, funnel in enumerate(funnels):
        v = value(funnel)
        if v is not None:
            out = F.when(f == i, v).otherwise(out)
    return out


def attempts(rows: DataFrame, funnels: tuple[Funnel, ...], kinds: list[str], within: int) -> tuple[DataFrame, DataFrame]:
    """Number of attempts (f, client_id, n1), and f, client_id and d, the times between the steps reached, of those beyond the first step."""
    number = {k: i for i, k in enumerate(kinds)}
    starts = F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(1 << number[x.steps[0]]) != 0, F.lit(i)) for i, x in enumerate(funnels)]), lambda x: x.isNotNull())
    first = rows.select("client_id", "t", *[next_of(k) for k in range(len(kinds))], F.explode(starts).alias("f"))
    counts = first.groupBy("f", "client_id").agg(F.count("*").alias("n1"))
    state = first.select("f", "client_id", F.col("t").alias("start"), F.col("t").alias("at"), F.lit(True).alias("on"), F.array().cast("array<long>").alias("d"), *[next_of(k) for k in range(len(kinds))])
    steps = max(len(x.steps) for x in funnels)
    for s in range(1, steps):
        gap = choose(F.col("f"), funnels, lambda x: F.col(next_of(number[x.steps[s]])) if s < len(x.steps) else None)
        barred = choose(F.col("f"), funnels, lambda x: F.col(next_of(number[x.excluding])) if x.excluding else None)
        reached = F.col("on") & F.col("_gap").isNotNull() & (F.col("at") + F.col("_gap") - F.col("start") <= within) & (F.col("_barred").isNull() | (F.col("_barred") > F.col("_gap")))
        judged = state.withColumn("_gap", gap).withColumn("_barred", barred).withColumn("on", F.coalesce(reached, F.lit(False)))
        if s == 1:
            judged = judged.where("on")
        # an attempt that has ended stays at its row, so its lookup finds that row and is spread like the others
        after = judged.select(
            "f", "client_id", "start", "on", F.when(F.col("on"), F.col("at") + F.col("_gap")).otherwise(F.col("at")).alias("at"),
            F.when(F.col("on"), F.concat("d", F.array("_gap"))).otherwise(F.col("d")).alias("d"),
        )
        if s < steps - 1:
            look = rows.select("client_id", F.col("t").alias("at"), *[next_of(k) for k in range(len(kinds))])
            state = after.join(look.hint("merge"), ["client_id", "at"])
        else:
            state = after
    return counts, state.select("f", "client_id", "d")


def order_statistics(times: DataFrame, by: list[str], percent: int, top: int) -> DataFrame:
    """by, n and value: the ceil(percent * n / 100)-th smallest of times(by, v), v from 0 to top.

    A pass counts by the leading digits of v that are not yet settled and keeps those that hold the
    one sought, so a group never has more than 2^DIGIT rows in a window.  Equal values are counted
    first: what is joined has each value once.
    """
    counted = times.groupBy(*by, "v").agg(F.count("*").alias("c"))
    passes = max(1, -(-int(top).bit_length() // DIGIT))
    sought = None
    for p in range(passes):
        low = DIGIT * (passes - 1 - p)
        digit = F.shiftright("v", low)
        if sought is None:
            found = counted.groupBy(*by, digit.alias("digit")).agg(F.sum("c").alias("c"))
            extra = []
        else:
            inside = counted.withColumn("above", F.shiftright("v", low + DIGIT)).join(sought.hint("merge"), [*by, "above"])
            found = inside.groupBy(*by, "n", "rank", digit.alias("digit")).agg(F.sum("c").alias("c"))
            extra = ["n", "rank"]
        upto = Window.partitionBy(*by).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        if sought is None:
            whole = Window.partitionBy(*by)
            found = found.withColumn("n", F.sum("c").over(whole)).withColumn("rank", F.expr(f"({int(percent)} * n + 99) div 100"))
        found = found.withColumn("upto", F.sum("c").over(upto)).where("rank > upto - c and rank <= upto")
        sought = found.select(*by, "n", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), F.col("digit").alias("above"))
    return sought.select(*by, "n", F.col("above").alias("value"))


def funnel_counts(clicks: DataFrame, funnels: tuple[Funnel, ...] = FUNNELS, within: int = WITHIN, percent: int = PERCENT, chunks: int | None = None, fan: int = FAN) -> DataFrame:
    """funnel, client_id, n1 to n<k>, deepest, t2 to t<k> and same_depth of clicks(client_id, kind, arrived_at).

    One row for each funnel and client with an attempt, k being the most steps of a funnel.
    Rows with a null in these columns and rows of no funnel's kinds take no part; repeated
    rows count once.  Rows of one client and time have no order: a next step is strictly
    later.  Where a funnel has fewer steps than k, the rest counts 0 and has null times.  Other columns
    are ignored whatever their names; an empty table gives no rows.
    """
    kinds = sorted({k for x in funnels for k in (*x.steps, *([x.excluding] if x.excluding else []))})
    most = max(len(x.steps) for x in funnels)
    rows, table = successors(clicks, kinds, within, chunks, fan)
    counts, reached = attempts(rows, funnels, kinds, within)
    counts, reached = written(counts, "attempts"), written(reached, "reached")
    discard(table)
    times = reached.select("f", "client_id", F.posexplode("d").alias("step", "v"))
    stats = order_statistics(times, ["f", "client_id", "step"], percent, within)
    wide = stats.groupBy("f", "client_id").agg(*[F.max(F.when(F.col("step") == s - 2, F.col(c))).alias(f"{x}{s}") for s in range(2, most + 1) for c, x in (("n", "n"), ("value", "t"))])
    deepest = F.lit(1)
    for s in range(2, most + 1):
        deepest = F.when(F.col(f"n{s}") > 0, F.lit(s)).otherwise(deepest)
    found = counts.join(wide.hint("merge"), ["f", "client_id"], "left").withColumn("deepest", deepest.cast("int"))
    # a row for each funnel and depth
    depth = F.broadcast(found.groupBy("f", "deepest").agg(F.count("*").alias("same_depth")))
    name = F.element_at(F.array(*[F.lit(x.name) for x in funnels]), F.col("f") + 1)
    return found.join(depth, ["f", "deepest"]).select(
        name.alias("funnel"), "client_id", "n1", *[F.coalesce(f"n{s}", F.lit(0)).cast("long").alias(f"n{s}") for s in range(2, most + 1)],
        "deepest", *[f"t{s}" for s in range(2, most + 1)], "same_depth",
    )
