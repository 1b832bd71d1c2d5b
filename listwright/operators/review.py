"""Review decisions as an append-only ledger, folded to effects on records and groups.

What one person decides in a session is a short list, folded where it is (fold_ledger).  A
ledger that is a table, of many sessions or made by a rule, is folded by Spark (standing,
effects, resolutions) with the same result: which undo takes back which event follows from how
deep events are stacked, a running sum; what stands last of a record or group is an aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut


@dataclass(frozen=True)
class Event:
    action: str  # merge, keep, discard or undo
    ids: tuple[int, ...] = ()
    primary: int | None = None  # merge: the record that stays; by default the first


@dataclass
class State:
    """Excluded records (reason, merged into) and resolved groups."""

    records: dict[int, tuple[str | None, int | None]] = field(default_factory=dict)
    groups: dict[str, str] = field(default_factory=dict)


def key_of(ids: Iterable[int]) -> str:
    return "-".join(map(str, sorted(ids)))


def fold_ledger(events: Iterable[Event]) -> State:
    """State after all events; undo takes back the last one that changed anything and still stands.

    Every event that stands keeps what it overrode, so memory follows the number of changes.
    """
    now, stack = State(), []

    def put(table: dict, key, value) -> tuple:
        before = (table, key, key in table, table.get(key))
        table[key] = value
        return before

    for e in events:
        if e.action == "undo":
            for table, key, present, old in reversed(stack.pop() if stack else []):
                if present:
                    table[key] = old
                else:
                    del table[key]
            continue
        if e.action == "merge":
            primary = e.ids[0] if e.primary is None else e.primary
            changed = [put(now.records, i, (now.records.get(i, (None, None))[0], primary)) for i in e.ids if i != primary]
            changed.append(put(now.groups, key_of(e.ids), "merged"))
        elif e.action == "keep":
            changed = [put(now.groups, key_of(e.ids), "kept-separate")]
        elif e.action == "discard":
            if e.ids[0] in now.records:
                continue  # excluded already: nothing happens, nothing to undo
            changed = [put(now.records, e.ids[0], ("manual", None))]
        else:
            raise ValueError(f"unknown action {e.action}")
        stack.append(changed)
    return now


def effects_frame(spark: SparkSession, state: State) -> DataFrame:
    return spark.createDataFrame([(i, *x) for i, x in state.records.items()], "id long, exclude_reason string, merged_into long")


def resolutions_frame(spark: SparkSession, state: State) -> DataFrame:
    return spark.createDataFrame(list(state.groups.items()), "group_key string, resolution string")


def apply_effects(records: DataFrame, effects: DataFrame) -> DataFrame:
    """Records with what effects(id, exclude_reason, merged_into) says of them; one effect an id."""
    e = effects.select("id", F.col("exclude_reason").alias("_r"), F.col("merged_into").alias("_m"), F.lit(True).alias("_e"))
    joined = records.join(e, "id", "left")
    return joined.select(*[
        F.coalesce("_e", "excluded").alias(c) if c == "excluded"
        else F.coalesce("_r", "exclude_reason").alias(c) if c == "exclude_reason"
        else F.coalesce("_m", "merged_into").alias(c) if c == "merged_into"
        else F.col(c)
        for c in records.columns
    ])


def surviving(resolutions: DataFrame, groups: DataFrame) -> DataFrame:
    """Resolutions of groups that still exist."""
    return resolutions.join(groups.select("group_key"), "group_key", "left_semi")


def unresolved(groups: DataFrame, resolutions: DataFrame) -> DataFrame:
    return groups.join(resolutions, "group_key", "left_anti")


# A ledger as a table ------------------------------------------------------------------------------------

#: Later than any event.
NEVER = (1 << 63) - 1


def touches(events: DataFrame) -> DataFrame:
    """seq, action, id and primary, a row for each record an event changes (or one without id), of events(seq, action, ids, primary).

    seq orders the events and is theirs alone; primary is by default the first of ids.
    """
    known = events.select("seq", "action", "ids", F.coalesce("primary", F.try_element_at("ids", F.lit(1))).cast("long").alias("stays"))
    changed = F.when(F.col("action") == "merge", F.filter("ids", lambda i: i != F.col("stays"))).when(F.col("action") == "discard", F.slice("ids", 1, 1))
    rows = known.select("seq", "action", F.explode_outer(F.array_distinct(changed)).alias("id"), "stays")
    return rows.select("seq", "action", F.col("id").cast("long").alias("id"), F.when(F.col("action") == "merge", F.col("stays")).alias("primary"))


def running(rows: DataFrame, by: list[str], value: Column, how: Callable, name: str, last: int = 0) -> DataFrame:
    """rows with how(value) over the rows of by up to each (last = -1: before it), in order of seq.

    rows are cut by seq into parts (part).  A part is summed up by itself and the sums of the parts
    before it are added, so no window reads more than a part, or a row for each part.
    """
    here = how(value).over(Window.partitionBy(*by, "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, last))
    sums = rows.groupBy(*by, "part").agg(how(value).alias("_sum"))
    before = sums.select(*by, "part", how("_sum").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    both = F.coalesce(F.col("_before") + F.col("_here"), "_before", "_here") if how is F.sum else (F.least if how is F.min else F.greatest)("_before", "_here")
    return rows.withColumn("_here", here).join(before, [*by, "part"]).withColumn(name, both).drop("_here", "_before")


def taken_back(events: DataFrame) -> DataFrame:
    """seq and until, the seq of the undo that takes it back (null: none), of events(part, seq, action) that all take effect."""
    step = F.when(F.col("action") == "undo", -1).otherwise(1)
    deep = running(running(events, [], step, F.sum, "sum"), [], F.col("sum"), F.min, "least")
    # undo where nothing stands leaves the depth at 0; its level's last event is no push then
    depth = F.col("sum") - F.least("least", F.lit(0))
    levels = deep.select("part", "seq", "action", F.when(F.col("action") == "undo", depth + 1).otherwise(depth).alias("level"))
    this = F.struct("seq", "action")
    inside = F.lead(this).over(Window.partitionBy("level", "part").orderBy("seq"))
    firsts = levels.groupBy("level", "part").agg(F.min(this).alias("first"))
    behind = firsts.select("level", "part", F.lead("first").over(Window.partitionBy("level").orderBy("part")).alias("behind"))
    found = levels.withColumn("inside", inside).join(behind, ["level", "part"]).withColumn("after", F.coalesce("inside", "behind"))
    return found.where("action <> 'undo'").select("seq", F.when(F.col("after.action") == "undo", F.col("after.seq")).alias("until"))


def standing(touched: DataFrame, rounds: int = 1000) -> DataFrame:
    """The rows of touches(seq, action, id, primary) whose events took effect and were not taken back.

    A discard has no effect on a record that is excluded already, so what undo takes back
    depends on it, and it on what undo took back before.  All discards are taken to have effect at first;
    each round judges them by the last one's stack, and no later than after n rounds the first n
    are right.  Without any undo the first event of a record decides, in one pass.
    """
    rows = touched.where("action in ('merge', 'keep', 'discard', 'undo')")
    if rows.where("action = 'undo'").isEmpty():
        first = rows.where("id is not null").groupBy("id").agg(F.min("seq").alias("first"))
        known = rows.join(first, "id", "left").where("action <> 'discard' or seq = first")
        return known.select("seq", "action", "id", "primary")
    parts = cut(rows.repartitionByRange("seq").withColumn("part", F.spark_partition_id()))
    barred = None  # discards without effect
    for _ in range(rounds):
        live = parts if barred is None else parts.join(barred, "seq", "left_anti")
        until = cut(taken_back(live.select("part", "seq", "action").distinct()))
        spans = parts.where("id is not null").join(until.select("seq", F.coalesce("until", F.lit(NEVER)).alias("until")), "seq", "left")
        judged = running(spans, ["id"], F.col("until"), F.max, "covered", last=-1).where("action = 'discard' and covered > seq")
        now = cut(judged.select("seq"))
        if barred is None:
            same = now.isEmpty()
        else:
            same = now.join(barred, "seq", "full_outer").join(now.join(barred, "seq").select("seq"), "seq", "left_anti").isEmpty()
        if same:
            return live.where("action <> 'undo'").join(until.where("until is null"), "seq", "left_semi").select("seq", "action", "id", "primary")
        barred = now
    raise RuntimeError(f"not settled in {rounds} rounds")


def effects(stand: DataFrame) -> DataFrame:
    """id, exclude_reason and merged_into of every record that standing events exclude."""
    merge = F.col("action") == "merge"
    return stand.where("id is not null").groupBy("id").agg(
        F.max(F.when(~merge, "manual")).alias("exclude_reason"), F.max_by("primary", F.when(merge, F.col("seq"))).alias("merged_into")
    )


def resolutions(stand: DataFrame, keys: DataFrame) -> DataFrame:
    """group_key and resolution, the last that stands, of events whose group is in keys(seq, group_key)."""
    word = F.when(F.col("action") == "merge", "merged").when(F.col("action") == "keep", "kept-separate")
    said = stand.select("seq", word.alias("resolution")).where("resolution is not null").distinct()
    return said.join(keys, "seq").groupBy("group_key").agg(F.max_by("resolution", "seq").alias("resolution"))
