"""Mixing sources to target weights by minimum-cost flow.

Documents are summed by membership pattern (the set of sources they belong to).  Each
pattern has as many tokens as its documents for every repetition, at a cost that rises with
the repetition, and may send them to any of its sources; each source asks for its quota.  The
cheapest flow says how many tokens of a pattern are used how often.  Within a pattern the
documents are taken in the order of a seeded hash: all of them for each full repetition, then
those whose running sum stays nearest to the rest.

The graph has one node a pattern and one a source; both are sums, so its size is the number
of distinct patterns, MAX_PATTERNS at most.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import words_sql, written

SEED, REPEATS, MAX_PATTERNS = 17, 3, 100_000
#: Cost of a token in its first, second and third use.
COSTS = (0, 1, 3)
CELLS = 4096


def targets(sizes: dict[str | None, int], total: int, repeats: int = REPEATS) -> dict[str | None, float]:
    """Quota by source: weights 1, 2, 3 repeating in order of code points (null last) share total;
    none exceeds repeats times its size, and what is over is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    quota: dict[str | None, Fraction] = {}
    left, free = Fraction(total), list(order)
    while free:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / whole > repeats * sizes[s]]
        if not over:
            return quota_floats(quota | {s: left * weight[s] / whole for s in free})
        for s in over:
            quota[s] = Fraction(repeats * sizes[s])
            free.remove(s)
        left = Fraction(total) - sum(quota.values())
    return quota_floats(quota)


def quota_floats(quota: dict) -> dict[str | None, float]:
    return {s: float(q) for s, q in quota.items()}


class Network:
    """Arcs with capacities; augment() adds the largest further flow (Dinic: layers, then blocking flows)."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.left: list[int] = []

    def arc(self, a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
        return len(self.to) - 2

    def augment(self, start: int, end: int) -> None:
        while True:
            layer = [-1] * len(self.out)
            layer[start], queue = 0, [start]
            for v in queue:
                for a in self.out[v]:
                    if self.left[a] and layer[self.to[a]] < 0:
                        layer[self.to[a]] = layer[v] + 1
                        queue.append(self.to[a])
            if layer[end] < 0:
                return
            at = [0] * len(self.out)
            path: list[int] = []
            v = start
            while True:
                if v == end:
                    least = min(self.left[a] for a in path)
                    for a in path:
                        self.left[a] -= least
                        self.left[a ^ 1] += least
                    k = next(i for i, a in enumerate(path) if not self.left[a])
                    v = self.to[path[k] ^ 1]
                    del path[k:]
                elif at[v] < len(self.out[v]):
                    a = self.out[v][at[v]]
                    if self.left[a] and layer[self.to[a]] == layer[v] + 1:
                        path.append(a)
                        v = self.to[a]
                    else:
                        at[v] += 1
                elif path:
                    v = self.to[path.pop() ^ 1]
                    at[v] += 1
                else:
                    break


def flow(supply: dict[tuple, int], quota: dict[str | None, int], costs: tuple[int, ...] = COSTS) -> dict[tuple, int]:
    """Tokens used of each pattern by the cheapest flow that meets the quotas as far as it can.

    start -> pattern (one arc a repetition) -> its sources -> end.  Only the first arcs cost
    anything, and a repetition costs as much for every pattern, so the flow is widened in the
    order of the costs: a path that is added never takes back flow at the start, and the sets
    of tokens that can flow together form a polymatroid, for which this greedy order is the
    cheapest.  One maximum flow a repetition, over one node a pattern and one a source.
    """
    patterns, sources = list(supply), list(quota)
    place = {s: len(patterns) + i for i, s in enumerate(sources)}
    start, end = len(patterns) + len(sources), len(patterns) + len(sources) + 1
    net = Network(end + 1)
    first = [net.arc(start, i, 0) for i in range(len(patterns))]
    for i, p in enumerate(patterns):
        for s in p:
            net.arc(i, place[s], len(costs) * supply[p])
    for s in sources:
        net.arc(place[s], end, quota[s])
    for _ in sorted(costs):
        for a, p in zip(first, patterns):
            net.left[a] += supply[p]
        net.augment(start, end)
    return {p: net.left[a + 1] for a, p in zip(first, patterns)}


def drawn(seed: int) -> Column:
    """The first 60 bits of a seeded digest of id and text: the place of a document in the order of its pattern."""
    text = F.coalesce(F.md5(F.col("text").cast("string").cast("binary")), F.lit(""))
    whole = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def mixed(docs: DataFrame, memberships: Column | None = None, seed: int = SEED, keep: list[str] = ["doc_id"]) -> DataFrame:
    """The columns keep of every row of docs, with size, source, source_size, target, taken and repeats.

    docs has doc_id, text and source; memberships is an array of all sources a document
    belongs to (by default its source alone).  size counts the words of the text (null: 0);
    taken is size times repeats, 0 to REPEATS.  A null source is a source of its own, last in
    order.  A null or empty membership belongs to no source and is never taken; a source that
    no document belongs to has size and target 0.  Documents without words are never taken.  Ties of the hash are settled by doc_id
    and size; rows that are alike in all of these are taken or left together.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    member = F.array(F.col("source").cast("string")) if memberships is None else memberships
    rows = docs.select(
        *keep, F.col("source").cast("string").alias("source"), F.array_sort(F.array_distinct(F.coalesce(member, F.array().cast("array<string>")))).alias("pattern"),
        F.expr(words_sql("text")).cast("long").alias("size"), drawn(seed).alias("o"),
    )
    rows = written(rows, "sizes")
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    supply = {tuple(r.pattern): r.size for r in sums}
    sizes: dict[str | None, int] = {}
    for p, n in supply.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    quota = targets(sizes, sum(supply.values()))
    used = flow(supply, {s: round(q) for s, q in quota.items()})
    plan = [(list(p), n, used[p] // n if n else 0, used[p] % n if n else 0) for p, n in supply.items()]
    plan_df = spark.createDataFrame(plan, "pattern array<string>, pattern_size long, full long, rest long")
    table = spark.createDataFrame([(s, sizes[s], quota[s]) for s in sizes], "source string, source_size long, target double")
    # MAX_PATTERNS rows at most
    rows = same(rows, F.broadcast(plan_df), "pattern")

    # the documents of the last, partial repetition: running sums by cells of the hash, then
    # by cells of the one cell in which the rest runs out, then by document
    cell = F.shiftright("o", 48)
    fine = F.pmod(F.shiftright("o", 36), F.lit(CELLS))
    rows = rows.withColumn("cell", cell).withColumn("fine", fine)
    edge = running(rows.where("rest > 0"), "cell")
    rows = same(rows, F.broadcast(edge), "pattern", "left")
    inner = rows.where("cell = cell_edge and rest > 0").withColumn("rest", F.col("rest") - F.col("cell_before"))
    edge2 = running(inner, "fine")
    rows = same(rows, F.broadcast(edge2), "pattern", "left")
    # those without words change no sum and stop nothing
    last = rows.where("rest > 0 and cell = cell_edge and fine = fine_edge and size > 0")
    by = Window.partitionBy("pattern").orderBy("o", "doc_id_", "size")
    # rows that are alike in all of this are one row of the window
    last = last.groupBy("pattern", "o", F.col(keep[0]).alias("doc_id_"), "size", "rest", "cell_before", "fine_before").agg(F.sum("size").alias("all"))
    last = last.withColumn("sum", F.sum("all").over(by))
    # a document is taken if that brings the sum nearer to the rest
    left = F.col("rest") - F.col("cell_before") - F.col("fine_before")
    taken = last.where(F.abs(F.col("sum") - left) <= F.abs(F.col("sum") - F.col("all") - left)).groupBy("pattern").agg(
        F.max(F.struct("o", F.col("doc_id_").alias("d"), F.col("size").alias("z"))).alias("stop")
    )
    rows = same(rows, F.broadcast(taken), "pattern", "left")
    mine = F.struct("o", F.col(keep[0]).alias("d"), F.col("size").alias("z"))
    more = (F.col("rest") > 0) & (
        (F.col("cell") < F.col("cell_edge"))
        | ((F.col("cell") == F.col("cell_edge")) & (F.col("fine") < F.col("fine_edge")))
        | ((F.col("cell") == F.col("cell_edge")) & (F.col("fine") == F.col("fine_edge")) & (mine <= F.col("stop")))
    )
    repeats = F.when(F.col("size") > 0, F.col("full") + F.coalesce(more.cast("long"), F.lit(0))).otherwise(F.lit(0))
    rows = rows.withColumn("repeats", repeats.cast("long")).withColumn("taken", F.col("size") * repeats)
    # one row a source
    rows = same(rows, F.broadcast(table), "source", "left")
    none = F.coalesce("source_size", F.lit(0).cast("long")).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target")
    return rows.select(*keep, "size", "source", *none, "taken", "repeats")


def same(left: DataFrame, right: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """Join on equal or both null values of a column, kept once."""
    r = right.withColumnRenamed(column, "_r")
    return left.join(r, left[column].eqNullSafe(r["_r"]), how).drop("_r")


def running(rows: DataFrame, cell: str) -> DataFrame:
    """pattern, the first cell whose running sum reaches the rest, and the sum before it.

    A pattern has at most CELLS cells, so its window holds that many rows.
    """
    cells = rows.groupBy("pattern", cell).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    by = Window.partitionBy("pattern").orderBy(cell)
    cells = cells.withColumn("sum", F.sum("n").over(by))
    return cells.where("sum >= rest and sum - n < rest").select(
        "pattern", F.col(cell).alias(f"{cell}_edge"), (F.col("sum") - F.col("n")).alias(f"{cell}_before")
    )
