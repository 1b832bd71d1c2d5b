"""Near-duplicate documents by min-max hashing, with exact confirmation on full shingle sets.

1. Every document becomes the sorted set of its shingles' 64-bit hashes.  Documents of equal
   sets share a 128-bit digest and from here on are one node, however many they are.
2. One hash evaluation per permutation gives two signature values, the smallest and the
   largest.  Five values make a band; two nodes that share a band's key share a bucket.
3. In every bucket the others are held against one hub, which differs from band to band, so
   candidates stay in proportion to the members.  What is confirmed on full sets forms
   components.
4. In a bucket that still holds several components, the others meet the largest.  All that
   meet one component are held against it and each other in a grid of blocks of bounded
   size, so no rows are made for pairs.  No bucket, candidate or partner is capped.

Two nodes of similarity 0.8 share no bucket with probability (1 - 0.8^5)^24 = 7e-5; at 0.85
it is 2e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STEP, components, discard, hashing, mixed, word_hashes, written

BANDS, ROWS = 24, 5
PERMUTATIONS = BANDS * ROWS // 2
#: Sketches of 120 bits differ in 12 bits on average at similarity 0.8 (deviation 3.3).
SKETCH_BITS = 30
#: Nodes of a side of a block at least (for larger groups the root of their number), and bytes of their sets at most.
BLOCK, BLOCK_BYTES = 128, 8_000_000
#: Nodes held against a hub in a block, and blocks of a hub that are dealt out together.
STAR, SLAB = 32, 1024
#: Parts of each row in joins on what many rows share.
SALTS = 32
#: Classes of over a 1 / HOT_KEYS of all rows are never dealt to one task.
HOT_KEYS = 1000
_rng = np.random.default_rng(20240917)
MULTIPLIERS = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of width words; fewer words make one shingle."""
    h = word_hashes(text)
    if not len(h):
        return np.empty(0, np.uint64)
    n = len(h) - width + 1
    if n < 1:
        n, width = 1, len(h)
    s = np.full(n, np.uint64(width))
    for i in range(width):
        s = mixed(s * STEP + h[i : i + n])
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def signature(s: np.ndarray) -> np.ndarray:
    """Smallest and largest value under every permutation, side by side."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for k in range(0, len(s), 2048):
        x = (s[None, k : k + 2048] ^ MASKS[:, None]) * MULTIPLIERS[:, None]
        x ^= x >> np.uint64(32)
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.column_stack((low, high)).ravel()


def banded(v: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Keys of the bands; the lowest bit of every value as a sketch of two longs."""
    v = mixed(v * STEP)
    # values of one permutation go to different bands
    keys = np.full(BANDS, STEP)
    for row in v.reshape(ROWS, BANDS):
        keys = mixed(keys * STEP + row)
    bits = np.packbits((v & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes().ljust(16, b"\0")
    return keys, [int.from_bytes(bits[i : i + 8], "little", signed=True) for i in (0, 8)]


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def identified(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, h (hash of the text), n, node (digest; null if there is no word), bands and sketch of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashing()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingle_set(text, width)
                if len(s):
                    keys, sketch = banded(signature(s))
                    rows.append((len(s), digest(s), keys.view(np.int64), *sketch))
                else:
                    rows.append((0, None, None, None, None))
            out = pd.DataFrame(rows, columns=["n", "node", "bands", "k1", "k2"])
            out[["k1", "k2"]] = out[["k1", "k2"]].astype("Int64")
            for i, c in enumerate(("doc_id", "h")):
                out.insert(i, c, batch[c].values)
            yield out

    # as text, since large numbers beside nulls would be rounded
    found = identified(docs).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        run, "doc_id string, h long, n long, node binary, bands array<long>, k1 long, k2 long"
    )
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    low, high = sorted((len(a), len(b)))
    if 100 * low < percent * high:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, its set (as bytes) and sketch for wanted(own, node, k1, k2); own has the doc_id and h of one row of the node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashing()
        for batch in batches:
            rows, seen = [], set()
            for text, node, k1, k2 in zip(batch["text"], batch["node"], batch["k1"], batch["k2"]):
                if bytes(node) in seen:
                    continue
                s = shingle_set(text, width)
                if digest(s) == bytes(node):
                    seen.add(bytes(node))
                    rows.append((node, s.tobytes(), k1, k2))
            yield pd.DataFrame(rows, columns=["node", "s", "k1", "k2"])

    d, w = identified(docs), wanted
    # rows that share an id, or have none, still differ by their text
    found = d.join(w, (d["h"] == w["own.h"]) & d["doc_id"].eqNullSafe(w["own.doc_id"])).select(d["text"], w["node"], w["k1"], w["k2"])
    return found.mapInPandas(run, "node binary, s binary, k1 long, k2 long").dropDuplicates(["node"])


def confirmed(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the rows of each block.

    blocks(block, side, comp, node, s, k1, k2): every node of side 1 is held against every
    node of side 0, first by sketch; one link for two components is enough.  Nodes that stand
    on both sides of a grid are held against each other once.  A block has
    at most about 2 * BLOCK_BYTES of sets.
    """

    def links(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        left = [r for r in rows if r[1] == 1]
        right = [r for r in rows if r[1] != 1]
        if not left or not right:
            return
        kl, kr = (np.array([r[5:7] for r in side], np.int64).view(np.uint64) for side in (left, right))
        apart = np.bitwise_count(kl[:, None] ^ kr[None]).astype(np.int16).sum(axis=2)
        found = set()
        for i, j in zip(*(x.tolist() for x in np.nonzero(apart <= SKETCH_BITS))):
            (_, _, ca, a, x, _, _), (_, side, cb, b, y, _, _) = left[i], right[j]
            if ca != cb and (side == 0 or a < b) and (ca, cb) not in found and similar(x, y, percent):
                found.add((ca, cb))
                yield a, b

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        hashing()
        for batch in batches:
            out: list[tuple] = []
            for block, side, comp, node, s, k1, k2 in batch.itertuples(index=False, name=None):
                if held and held[0][0] != block:
                    out += links(held)
                    held = []
                held.append((block, side, bytes(comp), bytes(node), np.frombuffer(s, np.uint64), k1, k2))
            yield pd.DataFrame(out, columns=["a", "b"])
        yield pd.DataFrame(list(links(held)), columns=["a", "b"])

    return (
        blocks.select("block", "side", "comp", "node", "s", "k1", "k2")
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInPandas(run, "a binary, b binary")
    )


def hub_sizes(stars: DataFrame, star: int = STAR) -> DataFrame:
    """Number of members (weight) and of blocks (parts) of each hub (other) of stars(node, n, other).

    A hub has a block for every star members or BLOCK_BYTES of their sets of n hashes.
    """
    return stars.groupBy("other").agg(
        F.count("*").alias("weight"), F.expr(f"greatest(ceil(count(*) / {star}), ceil(8 * sum(n) / {BLOCK_BYTES}))").alias("parts")
    )


def star_blocks(stars: DataFrame, sized: DataFrame, sets: DataFrame, slab: int = SLAB) -> DataFrame:
    """Blocks, as confirmed takes them, of stars(node, n, other), nodes and a hub of theirs, under their hub_sizes.

    A hub's set is sent once a block, not once a member.  Hubs of over slab blocks are dealt out slab by slab.
    """

    def block(part: Column) -> Column:
        return F.concat("other", F.lit(b"/"), part.cast("string").cast("binary")).alias("block")

    around = looked_up(stars, sized, "other").join(sets, "node").select(
        block(F.pmod(F.xxhash64("node"), "parts")), F.lit(1).alias("side"), F.col("node").alias("comp"), "node", "s", "k1", "k2"
    )
    held = sized.join(sets.withColumnRenamed("node", "other"), "other")
    few = held.where(F.col("parts") <= slab).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    many = held.where(F.col("parts") > slab).withColumn("slab", F.explode(F.expr(f"sequence(0, (parts - 1) div {slab})"))).repartition("other", "slab")
    many = many.withColumn("part", F.explode(F.expr(f"sequence(slab * {slab}, least(parts, (slab + 1) * {slab}) - 1)"))).drop("slab")
    hubs = few.unionByName(many).select(
        block(F.col("part")), F.lit(0).alias("side"), F.col("other").alias("comp"), F.col("other").alias("node"), "s", "k1", "k2"
    )
    return around.unionByName(hubs)


def classes(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, root (the class itself) and h (hash of the text) of every row of docs.

    Documents whose sets have 100 * intersection >= percent * union are linked; component_id
    is the smallest doc_id reachable.  Texts that are null or have no word have an empty set
    and are linked with nothing (root null).  Rows with a null id take part; a class of only
    such rows has a null component_id.  Repeated rows get the same answer each.  Other
    columns of docs are ignored; an empty table gives no rows.
    """
    rows = written(described(docs, width), "minmax")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "h")).alias("own"), F.first("bands").alias("bands"),
        F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("n").alias("n"), F.count("*").alias("copies"),
    )
    member = nodes.select("node", "doc_id", "k1", "k2", "n", F.posexplode("bands").alias("band", "key"))
    sizes = (
        member.groupBy("band", "key")
        .agg(F.count("*").alias("members"),
             F.min(F.struct(F.xxhash64("node", "band").alias("o"), "node", "doc_id", "n", "k1", "k2")).alias("hub"))
        .where("members > 1")
    )
    buckets = written(member.join(sizes, ["band", "key"]), "buckets")
    close = f"bit_count(k1 ^ hub.k1) + bit_count(k2 ^ hub.k2) <= {SKETCH_BITS}"
    alike = f"100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)"
    stars = (
        buckets.where(f"node != hub.node and {close} and {alike}")
        .groupBy("node", F.col("hub.node").alias("other"))
        .agg(F.count("*").alias("shared"), F.max("n").alias("n"))
        .groupBy("node")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("o"), "other"))), 1, 4).alias("hubs"), F.max("n").alias("n"))
        .select("node", "n", F.explode("hubs.other").alias("other"))
    )
    # a document has 24 hubs at most; the four it shares most bands with are tried first, and
    # what stays apart is compared in full below
    stars = written(stars, "stars")
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "own", "k1", "k2")
    sets = written(sets_of(docs, wanted, width), "sets")

    sized = written(hub_sizes(stars), "sized")
    links = written(confirmed(star_blocks(stars, sized, sets), percent), "links")
    near = components(links)

    def root(df: DataFrame) -> DataFrame:
        return df.join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))

    # components that still meet in a bucket: all others against the largest and each other
    comp = written(root(sets.select("node", F.octet_length("s").cast("long").alias("bytes"))), "components")
    total = comp.groupBy("root").agg(F.count("*").alias("members"), F.sum("bytes").alias("bytes"))
    found = met = written(root(buckets.select("band", "key", "node")).groupBy("band", "key", "root").agg(F.count("*").alias("here")), "met")
    shared = total.select("root", "members").join(met.groupBy("root").agg(F.count("*").alias("weight")), "root")
    met = looked_up(met.drop("here"), shared, "root")
    largest = met.groupBy("band", "key").agg(
        F.count("*").alias("roots"), F.max(F.struct("members", "root")).alias("big")
    ).where("roots > 1")
    apart = met.join(largest, ["band", "key"]).where("root != big.root").selectExpr("big.root as big", "root as small").distinct()
    apart = written(apart, "apart")
    # a grid of blocks for each of these: what meets it, by itself and what meets it
    left = spread(comp.selectExpr("root as small", "node", "bytes"), apart, "small", F.col("node")).selectExpr("big", "small as comp", "node", "bytes")
    meeting = left = written(left, "left")
    mine = spread(comp.selectExpr("root as big", "node"), apart.select("big").distinct(), "big", F.col("node")).selectExpr("big", "big as comp", "node")
    load = left.groupBy("big").agg(F.count("*").alias("n_left"), F.sum("bytes").alias("b_left")).join(total.withColumnRenamed("root", "big"), "big")
    load = load.selectExpr(
        "big", f"greatest(ceil((n_left + members) / greatest({BLOCK}, sqrt(n_left + members))), ceil((b_left + bytes) / {BLOCK_BYTES})) as ys",
        f"greatest(ceil(n_left / greatest({BLOCK}, sqrt(n_left + members))), ceil(b_left / {BLOCK_BYTES})) as xs",
    )
    load = written(load, "load")
    part = "pmod(xxhash64(node), {0})"
    block = F.concat("big", F.lit(b"/"), F.concat_ws("/", F.col("i").cast("string"), F.col("j").cast("string")).cast("binary"))
    right = left.selectExpr("big", "comp", "node", "2 as side").union(mine.selectExpr("big", "comp", "node", "0 as side"))
    left = spread(left, load, "big", F.col("node")).selectExpr("big", "comp", "node", "1 as side", f"{part.format('xs')} as i", "explode(sequence(0, ys - 1)) as j")
    right = spread(right, load, "big", F.col("node")).selectExpr("big", "comp", "node", "side", "explode(sequence(0, xs - 1)) as i", f"{part.format('ys')} as j")
    blocks = left.union(right).select(block.alias("block"), "side", "comp", "node")
    more = confirmed(blocks.join(sets, "node"), percent)
    labels = components(links.union(more))

    named = nodes.select("node", "doc_id", "copies").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named, "roots")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("weight"))
    of_node = looked_up(named.drop("doc_id"), least, "root").select("node", "root", "component_id", F.col("copies").alias("weight"))
    of_node = written(of_node, "classes")
    discard(buckets, stars, sized, sets, links, near, comp, found, apart, meeting, load, labels, named)
    thin = rows.select("doc_id", "h", "n", "node")
    linked = looked_up(thin.where("node is not null"), of_node, "node").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "root", "h"
    )
    alone = thin.where("node is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("binary").alias("root"), "h"
    )
    return linked.unionByName(alone)


def spread(rows: DataFrame, table: DataFrame, key: str, by: Column) -> DataFrame:
    """Inner join of rows with a smaller table, each key in SALTS parts, so that no key is dealt to one task."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(parts.hint("merge"), [key, "_salt"]).drop("_salt")  # its size is not known before it is exploded


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with table, whose key is unique and whose weight is its number of rows.

    Keys with over a 1 / HOT_KEYS of all rows, so fewer than HOT_KEYS, are joined where the
    rows stand; only the others are dealt out by key.
    """
    limit = rows.count() / HOT_KEYS
    hot = F.broadcast(table.where(F.col("weight") > limit).drop("weight"))
    rare = table.where(F.col("weight") <= limit).drop("weight")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rare, key))
