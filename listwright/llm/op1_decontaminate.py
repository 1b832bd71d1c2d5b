"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of word characters.  Documents and items that share a seed of
MIN_TILE tokens are candidates.  Each candidate pair is tiled by running Karp-Rabin: windows
of the unmarked tokens are hashed, matches that nothing extends to the left are extended to
the right, the longest are marked first (what a tile cuts off another match goes back to the
queue), and the window shrinks until it is MIN_TILE.  The share of an item's tokens that are
tiled is its coverage, whatever the order of its passages in the document.

A benchmark within SENT_BYTES is sent to the executors, so documents are only mapped.  A
larger one is never gathered: seeds of documents and items are joined, and the pairs that
share enough of them are tiled.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, WordHashes, small_batches, turn, written

MIN_TILE, COVERAGE = 5, 0.8
#: Bytes of benchmark text that are sent to the executors at most.
SENT_BYTES = 16_000_000
#: Parts of each row in joins on what many rows share.
SALTS = 16
TOKEN = re.compile(r"\w+")
BASE = np.uint64(1_000_003)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def rolling(seq: np.ndarray, marked: bytearray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of every wholly unmarked window of s tokens, and where it begins."""
    n = len(seq) - s + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    # prefix sums of seq[i] * BASE^i; a window's sum, scaled by BASE^-i, is its polynomial
    powers = np.cumprod(np.full(len(seq), BASE, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(seq * powers, dtype=np.uint64)))
    inverse = np.cumprod(np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64))
    h = (sums[s:] - sums[:n]) * inverse
    dark = np.concatenate(([0], np.cumsum(np.frombuffer(marked, np.uint8), dtype=np.int64)))
    at = np.flatnonzero(dark[s:] == dark[:n])
    return h[at], at


def matches(doc: np.ndarray, item: np.ndarray, dmark: bytearray, imark: bytearray, s: int) -> list[tuple[int, int, int]]:
    """(-length, place in doc, place in item) of the matches of s unmarked tokens or more that cannot be extended."""
    hd, pd_ = rolling(doc, dmark, s)
    hi, pi = rolling(item, imark, s)
    if not len(hd) or not len(hi):
        return []
    order = np.argsort(hd, kind="stable")
    hd, pd_ = hd[order], pd_[order]
    low, high = np.searchsorted(hd, hi), np.searchsorted(hd, hi, "right")
    free_d, free_i = np.frombuffer(dmark, np.uint8) == 0, np.frombuffer(imark, np.uint8) == 0
    ps, ts = [], []
    for t, a, b in zip(pi.tolist(), low.tolist(), high.tolist()):
        if a < b:
            p = pd_[a:b]
            if t and free_i[t - 1]:  # what a window one to the left covers is no match of its own
                p = p[(p == 0) | (doc[p - 1] != item[t - 1]) | ~free_d[p - 1]]
            ps.append(p)
            ts.append(np.full(len(p), t))
    if not ps:
        return []
    p, t = np.concatenate(ps), np.concatenate(ts)
    length, live = np.zeros(len(p), np.int64), np.arange(len(p))
    while len(live):
        x, y = p[live] + length[live], t[live] + length[live]
        live, x, y = (v[(x < len(doc)) & (y < len(item))] for v in (live, x, y))
        live = live[(doc[x] == item[y]) & free_d[x] & free_i[y]]
        length[live] += 1
    fine = length >= s
    return list(zip((-length[fine]).tolist(), p[fine].tolist(), t[fine].tolist()))


def tiled(doc: list[int], item: list[int], least: int = MIN_TILE) -> int:
    """Number of the item's tokens covered by greedy string tiles of at least so many tokens.

    The longest match is marked first, of equal ones that which begins first in the document,
    then in the item.
    """
    d, it = np.array(doc, np.uint64), np.array(item, np.uint64)
    dmark, imark = bytearray(len(doc)), bytearray(len(item))
    s = max(least, min(20, len(item)))
    while True:
        heap = matches(d, it, dmark, imark, s)
        longest = -min(heap, default=(0,))[0]
        if longest > 2 * s:
            s = longest
            continue
        heapify(heap)
        while heap:
            k, p, t = heappop(heap)
            taken_d, taken_i = dmark.find(1, p, p - k), imark.find(1, t, t - k)
            if taken_d < 0 and taken_i < 0:
                dmark[p : p - k] = imark[t : t - k] = b"\1" * -k
            elif imark.find(0, t, t - k) >= 0:
                both = bytes(map(max, dmark[p : p - k], imark[t : t - k]))
                for m in re.finditer(rb"\x00+", both):
                    if m.end() - m.start() >= s:
                        heappush(heap, (m.start() - m.end(), p + m.start(), t + m.start()))
        if s <= least:
            return sum(imark)
        s = max(least, s // 2)


def seed_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of every stretch of width tokens."""
    n = max(0, len(ids) - width + 1)
    h = np.full(n, np.uint64(width))
    for i in range(width):
        h = (h ^ ids[i : i + n]) * STEP
        h ^= h >> np.uint64(29)
    return h


def stretches(ids: np.ndarray, starts: np.ndarray, width: int) -> list[int]:
    """The tokens of the seeds that begin at starts; a 0, which no item has, stands between stretches."""
    inside = np.zeros(len(ids) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + width, -1)
    at = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    out: list[int] = []
    for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
        out += [0, *ids[part].tolist()]
    return out


class Index:
    """Seeds of benchmark items: MIN_TILE tokens, or all of an item that has fewer."""

    def __init__(self, items: list[tuple[int, str]], least: int = MIN_TILE):
        self.least = least
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        self.seeds: defaultdict[int, defaultdict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        by_width: defaultdict[int, set[int]] = defaultdict(set)
        for item_id, text in items:
            seq = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)]
            if seq:
                width = min(least, len(seq))
                self.items.append((item_id, seq))
                for t, h in enumerate(seed_hashes(np.array(seq, np.uint64), width).tolist()):
                    self.seeds[h][len(self.items) - 1].append(t)
                    by_width[width].add(h)
        self.known = {w: np.sort(np.fromiter(hs, np.uint64, len(hs))) for w, hs in sorted(by_width.items())}

    def covered(self, text: str | None, share: float) -> list[tuple[int, float]]:
        """Items tiled to at least that share by the text, and their coverage."""
        words = tokens(text)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        found = []
        for width, known in self.known.items():
            if np.count_nonzero(ids) < width:
                continue
            h = seed_hashes(ids, width)
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            hits = np.flatnonzero(known[at] == h)
            if not len(hits):
                continue
            order = hits[np.argsort(h[hits], kind="stable")]
            values, first = np.unique(h[order], return_index=True)
            starts: defaultdict[int, list[np.ndarray]] = defaultdict(list)
            reach: defaultdict[int, list[int]] = defaultdict(list)
            for value, where in zip(values.tolist(), np.split(order, first[1:])):
                for k, places in self.seeds[value].items():
                    starts[k].append(where)
                    reach[k] += places
            for k, where in starts.items():
                item_id, item = self.items[k]
                if len(item) >= self.least and width < self.least or not can_reach(reach[k], len(item), width, share):
                    continue
                cover = tiled(stretches(ids, np.concatenate(where), width), item, width) / len(item)
                if cover >= share:
                    found.append((item_id, cover))
        return found


def can_reach(places: list[int], n: int, width: int, share: float) -> bool:
    """Whether seeds at these places of an item of n tokens touch that share of it; no tiling can cover more."""
    touched = bytearray(n)
    for t in places:
        touched[t : t + width] = b"\1" * min(width, n - t)
    return sum(touched) >= share * n


_INDEX: dict[str, Index] = {}


def index_of(key: str, items: list[tuple[int, str]]) -> Index:
    """The index of a benchmark, built once in each Python worker."""
    turn("benchmark", _INDEX.clear)
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = Index(items)
    return _INDEX[key]


_IDS = WordHashes()


def token_ids(text: str | None) -> np.ndarray:
    """Numbers of a text's tokens that need no common vocabulary: hashes, never 0."""
    turn("tokens", _IDS.clear)
    words = tokens(text)
    return np.fromiter(map(_IDS.__getitem__, words), np.uint64, len(words)) | np.uint64(1)


def joined(docs: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """text_key (digest of a text) and its hits, for benchmarks that are not sent."""
    text = F.col("text").cast("string")
    digest = F.sha2(text.cast("binary"), 256)
    texts = written(docs.where(text.isNotNull()).select(digest.alias("text_key"), text.alias("text")).dropDuplicates(["text_key"]), "texts")

    def seeds(key: str, whole: bool, lengths: tuple[int, ...]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row, text in zip(batch[key], batch["text"]):
                    ids = token_ids(text)
                    for width in (min(MIN_TILE, len(ids)),) if whole else lengths:
                        if width:
                            h, times = np.unique(seed_hashes(ids, width), return_counts=True)
                            yield pd.DataFrame({key: row, "n": len(ids), "width": width, "seed": h.view(np.int64), "times": times})

        return run

    asked = items.select("item_id", "text").mapInPandas(seeds("item_id", True, ()), "item_id long, n long, width int, seed long, times long")
    asked = written(asked, "seeds")
    widths = tuple(sorted(r.width for r in asked.select("width").distinct().collect()))  # MIN_TILE at most
    held = texts.mapInPandas(seeds("text_key", False, widths), "text_key string, n long, width int, seed long, times long").drop("n", "times")
    # a seed that many texts hold is spread over SALTS parts
    held = held.withColumn("_salt", F.pmod(F.xxhash64("text_key"), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    pairs = held.join(asked.withColumn("_salt", salts).hint("merge"), ["width", "seed", "_salt"]).groupBy("text_key", "item_id", "width", "n").agg(F.sum("times").alias("shared"))
    pairs = pairs.where(F.col("shared") * F.col("width") >= share * F.col("n"))  # no tiling can cover more
    pairs = pairs.select("text_key", "item_id", "width").join(items.select("item_id", F.col("text").alias("item")), "item_id").join(texts, "text_key")

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, item_id, width, item, text in zip(batch["text_key"], batch["item_id"], batch["width"], batch["item"], batch["text"]):
                ids, seq = token_ids(text), token_ids(item)
                width = int(width)
                mine, theirs = seed_hashes(ids, width), seed_hashes(seq, width)
                places = np.flatnonzero(np.isin(theirs, mine)).tolist()
                if can_reach(places, len(seq), width, share):
                    cover = tiled(stretches(ids, np.flatnonzero(np.isin(mine, theirs)), width), seq.tolist(), width) / len(seq)
                    if cover >= share:
                        out.append((key, int(item_id), cover))
            yield pd.DataFrame(out, columns=["text_key", "item_id", "cover"])

    hits = pairs.mapInPandas(tile, "text_key string, item_id long, cover double")
    return hits.groupBy("text_key").agg(F.collect_list(F.struct("item_id", "cover")).alias("_hits"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, share: float = COVERAGE, keep: list[str] = ["doc_id"], sent_bytes: int = SENT_BYTES
) -> DataFrame:
    """The columns keep of every row of docs, with items, coverage and contaminated.

    items lists the item_ids whose tokens the text covers by share or more, smallest first;
    coverage is the largest of them (0 if there is none).  An item of fewer than MIN_TILE
    tokens must stand in the text as a whole.  Texts or items that are null or have no token
    match nothing, nor do items without an id; repeated items count once, items of one id
    with other texts each for themselves.  Repeated rows and null ids of documents are
    returned as they come, with the same answer for the same text; other columns are ignored
    whatever their names; empty tables give no rows, or no hits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = written(benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct(), "benchmark")
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    kind = "array<struct<item_id: long, cover: double>>"
    text = F.col("text").cast("string")
    if size <= sent_bytes:
        # sent_bytes at most
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, sorted(tuple(r) for r in items.collect())))

        @F.pandas_udf(kind)
        def cover(texts: pd.Series) -> pd.Series:
            index = index_of(*sent.value)
            return pd.Series([[{"item_id": i, "cover": c} for i, c in index.covered(t, share)] for t in texts])

        found = docs.select(*keep, cover(text).alias("_hits"))
    else:
        hits = joined(docs, items, share).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        dealt = docs.select(*keep, F.sha2(text.cast("binary"), 256).alias("text_key"), F.pmod(F.xxhash64(*keep), F.lit(SALTS)).cast("int").alias("_salt"))
        found = dealt.join(hits, ["text_key", "_salt"], "left").select(*keep, F.coalesce("_hits", F.array().cast(kind)).alias("_hits"))
    return found.select(
        *keep,
        F.array_sort(F.array_distinct(F.col("_hits.item_id"))).alias("items"),
        F.coalesce(F.array_max(F.col("_hits.cover")), F.lit(0.0)).alias("coverage"),
        (F.size("_hits") > 0).alias("contaminated"),
    )
