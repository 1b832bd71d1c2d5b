"""What several training-data operators share: written tables, and joins of labels."""

from __future__ import annotations

import ctypes
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Words whose hash a worker remembers before it starts anew; longer words are not remembered.
REMEMBERED, REMEMBERED_CHARS = 200_000, 48
#: Rows of an Arrow batch, where the session has not set a number of its own.
BATCH = 2000


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir; where that is unset, what shared_folder gives or says."""
    return spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    The result has no lineage but the files, so a lost executor costs only the tasks it ran.
    The files stay until discard or clean.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _MADE:
        made.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written = path
    return back


_MADE: list[list[str]] = []


@contextmanager
def only_this(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes all tables written inside at its end, but those put into the list it gives."""
    made, kept = [], []
    _MADE.append(made)
    try:
        yield kept
    finally:
        _MADE.pop()
        for path in set(made) - {t._written for t in kept}:
            removed(spark, path)


def own_folder(spark: SparkSession) -> str:
    """Where this application writes its tables."""
    return f"{checkpoint_root(spark).rstrip('/')}/listwright/{spark.sparkContext.applicationId}"


def removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for t in tables:
        removed(t.sparkSession, t._written)


def clean(spark: SparkSession) -> None:
    """Deletes all tables this application has written, once its results have been read."""
    removed(spark, own_folder(spark))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH rows, as texts may be long, unless the session's number is not the usual one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH))


_HELD: dict[str, Callable[[], None]] = {}


def turn(owner: str, drop: Callable[[], None]) -> None:
    """Says that an operator works in this Python worker; what others remember there is let go."""
    others = [x for x in _HELD if x != owner]
    for x in others:
        _HELD.pop(x)()
    _HELD[owner] = drop
    if others:
        pa.default_memory_pool().release_unused()
        try:  # gives the memory back, where the C library can
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            return


class WordHashes(dict):
    """64-bit hashes of words, remembered within a bound."""

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


_HASHES = WordHashes()


def hashing() -> None:
    """Says that this Python worker hashes words."""
    turn("words", _HASHES.clear)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for every word of a text, A-Z lower-cased."""
    words = WORD.findall(lower_ascii(text))
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(29))


def lower_ascii(text: str | None) -> str:
    """The text with A-Z lower-cased and nothing else changed; null: empty."""
    if not text or text.isascii():
        return (text or "").lower()
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_sql(text: str) -> str:
    """Number of words (runs of anything but ASCII white space) of a text column; null: 0."""
    return f"coalesce(regexp_count({text}, r'[^\\x20\\x09-\\x0D]+'), 0)"


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): node and root, the smallest node reachable.

    Each round hooks every root to the smallest root next to it and halves the paths, so
    long chains take a logarithmic number of rounds.  Only nodes that have an edge are
    returned.  Null ends are ignored; no edges give no rows.
    """
    edges = written(
        edges.where("a is not null and b is not null and a != b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = nodes.select("node", F.col("node").alias("root"))
    crossing, past = edges, []
    for k in range(rounds):
        both = crossing.select("a", "b").union(crossing.select(F.col("b"), F.col("a"))).toDF("r", "q")
        # a table by itself, so that Spark can split the rows of a frequent parent in the joins below
        hooks = up = written(both.groupBy("r").agg(F.min("q").alias("q")).select("r", F.least("r", "q").alias("p")), "hooks")
        for _ in range(2):
            far = up.select(F.col("r").alias("p"), F.col("p").alias("pp"))
            up = up.join(far, "p", "left").select("r", F.coalesce("pp", "p").alias("p"))
        up = written(up, "parents")
        past += [crossing, hooks, up]
        root = up.select(F.col("r").alias("root"), F.col("p"))
        labels = labels.join(root, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        ends = up.select(F.col("r").alias("a"), F.col("p").alias("pa"))
        other = up.select(F.col("r").alias("b"), F.col("p").alias("pb"))
        crossing = written(
            crossing.join(ends, "a", "left").join(other, "b", "left")
            .select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
            .where("a != b")
            .distinct(),
            "crossing",
        )
        done = crossing.isEmpty()
        if done or k % 4 == 3:
            labels = written(labels, "labels")
            discard(*past)
            past = [labels]
        if done:
            discard(crossing)
            return labels
    raise RuntimeError(f"components: not settled in {rounds} rounds")
