"""Stupid-backoff language-model scores of documents under the counts of the whole corpus.

Relational plan, with the rows of a table packed many to a row:

1. Texts are packed into blocks of bounded bytes, each within one input task, and written.
2. Each block explodes its documents into the distinct n-grams of orders 1 to ORDER, as
   sorted hashes with their numbers (so frequent n-grams are summed before they move), and
   cuts them into shards of hash ranges.
3. The count tables are partitioned by shard: a shard joins the requests of all blocks, sums
   the numbers and answers every request with the corpus counts.
4. Each block joins the answers to its exploded n-grams again and sums the logarithms of the
   scores by document.

Blocks times shards would be the square of the input at some size.  Above ONE_HOP blocks the
requests therefore travel in two hops: groups of about as many blocks as there are groups
meet in coarse ranges first, and only their sums are cut into shards; rows then grow as the
input to the power 1.5, each still holding hundreds of n-grams.

A document's own n-grams are taken off the counts first, else every n-gram of the corpus
would be known.  S(w | context) = count / count of the context if the n-gram occurs in another
document, else ALPHA times the score with a context one word shorter; a word of no other
document scores 1 / (number of other words + 1).

A hash has SPARE more bits than the number of n-grams of the corpus has, 64 at most, so an
n-gram shares its hash with another one with a probability of 2^-SPARE, at every size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, hashing, mixed, small_batches, word_hashes, written

ORDER, ALPHA = 3, 0.4
#: Bytes of text in a block, blocks whose requests go straight to their shards, and spare bits of a hash.
BLOCK_BYTES, ONE_HOP, SPARE = 8_000_000, 16_384, 26
SPACES = np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))


def counted(text: str) -> int:
    """Number of words of a text."""
    if not text:
        return 0
    blank = SPACES[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    return int(np.count_nonzero(blank[:-1] & ~blank[1:])) + int(not blank[0])


def packed(docs: DataFrame, block_bytes: int) -> DataFrame:
    """block, n_words, n_bytes and payload (ids and texts, compressed) of about block_bytes of text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        done, ids, texts, size = 0, [], [], 0

        def block() -> pa.RecordBatch:
            payload = zstandard.ZstdCompressor(level=9).compress(pickle.dumps((ids, texts)))
            return pa.RecordBatch.from_pylist([{"block": first + done, "n_words": sum(map(counted, texts)), "n_bytes": size, "payload": payload}], schema)

        for batch in batches:
            for k in range(len(batch)):
                text = batch.column(1)[k].as_py() or ""
                ids.append(batch.column(0)[k].as_py())
                texts.append(text)
                size += len(text)
                if size >= block_bytes:
                    yield block()
                    done, ids, texts, size = done + 1, [], [], 0
        if ids:
            yield block()

    schema = pa.schema([("block", pa.int64()), ("n_words", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary())])
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "block long, n_words long, n_bytes long, payload binary")
    return written(out, "blocks")


def unpacked(payload: bytes) -> tuple[list[int | None], list[str]]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(bytes(payload)))


class Exploded:
    """The words of a block's documents, and level by level the hashes of their n-grams."""

    def __init__(self, texts: list[str], order: int, bits: int):
        hashing()
        hashed = [word_hashes(t) for t in texts]
        self.order, self.shift = order, np.uint64(64 - bits)
        self.sizes = np.array([len(w) for w in hashed], np.int64)
        self.words = np.concatenate(hashed)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)
        begins = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.place = np.minimum(np.arange(len(self.words)) - np.repeat(begins, self.sizes), order).astype(np.int8)

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """n, hashes of the n-grams in the order of the texts, and the words they end at."""
        gram = mixed(self.words * STEP)
        for n in range(1, self.order + 1):
            at = np.flatnonzero(self.place >= n - 1)
            if n > 1:
                # an n-gram's hash is built from that of its first n - 1 words
                longer = np.zeros(len(gram), np.uint64)
                longer[at] = mixed((gram[at - 1] ^ np.uint64(n)) * STEP + self.words[at])
                gram = longer
            yield n, gram[at] >> self.shift, at


def squeezed(x: np.ndarray) -> bytes:
    """Numbers, their bytes of one significance together; high zero planes are left out."""
    view = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max((i + 1 for i in range(8) if view[i].any()), default=1)
    return zstandard.ZstdCompressor(level=1).compress(view[:used].tobytes())


def expanded(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((8, n), np.uint8)
    raw = zstandard.ZstdDecompressor().decompress(bytes(b))
    out[: len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return np.ascontiguousarray(out.T).view("<u8").ravel()


def ranges(hashes: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Range of each hash, of parts equal ones."""
    return (hashes >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)


def cut(hashes: np.ndarray, numbers: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Range by range, of sorted hashes: number of n-grams, gaps between their hashes, and their numbers."""
    shards, first = np.unique(of, return_index=True)
    for p, a, b in zip(shards.tolist(), first.tolist(), [*first[1:].tolist(), len(of)]):
        yield p, b - a, squeezed(np.diff(hashes[a:b], prepend=np.uint64(0))), squeezed(numbers[a:b].astype(np.uint64))


def merged(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of some requests, their sums, and where each request's n-grams are among them."""
    asked = [np.cumsum(expanded(g, n), dtype=np.uint64) for g, n in zip(rows["gaps"], rows["n"])]
    known, where = np.unique(np.concatenate(asked), return_inverse=True)
    numbers = np.concatenate([expanded(c, n) for c, n in zip(rows["numbers"], rows["n"])])
    return known, np.bincount(where, weights=numbers.astype(np.float64), minlength=len(known)).astype(np.uint64), where


def given(rows: pd.DataFrame, counts: np.ndarray, where: np.ndarray) -> list[tuple[int, int, bytes]]:
    """who asked, number of n-grams and their counts, for each request."""
    out, begin = [], 0
    for who, n in zip(rows["who"], rows["n"]):
        out.append((int(who), int(n), squeezed(counts[where[begin : begin + n]])))
        begin += n
    return out


ASKED, GIVEN = "who long, level int, shard long, n long, gaps binary, numbers binary", "who long, level int, shard long, n long, counts binary"


def answered(requests: DataFrame) -> DataFrame:
    """The corpus counts for the n-grams of every request(who, level, shard, n, gaps, numbers)."""

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, sums, where = merged(rows)
        return pd.DataFrame([(who, key[1], key[0], n, c) for who, n, c in given(rows, sums, where)], columns=["who", "level", "shard", "n", "counts"])

    return requests.groupBy("shard", "level").applyInPandas(answer, GIVEN)


def answered_in_two_hops(requests: DataFrame, coarse: int, bits: int) -> DataFrame:
    """As answered, for requests cut into coarse ranges: groups of blocks are summed, and asked for, as one."""
    requests = requests.withColumn("party", F.pmod(F.xxhash64("who"), F.lit(coarse)))

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        known, sums, _ = merged(rows)
        out = [(key[0], key[2], *x) for x in cut(known, sums, ranges(known, bits, coarse * coarse))]
        return pd.DataFrame(out, columns=["who", "level", "shard", "n", "gaps", "numbers"])

    def scatter(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        _, _, where = merged(rows)
        answers = answers.sort_values("shard")
        sums = np.concatenate([expanded(c, n) for c, n in zip(answers["counts"], answers["n"])])
        return pd.DataFrame([(who, key[2], key[1], n, c) for who, n, c in given(rows, sums, where)], columns=["who", "level", "shard", "n", "counts"])

    parties = requests.groupBy("party", "shard", "level").applyInPandas(gather, ASKED)
    answers = answered(parties).withColumnRenamed("who", "party").withColumn("range", F.floor(F.col("shard") / coarse))
    return requests.groupBy("party", "shard", "level").cogroup(answers.groupBy("party", "range", "level")).applyInPandas(scatter, GIVEN)


def scores(
    docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES, one_hop: int = ONE_HOP, spare: int = SPARE
) -> DataFrame:
    """doc_id, n_words, log10_score (sum over the words) and mean_log10 of every row of docs(doc_id, text).

    Words are runs of anything but ASCII white space, A-Z lower-cased; n-grams do not cross
    documents.  Null texts and texts without words have no words, score 0 and a null mean.
    Repeated rows are documents of their own and know each other; null ids are kept; other
    columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    blocks = packed(docs, block_bytes)
    whole = blocks.agg(F.sum("n_words"), F.sum("n_bytes")).first()
    n_words, parts = whole[0] or 0, max(1, ceil((whole[1] or 0) / block_bytes))
    bits = min(64, max(40, (order * n_words).bit_length() + spare))
    coarse = 0 if parts <= one_hop else isqrt(parts - 1) + 1

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, payload in zip(batch["block"], batch["payload"]):
                exploded = Exploded(unpacked(payload)[1], order, bits)
                for n, level, _ in exploded.levels():
                    hashes, numbers = np.unique(level, return_counts=True)
                    out = [(block, n, *x) for x in cut(hashes, numbers, ranges(hashes, bits, coarse or parts))]
                    yield pd.DataFrame(out, columns=["who", "level", "shard", "n", "gaps", "numbers"])

    def judge(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["doc_id", "n_words", "log10_score"])
        ids, texts = unpacked(rows["payload"].iloc[0])
        exploded = Exploded(texts, order, bits)
        del texts
        answers = answers.sort_values(["level", "shard"])
        others = (n_words - exploded.sizes).astype(np.float64)[exploded.doc]
        score = before = None
        for n, level, at in exploded.levels():
            mine = answers[answers["level"] == n]
            corpus = np.concatenate([expanded(c, k) for c, k in zip(mine["counts"], mine["n"])]) if len(mine) else np.empty(0, np.uint64)
            hashes, where = np.unique(level, return_inverse=True)
            pair = exploded.doc[at] * np.int64(len(hashes) + 1) + where
            _, same, own = np.unique(pair, return_inverse=True, return_counts=True)
            now = np.zeros(len(exploded.words))  # occurrences in other documents, at the words where the n-gram ends
            now[at] = corpus[where].astype(np.float64) - own[same]
            if n == 1:
                score = np.where(now > 0, now / np.maximum(others, 1), 1 / (others + 1))
            else:
                score[at] = np.where(now[at] > 0, now[at] / np.maximum(before[at - 1], 1), alpha * score[at])
            before = now
        sums = np.bincount(exploded.doc, weights=np.log10(score), minlength=len(ids))
        return pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n_words": exploded.sizes, "log10_score": sums})

    requests = blocks.select("block", "payload").mapInPandas(ask, ASKED)
    answers = answered_in_two_hops(requests, coarse, bits) if coarse else answered(requests)
    judged = blocks.select("block", "payload").groupBy("block").cogroup(answers.withColumnRenamed("who", "block").groupBy("block")).applyInPandas(
        judge, "doc_id long, n_words long, log10_score double"
    )
    return judged.withColumn("mean_log10", F.when(F.col("n_words") > 0, F.col("log10_score") / F.col("n_words")))
