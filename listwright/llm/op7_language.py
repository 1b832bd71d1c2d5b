"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts of order 0 to ORDER is counted on a bounded sample
and then frozen.  The code length of a byte is that of its longest context that has seen it,
plus the escapes of the longer ones (escape method C: distinct / (total + distinct)); a byte
no context has seen costs log2(256) bits more.  Contexts reach over words, to the text's
first byte at most, so the sum is the exact code length of the whole text.  It depends on a
byte and its context alone, so a worker remembers it for those it has met, in a table of
fixed size.  The language with the shortest code wins (ties: by code point); the score is its
share when every language is equally likely beforehand.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, turn

ORDER = 4
#: Parts of a language that are ranked apart when its sample is drawn.
PARTS = 64
#: Bounds of the sample of each language: documents, and bytes of all but the first of them.
SAMPLE_DOCS, SAMPLE_BYTES = 200, 600_000
#: Bytes of the table of met contexts of a worker, and bytes of text worked on at once.
HELD, PIECE = 24_000_000, 1 << 18
#: A packed context: its bytes, and where its length stands; the mark of a place in use.
LOW, LENGTH, USED = np.uint64((1 << 56) - 1), np.uint64(56), np.uint64(1 << 63)
LETTER = regex.compile(r"\p{L}")


def packed(text: bytes, order: int) -> Iterator[np.ndarray]:
    """Every byte of a text with its context, a number each, in parts of PIECE bytes, in order.

    The byte comes lowest, the order bytes before it above (fewer at the text's begin), and
    the length of the context in the highest byte.
    """
    data = np.frombuffer(text, np.uint8)
    for a in range(0, len(data), PIECE):
        begin = max(0, a - order)
        part = data[begin : a + PIECE].astype(np.uint64)
        reach = np.minimum(np.arange(begin, begin + len(part)), order)
        key = part | (reach.astype(np.uint64) << LENGTH)
        for j in range(1, min(order + 1, len(part))):
            key[j:] |= part[: len(part) - j] << np.uint64(8 * j)
        yield key[a - begin :]


def cut(keys: np.ndarray, k: int) -> np.ndarray:
    """Packed contexts and bytes, with the last k bytes of the context only."""
    return (keys & np.uint64((1 << (8 * k + 8)) - 1)) | (np.uint64(k) << LENGTH)


def contexts(keys: np.ndarray) -> np.ndarray:
    """Packed contexts without the byte behind them; the length stays."""
    return ((keys & LOW) >> np.uint64(8)) | (keys & ~LOW)


def find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether keys are in a sorted table, and its value for each (any, if they are not)."""
    known, value = table
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    where = np.searchsorted(known, keys)
    where[where == len(known)] = 0
    return known[where] == keys, value[where]


class Tree:
    """Context tree of one language: how often each byte follows each context, packed and sorted."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.keys, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []

    def learn(self, text: str) -> None:
        for key in packed(text.encode("utf-8", "surrogatepass"), self.order):
            self.waiting.append(key)
            if sum(map(len, self.waiting)) > PIECE:
                self.settle()

    def settle(self) -> None:
        """Counts what was learned since the last time."""
        if not self.waiting:
            return
        key = np.concatenate(self.waiting)
        self.waiting = []
        reach = key >> LENGTH
        new = np.concatenate([cut(key[reach >= np.uint64(k)], k) for k in range(self.order + 1)])
        new, n = np.unique(new, return_counts=True)
        self.keys, where = np.unique(np.concatenate((self.keys, new)), return_inverse=True)
        self.numbers = np.bincount(where, np.concatenate((self.numbers, n)), len(self.keys)).astype(np.int64)

    @property
    def counts(self) -> dict[bytes, int]:
        """Number of each context and byte, by their bytes."""
        self.settle()
        return {(k & int(LOW)).to_bytes(7, "big")[6 - (k >> 56) :]: n for k, n in zip(self.keys.tolist(), self.numbers.tolist())}

    def freeze(self) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Code lengths in bits by context and byte, escapes by context; both sorted by key."""
        self.settle()
        context, where, distinct = np.unique(contexts(self.keys), return_inverse=True, return_counts=True)
        total = np.bincount(where, self.numbers, len(context))
        return (self.keys, -np.log2(self.numbers / (total + distinct)[where])), (context, -np.log2(distinct / (total + distinct)))


class Model:
    """Frozen trees of all languages, and the code lengths of texts under each."""

    def __init__(self, languages: list[str], trees: list[tuple], order: int = ORDER):
        if order > 6:
            raise ValueError("a context and its byte must fit in seven bytes")
        self.languages, self.trees, self.order = languages, trees, order
        places = 1 << max(10, (HELD // (8 + 8 * max(1, len(languages)))).bit_length() - 1)
        self.shift = np.uint64(64 - (places.bit_length() - 1))
        self.met = np.zeros(places, np.uint64)  # packed contexts and bytes, each at the place of its hash
        self.bits = np.zeros((places, len(languages)))

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Bits of the last byte of packed contexts and bytes, by language."""
        out = np.zeros((len(keys), len(self.trees)))
        for column, (code, escape) in zip(out.T, self.trees):
            left = np.arange(len(keys))
            for k in range(self.order, -1, -1):
                tried = keys[left] >> LENGTH >= np.uint64(k)
                at = left[tried]
                known, bits = find(code, cut(keys[at], k))
                column[at[known]] += bits[known]
                met, bits = find(escape, contexts(cut(keys[at], k)))
                column[at[~known & met]] += bits[~known & met]
                left = np.concatenate((left[~tried], at[~known]))
            column[left] += 8.0
        return out

    def coded(self, keys: np.ndarray) -> np.ndarray:
        """Bits of packed contexts and bytes, by language; new ones take the place of what had their hash."""
        place = (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        out = self.bits[place]
        missed = np.flatnonzero(self.met[place] != keys | USED)
        if len(missed):
            new, where = np.unique(keys[missed], return_inverse=True)
            costs = self.costs(new)
            out[missed] = costs[where]
            place = (new * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
            _, last = np.unique(place[::-1], return_index=True)  # one of those that share a place
            last = len(place) - 1 - last
            self.met[place[last]], self.bits[place[last]] = new[last] | USED, costs[last]
        return out

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code lengths of texts (not empty) in bits, by language; short ones are worked on together."""
        out = np.zeros((len(texts), len(self.languages)))
        keys: list[np.ndarray] = []
        of: list[int] = []

        def settle() -> None:
            if keys:
                starts = np.concatenate(([0], np.cumsum([len(k) for k in keys])[:-1]))
                np.add.at(out, of, np.add.reduceat(self.coded(np.concatenate(keys)), starts, axis=0))
                keys.clear()
                of.clear()

        size = 0
        for i, text in enumerate(texts):
            for key in packed(text.encode("utf-8", "surrogatepass"), self.order):
                if size + len(key) > PIECE:
                    settle()
                    size = 0
                keys.append(key)
                of.append(i)
                size += len(key)
        settle()
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        spoken = [i for i, t in enumerate(texts) if t and self.languages and LETTER.search(t)]
        out = [("und", 0.0)] * len(texts)
        for i, bits in zip(spoken, self.lengths([texts[i] for i in spoken])):
            best = int(bits.argmin())
            out[i] = (self.languages[best], float(1.0 / np.exp(np.minimum((bits[best] - bits) * log(2), 0)).sum()))
        return out


def remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def fit(docs: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from docs(doc_id, text, lang) whose crc32 remainder is not 0 and whose lang is not null.

    The sample of a language is the first documents by hash of doc_id and text, sample_docs at most,
    until their bytes exceed sample_bytes; documents larger than a tenth of that come last.
    A drawn text is known again by its id, language, size and hash, so many texts under one id
    are as many documents.
    """
    size = F.octet_length("text")
    known = docs.where((remainder() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", "lang", size.alias("size"), (size > sample_bytes // 10).alias("large"), F.xxhash64("doc_id").alias("o"), F.xxhash64("text").alias("h")
    ).distinct()
    ranked = "large", "o", "h", "doc_id", "size"
    by, within = Window.partitionBy("lang").orderBy(*ranked), Window.partitionBy("lang", "part").orderBy(*ranked)
    # the first of each of PARTS parts of a language, so its whole is never in one task, and of these the first
    drawn = known.withColumn("part", F.pmod("h", F.lit(PARTS))).withColumn("k", F.row_number().over(within)).where(f"k <= {int(sample_docs)}")
    drawn = drawn.withColumn("k", F.row_number().over(by)).where(f"k <= {int(sample_docs)}")
    drawn = drawn.withColumn("sum", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    drawn = drawn.where(F.coalesce("sum", F.lit(0)) <= sample_bytes).select("doc_id", "lang", "size", "h")
    # sample_docs rows a language at most
    texts = docs.where(remainder() != 0).withColumns({"size": size, "h": F.xxhash64("text")}).join(
        F.broadcast(drawn), ["doc_id", "lang", "size", "h"]
    )
    trees: dict[str, Tree] = {}
    for lang, text in sorted(texts.select("lang", "text").distinct().collect()):
        if LETTER.search(text):
            trees.setdefault(lang, Tree(order)).learn(text)
    languages = sorted(trees)
    return Model(languages, [trees[x].freeze() for x in languages], order)


_MODELS: dict[str, Model] = {}


def model_of(key: str, *parts) -> Model:
    """The model, put together once in each Python worker."""
    turn("languages", _MODELS.clear)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(*parts)
    return _MODELS[key]


def predicted(docs: DataFrame, model: Model, keep: list[str] = ["doc_id"]) -> DataFrame:
    """The columns keep of docs, lang_pred and score; the model goes to every executor once."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, model.languages, model.trees, model.order))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model_of(*sent.value).predict(texts.tolist()), columns=["lang_pred", "score"])

    return docs.select(*keep, predict(F.col("text").cast("string")).alias("_p")).select(*keep, "_p.lang_pred", "_p.score")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs(doc_id, text, lang).

    Null texts and texts without a letter get "und" and score 0, as all do if nothing could
    be learned.  A null doc_id is not held out and not learned from.  Repeated rows get the
    same answer; other columns are ignored; an empty table gives no rows.
    """
    return predicted(docs, fit(docs)).select(
        "doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
