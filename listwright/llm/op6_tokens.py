"""Token counts by heap-and-linked-list byte-pair merging; no token identifiers are made.

A text is escaped the way the model asks for (one space in front, each space written as
U+2581), cut where no vocabulary piece spans two neighbouring characters, and every part is
merged once per worker: its symbols form a linked list, a heap holds the adjacent pairs by
rank (equal ranks: the leftmost), and the lowest is popped until none is left.  The count is
the number of initial symbols less the merges; a symbol outside the vocabulary counts its
UTF-8 bytes (byte fallback).

A part's count depends on nothing else, so it is kept in a bounded dictionary.
"""

from __future__ import annotations

import re
import sys
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, turn

SPACE = "▁"
#: Texts whose counts tell whether a model normalises them as is assumed here.
PROBES = ("", "a", " a", "a  b ", "\tA\n\nb", "a" + SPACE + "b", "ﬁ é e\u0301 ２", "x\u00a0y\u3000z")
#: Parts remembered by one Python worker, and the longest part that is remembered.
REMEMBERED, REMEMBERED_CHARS = 600_000, 48


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Ranks of the pieces of a sentencepiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        kept = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(model.is_unused(i) for i in kept) or not any(model.is_byte(i) for i in ids):
            raise ValueError(f"{path}: unused pieces and models without byte fallback are not supported")
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in kept}
        joined = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        if any(x[0] != SPACE and x[1] == SPACE for x in joined):
            raise ValueError(f"{path}: a piece has a space after another character")
        self.joined = joined
        self.pairs: dict[str, float] = {p: r for p, r in self.rank.items() if len(p) > 1}
        count = Counter(self)
        if any(count.text(t) != len(model.encode(t)) for t in PROBES):
            raise ValueError(f"{path}: the model normalises texts in another way than by one space in front")

    def merged(self, part: str) -> int:
        """Number of tokens of one part."""
        rank, pairs = self.rank, self.pairs
        n = len(part)
        size = [1] * n  # characters of the symbol that begins here; 0: merged into an earlier one
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := pairs.get(part[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, whole = heappop(heap)
            j = i + size[i]
            if not size[i] or j >= n or size[i] + size[j] != whole:
                continue
            size[i], size[j] = whole, 0
            nxt = after[i] = after[j]
            if nxt < n:
                before[nxt] = i
                k = whole + size[nxt]
                if (r := pairs.get(part[i : i + k])) is not None:
                    heappush(heap, (r, i, k))
            left = before[i]
            if left >= 0:
                k = size[left] + whole
                if (r := pairs.get(part[left : left + k])) is not None:
                    heappush(heap, (r, left, k))
        return sum(
            1 if s > 1 or part[i] in rank else len(part[i].encode("utf-8", "surrogatepass"))
            for i, s in enumerate(size)
            if s
        )


class Counter(dict):
    """Tokens by word; a word stands for U+2581 and the word."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.inner = vocabulary, {}

    def part(self, part: str) -> int:
        """Cuts where no piece can span, then merges what is left."""
        joined, inner, merged = self.vocabulary.joined, self.inner, self.vocabulary.merged
        total = begin = 0
        for i in range(1, len(part) + 1):
            if i == len(part) or part[i - 1 : i + 1] not in joined:
                piece = part[begin:i]
                begin = i
                if (n := inner.get(piece)) is None:
                    n = merged(piece)
                    if len(piece) <= REMEMBERED_CHARS:
                        if len(inner) >= REMEMBERED:
                            inner.clear()
                        inner[sys.intern(piece)] = n
                total += n
        return total

    def __missing__(self, word: str) -> int:
        n = self.part(SPACE + word)
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if text[0] == " " or "  " in text:  # runs of spaces go with the word behind them
            return sum(map(self.run, re.findall(r" +[^ ]*", " " + text)))
        return sum(map(self.__getitem__, text.split(" ")))

    def run(self, run: str) -> int:
        spaces = len(run) - len(run.lstrip(" "))
        return self[run[1:]] if spaces == 1 else self.part(run.replace(" ", SPACE))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a model, made once in each Python worker."""
    turn("tokens of a model", _COUNTERS.clear)
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(Vocabulary(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs(doc_id, text).

    Null and empty texts have no bytes and no tokens; repeated rows and null ids are
    returned as they come; other columns of docs are ignored.  Map only: no shuffle.
    """
    path = path or model_path()
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        count = counter(path).text
        return pd.Series([count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
