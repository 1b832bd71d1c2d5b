"""Personal data: fixed forms, and identifiers that bootstrapped patterns discover.

The fixed forms (email, ip, card, phone) and two forms of keys are the seeds.  Each occurrence
of an identifier-like word induces lexical patterns: the words in front, the word behind, its own
form and how it begins.  Patterns and the instances they occur with make a graph, one for each kind an
instance could be; its scores are refined in Spark, and what patterns of high confidence
discover is known in the next round.  In the end they mark the identifiers that no fixed form
knows: a phone number that runs into an address, a card behind other digits, a key behind the
words that introduce keys.  Those of the four kinds are spans; keys are reported beside them.

Support and confidence alone decide on a pattern, so their number is not bounded.  While all
of them are within PATTERN_BYTES they are sent to the executors; above that, the patterns of
each text's identifier-like words are joined with them in Spark.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, written

KINDS = ("email", "ip", "card", "phone")
#: All kinds that are learned; the last has seeds but no span of its own form.
ALL = (*KINDS, "secret")
#: Distinct known instances a pattern needs, its confidence, and rounds.
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.8, 3
#: Bytes of patterns sent to the executors at most; parts of each row in joins on what many rows share.
PATTERN_BYTES, SALTS = 4_000_000, 16
#: Code points around a word in which the words next to it are looked for.
REACH = 80
#: Neighbouring words of one identifier, and its code points, at most.
WINDOW, LONGEST = 3, 512
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
MARK = re.compile(r"[0-9@]\S*")
RUNS = re.compile(r"([^\W\d_]+)|[0-9]+")
NUMBER = re.compile(r"\+?[0-9][0-9 ().-]*[0-9]")
NETWORK = re.compile(r"[0-9A-Fa-f.:]+(?:/[0-9]{1,3})?")
KEY, ALPHA = re.compile(r"[A-Za-z0-9+/_=.-]+"), re.compile(r"[A-Za-z]")
#: Forms of keys that are seeds: hexadecimal ones of 16 digits or more, and the public form of access keys.
SEED_KEY = re.compile(r"[0-9a-f]{16,128}|AKIA[0-9A-Z]{16}")
#: A name and a mark in front of a value, as in user=x or Mail:x, belong to the words in front.
ASSIGNED = re.compile(r"[A-Za-z_-]+[=:][\"'`(\[{<]*")
WORDLIKE = re.compile(r"[^\W_]")
OPENING, CLOSING = "\"'`([{<", "\"'`)]}>.,;:!?"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping matches of the address form in linear time."""
    free = 0  # no match can begin before this
    at = text.find("@")
    while at >= 0:
        begin = free + len(text[free:at].rstrip(LOCAL))
        end = at + 1
        if begin < at and (m := HOST.match(text, at + 1)):
            end = m.end()
            yield begin, end
        free = end
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(place of the kind in KINDS, start, end) of the fixed forms, in this order."""
    found: list[tuple[int, int, int]] = []
    if not text:
        return found
    if "@" in text:
        found += [(0, *span) for span in emails(text)]
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m[0].split("."))):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        if 16 <= len(m[0]) <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGIT.findall(m[0])) <= 15:
                found.append((3, *m.span()))
    return found


def shape(word: str) -> str:
    """Form of an identifier: runs of letters as a, of up to three digits as 9, of more with their number."""
    return RUNS.sub(lambda m: "a" if m[1] else "9" if len(m[0]) < 4 else f"9{{{len(m[0])}}}", word)


def patterns_of(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of an occurrence: the word in front, the two in front, the word behind, its form, and how it begins.

    A mark by itself, such as = or %%, stands before and behind too many things to be one.
    """
    front = [w.lower() for w in text[max(0, start - REACH) : start].rstrip(OPENING).split()[-2:]]
    behind = text[end : end + REACH].lstrip(CLOSING).split(None, 1)[:1]
    found = ["S " + shape(text[start:end])[:REACH], "P " + text[start : min(end, start + 4)]]
    if front and WORDLIKE.search(front[-1]):
        found.append("L " + front[-1])
    if len(front) == 2 and WORDLIKE.search(" ".join(front)):
        found.append("L " + " ".join(front))
    if behind and WORDLIKE.search(behind[0]):
        found.append("R " + behind[0].lower())
    return found


def fits(word: str) -> int:
    """Bits of the kinds (places in ALL) that a word could be, whether its fixed form knows it or not."""
    digits = DIGIT.findall(word)
    n, bits = len(digits), 0
    if "@" in word[1:-1] and " " not in word:
        bits |= 1
    if n >= 4 and ("." in word or ":" in word) and NETWORK.fullmatch(word):
        bits |= 2
    if NUMBER.fullmatch(word):
        if 13 <= n <= 19 and luhn("".join(digits)):
            bits |= 4
        if 7 <= n <= 15:
            bits |= 8
    if n >= 2 and len(word) >= 16 and KEY.fullmatch(word) and len(ALPHA.findall(word)) >= 2:
        bits |= 16
    return bits


def candidates(text: str | None, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, bits of fits) of windows of up to WINDOW neighbouring words with a digit or an @.

    Windows that touch a fixed form are left out, as are marks at either end.
    """
    if not text:
        return
    taken = sorted((s, e) for _, s, e in base)
    ends = [e for _, e in taken]
    run: list[tuple[int, int]] = []
    free = 0
    for m in MARK.finditer(text):
        first, last = m.span()
        while first > free and not text[first - 1].isspace():
            first -= 1
        if run and not text[run[-1][1] : first].isspace():
            run = []
        run = [*run[1 - WINDOW :], (first, last)]
        free = last
        while last > first and not text[last - 1].isalnum():
            last -= 1
        for begin, _ in run:
            while begin < last and not (text[begin].isalnum() or text[begin] == "+"):
                begin += 1
            if m := ASSIGNED.match(text, begin, last):
                begin = m.end()
            if not 4 <= last - begin <= LONGEST:
                continue
            k = bisect.bisect_right(ends, begin)
            if k < len(taken) and taken[k][0] < last:
                continue
            if bits := fits(text[begin:last]):
                yield begin, last, bits


def occurrences(text: str | None) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, bits of the kinds it fits, bits of the kinds it is a seed of) in a text."""
    base = base_spans(text)
    for kind, start, end in base:
        yield start, end, 1 << kind, 1 << kind
    for start, end, bits in candidates(text, base):
        yield start, end, bits, 16 if bits & 16 and SEED_KEY.fullmatch(text, start, end) else 0


def graph(docs: DataFrame) -> DataFrame:
    """pattern, instance (digest), kind and seed of all edges, made distinct per batch first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[tuple[str, str, int], int] = {}
            for text in batch["text"]:
                for start, end, bits, seeds in occurrences(text):
                    word = hashlib.sha256(text[start:end].encode("utf-8", "surrogatepass")).hexdigest()[:32]
                    for p in patterns_of(text, start, end):
                        for k in range(len(ALL)):
                            if bits >> k & 1:
                                key = (p, word, k)
                                found[key] = found.get(key, 0) | seeds >> k & 1
            yield pd.DataFrame([(p, w, ALL[k], s) for (p, w, k), s in found.items()], columns=["pattern", "instance", "kind", "seed"])

    found = docs.select(F.col("text").cast("string")).mapInPandas(run, "pattern string, instance string, kind string, seed int")
    return found.groupBy("pattern", "instance", "kind").agg(F.max("seed").alias("seed"))


def learned(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """pattern and kind of all patterns of high confidence.

    In every round a pattern that enough known instances support gets as its confidence for a
    kind the scores of its instances over their number, whatever kinds they fit: a word that
    stands beside all kinds says nothing of any.  Instances of patterns of high confidence
    join the known ones, so that they support others in the next round; the score of the
    rest is the chance that at least one of their supported patterns is right.
    """
    edges = written(graph(docs).withColumn("_salt", F.pmod(F.xxhash64("pattern", "instance"), F.lit(SALTS)).cast("int")), "patterns")
    scores = edges.where("seed = 1").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    total = written(edges.select("pattern", "instance").distinct().groupBy("pattern").agg(F.count("*").alias("total")), "total")
    best, past = None, [edges, total]
    for k in range(rounds):
        # a frequent instance or pattern is spread over SALTS parts, and summed before it moves
        by = edges.join(salted(scores), ["instance", "kind", "_salt"], "left").groupBy("pattern", "kind").agg(
            F.count_if(F.col("score") >= 1.0).alias("support"), F.sum("score").alias("mass")
        )
        by = by.where(F.col("support") >= support).join(total, "pattern")
        best = written(by.select("pattern", "kind", (F.col("mass") / F.col("total")).alias("confidence")), "confidence")
        past.append(best)
        if k + 1 == rounds or best.isEmpty():
            break
        sure = F.max(F.col("confidence") >= confidence)
        chance = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        derived = edges.join(salted(best), ["pattern", "kind", "_salt"]).groupBy("instance", "kind").agg(
            F.when(sure, 1.0).otherwise(F.least(chance, F.lit(0.999))).alias("score")
        )
        scores = written(scores.where("score >= 1").unionByName(derived).groupBy("instance", "kind").agg(F.max("score").alias("score")), "scores")
        past.append(scores)
    found = written(best.where(F.col("confidence") >= confidence).select("pattern", "kind"), "learned")
    discard(*past)
    return found


def named(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    """The spans of these kinds: kind, start and end."""
    return ",".join(f"{ALL[k]}:{s}:{e}" for k, s, e in spans if ALL[k] in kinds)


def all_spans(text: str | None, patterns: dict[str, list[int]]) -> tuple[list, list]:
    """The fixed forms, and these with what the patterns add, each by kind and start.

    Of windows that overlap, the one that begins first counts, then the longest.
    """
    base = base_spans(text)
    if not patterns:
        return base, base
    found = []
    for start, end, bits in candidates(text, base):
        kinds = {k for p in patterns_of(text, start, end) for k in patterns.get(p, ()) if bits >> k & 1}
        if kinds:
            found.append((start, -end, min(kinds)))
    more, last = [], 0
    for start, end, kind in sorted(found):
        if start >= last:
            more.append((kind, start, -end))
            last = -end
    return base, sorted(base + more)


def salted(df: DataFrame) -> DataFrame:
    """Each row in SALTS parts, to be joined by sorting: its size is not known before it is exploded."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def matched(docs: DataFrame, found: DataFrame, keep: list[str]) -> DataFrame:
    """docs with _patterns, those of found that stand in its text, each as its kind, a space and the pattern."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = set()
            for h, text in zip(batch["_h"], batch["text"]):
                for start, end, _ in candidates(text, base_spans(text)):
                    out.update((h, p) for p in patterns_of(text, start, end))
            yield pd.DataFrame(list(out), columns=["_h", "pattern"])

    text = F.col("text").cast("string")
    digest = F.sha2(text.cast("binary"), 256)
    asked = docs.select(digest.alias("_h"), text.alias("text")).mapInPandas(run, "_h string, pattern string").distinct()
    asked = asked.withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(SALTS)).cast("int"))
    hits = asked.join(salted(found), ["pattern", "_salt"]).groupBy("_h").agg(F.sort_array(F.collect_list(F.concat_ws(" ", "kind", "pattern"))).alias("_patterns"))
    dealt = docs.withColumn("_h", digest).withColumn("_salt", F.pmod(F.xxhash64(*keep), F.lit(SALTS)).cast("int"))
    return dealt.join(salted(hits), ["_h", "_salt"], "left")


def personal_data(
    docs: DataFrame, keep: list[str] = ["doc_id"], patterns: list[tuple[str, str]] | None = None, redact: bool = False, pattern_bytes: int = PATTERN_BYTES
) -> DataFrame:
    """The columns keep of every row of docs, counts and digest of the fixed forms, and all spans.

    n_email, n_ip, n_card, n_phone count the fixed forms; spans lists these and what the
    patterns add, secrets the keys they find; n_spans counts both.  A null or empty text has
    none.  With redact, the column redacted holds the text with each span replaced by its
    kind in brackets (null stays null).  Patterns are learned from docs unless given; above
    pattern_bytes of them they are joined, not sent.  Repeated rows and null ids are returned
    as they come, with the same answer for the same text; ties of confidence do not matter,
    as every pattern counts for itself, and of two kinds the first in order is taken.  Other
    columns are ignored whatever their names; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    own = F.lit(None).cast("array<string>")
    if patterns is None:
        found = learned(docs)
        if (found.agg(F.sum(F.octet_length("pattern") + 32)).first()[0] or 0) <= pattern_bytes:
            patterns = sorted((r.pattern, r.kind) for r in found.collect())
        else:
            docs, own = matched(docs, found, keep), F.col("_patterns")

    def table(found: Iterable[tuple[str, str]]) -> dict[str, list[int]]:
        by: dict[str, list[int]] = {}
        for p, kind in found:
            by.setdefault(p, []).append(ALL.index(kind))
        return by

    sent = None if patterns is None else table(patterns)
    columns = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "secrets", "n_spans"] + ["redacted"] * redact

    @F.pandas_udf(", ".join(f"{c} {'long' if c[:2] == 'n_' else 'string'}" for c in columns))
    def spans(texts: pd.Series, owned: pd.Series) -> pd.DataFrame:
        rows = []
        for text, held in zip(texts, owned):
            by = sent
            if by is None:
                by = table(x.split(" ", 1)[::-1] for x in (() if held is None else held))
            base, every = all_spans(text, by)
            n = [0, 0, 0, 0]
            for k, _, _ in base:
                n[k] += 1
            rows.append((*n, hashlib.sha256(named(base).encode()).hexdigest(), named(every), named(every, ALL[4:]), len(every), *[redacted(text, every)] * redact))
        return pd.DataFrame(rows, columns=columns)

    return docs.select(*keep, spans(F.col("text").cast("string"), own).alias("_p")).select(*keep, "_p.*")


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span replaced; of spans that overlap, one mark stands for all."""
    if not text or not spans:
        return text
    out, last = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= last:
            out += [text[last:start], f"[{ALL[kind].upper()}]"]
        last = max(last, end)
    return "".join(out) + text[last:]
