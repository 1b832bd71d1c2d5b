"""Exact dedup against a dictionary of normalised texts."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from listwright.llm import op13_exact_dedup as op

SF = "/root/testdata/sf0.001"


def plain(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    out = []
    for text, found in groups.items():
        found.sort(key=lambda x: x[:3])
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(d, found[0][3], len(found), k == 0, sha) for k, (_, _, _, d) in enumerate(found)]
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(9001, None), (9002, ""), (9003, " \t\n\x0b\x0c\r "), (None, "no id"), (None, "no  id"), (9004, "noid"), (None, "alone"), (9005, "same row"), (9005, "same row"),
           (9006, "a\xa0b"), (9007, "ab"), (9008, "A b"), (9009, "漢 字 🤗"), (9010, "漢字🤗"), (9011, "x y" * 200_000), (9012, "xy" * 200_000)]
    odd += [(9100 + i, "copied " * 3 + " " * (i % 5)) for i in range(300)]
    extra = spark.createDataFrame(odd, "doc_id long, text string")
    clash = [F.lit("c").alias(c) for c in ("run", "row", "sha", "bytes", "sum", "best", "n", "points", "_normal", "keep_id")]
    return base.unionByName(extra).select("*", *clash).persist()


@pytest.mark.parametrize("parts, runs", [(1, 1), (13, 4), (23, 64)])
def test_equal_a_dictionary(spark, docs, parts, runs):
    got = op.copies(docs.repartition(parts), runs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark, docs):
    assert op.copies(docs.where("1 = 0")).collect() == []


def test_rounds_leave_each_key_once_in_its_slice(spark, docs):
    bits = 6
    rows = op.digested(docs.repartition(40), 1 << bits)
    own = rows.select("run", *op.KEY, op.better().alias("best")).groupBy("run", *op.KEY).agg(F.min("best").alias("best"), F.count("*").alias("n"))
    got = op.merged(own, bits).collect()
    assert len({bytes(r.sha) for r in got}) == len(got) and sum(r.n for r in got) == docs.count()
    for r in got:  # the run's number is spelled by the key: four bits of it, then two
        first = int.from_bytes(bytes(r.sha[:4]), "big")
        assert r.run & 15 == first >> 28 and r.run >> 4 == (first >> 26) & 3


def test_a_round_is_one_exchange(spark, docs):
    rows = op.digested(docs, 16)
    own = rows.select("run", *op.KEY, op.better().alias("best")).groupBy("run", *op.KEY).agg(F.min("best").alias("best"), F.count("*").alias("n"))
    plan = op.merged(own, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Window" not in plan
