"""Funnels against a plain scan of each client's rows, over many chunks and levels of the suffix scan."""

import datetime
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from listwright.llm import op11_funnels as op


def plain(rows, funnels=op.FUNNELS, within=op.WITHIN, percent=25):
    """rows(client, kind, microseconds): the contract, attempt by attempt."""
    lines = defaultdict(list)
    for c, k, t in {r for r in rows if None not in r}:
        lines[c].append((t, k))
    out, most = [], max(len(f.steps) for f in funnels)
    for f in funnels:
        for c, line in lines.items():
            times = [[] for _ in range(most)]
            for t1, k1 in line:
                if k1 != f.steps[0]:
                    continue
                times[0].append(0)
                at = t1
                for s in range(1, len(f.steps)):
                    after = min((t for t, k in line if k == f.steps[s] and t > at), default=None)
                    if after is None or after - t1 > within or any(k == f.excluding and at < t <= after for t, k in line):
                        break
                    times[s].append(after - at)
                    at = after
            if times[0]:
                n = [len(x) for x in times]
                deepest = max(i + 1 for i, x in enumerate(n) if x)
                out.append((f.name, c, *n, deepest, *[sorted(x)[-(-percent * len(x) // 100) - 1] if x else None for x in times[1:]]))
    depth = Counter((r[0], r[2 + most]) for r in out)
    return sorted(((*r, depth[r[0], r[2 + most]]) for r in out), key=str)


def made(seed, n, clients, span):
    rng = random.Random(seed)
    kinds = ["view"] * 5 + ["click"] * 4 + ["purchase"] * 2 + ["signup", "error", "other", None]
    rows = [(rng.choice(clients), rng.choice(kinds), rng.randrange(span) * rng.choice([1, 1_000_000]) % span if rng.random() < 0.97 else None) for _ in range(n)]
    return rows + rng.sample(rows, n // 10)


def table(spark, rows):
    zero = datetime.datetime(2024, 1, 1)
    data = [(i, c, k, None if t is None else zero + datetime.timedelta(microseconds=t)) for i, (c, k, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "click_id long, client_id long, kind string, arrived_at timestamp_ntz")
    return df.select("*", *[F.lit(1).alias(c) for c in ("t", "mask", "chunk", "f", "n1", "next0", "open", "funnel")])


@pytest.mark.parametrize("chunks, fan", [(1, 64), (7, 64), (40, 3)])
def test_equal_a_plain_scan(spark, chunks, fan):
    # one client has most of the rows, and times that fall together
    rows = made(chunks, 1200, [7] * 6 + [1, 2, 3, 7, None], 2_400_000_000) + made(9, 60, list(range(20, 50)), 10_000_000)
    got = op.funnel_counts(table(spark, rows), chunks=chunks, fan=fan)
    assert got.columns == ["funnel", "client_id", "n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_chunks_are_small_whatever_the_client(spark):
    rows = [(7, "view", i * 1000) for i in range(4000)]
    df = op.chunked(op.timeline(table(spark, rows), ["view"]), 1, op.WITHIN, 20)
    sizes = [r["count"] for r in df.where("mask is not null").groupBy("chunk").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 600


def test_small_batches_change_nothing(spark):
    rows = made(5, 700, [7, 7, 7, 1, 2], 900_000_000)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "13")
    try:
        got = sorted(map(tuple, op.funnel_counts(table(spark, rows), chunks=5).collect()), key=str)
    finally:
        spark.conf.set(key, old)
    assert got == plain(rows)


def test_other_funnels_times_and_an_empty_table(spark):
    funnels = (op.Funnel("two", ("view", "purchase")), op.Funnel("three", ("a", "b", "a"), "view"))
    rows = made(11, 300, [1, 2], 500_000_000) + [(3, k, t) for t, k in enumerate("abab")]
    got = op.funnel_counts(table(spark, rows), funnels, within=90_000_000, percent=50, chunks=3)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, funnels, 90_000_000, 50)
    assert op.funnel_counts(table(spark, rows).where("1 = 0")).collect() == []


def test_the_limit_and_exclusion_at_their_edges(spark):
    m = 60_000_000
    rows = [(1, "view", 0), (1, "click", m), (1, "view", 2 * m), (1, "purchase", 5 * m)]
    rows += [(2, "view", 0), (2, "click", m), (2, "view", 2 * m), (2, "purchase", 5 * m + 1)]
    rows += [(3, "view", 0), (3, "error", m), (3, "click", m)]  # not after the next step: it bars
    rows += [(4, "view", 0), (4, "error", 0), (4, "click", m)]  # not after the previous one: it does not
    got = {(r.funnel, r.client_id): r for r in op.funnel_counts(table(spark, rows), chunks=4).collect()}
    assert [got["A", c].n4 for c in (1, 2)] == [1, 0] and got["A", 2].n3 == 1
    assert [got["A", c].deepest for c in (1, 2, 3, 4)] == [4, 3, 1, 2] and got["A", 1].t4 == 3 * m


def test_zones_do_not_move_times(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(1, "a")], "client_id long, kind string").selectExpr("*", "timestamp_ntz'2024-03-31 02:30:00.000001' as arrived_at", "timestamp'2024-03-31 02:30:00+00:00' as z", "'1969-12-31 23:59:59.5' as s")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        r = df.select(op.micros(df, "arrived_at").alias("a"), op.micros(df, "z").alias("z"), op.micros(df, "s").alias("s")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(r) == (1711852200000001, 1711852200000000, -500000)
