"""Each operator against a plain version of its contract, on a small fixture with awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest documents, with nulls, empty and long texts, repeated rows and clashing columns."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [
        (900001, None, "en", "src0", 0), (900002, "", None, None, None), (900003, " \n\t ", "de", "src1", 4),
        (900004, "12345 67890 !!", "en", None, 14), (900005, "x" * 60000, "en", "src2", 60000),
        (900006, "word " * 20000, "fr", "src3", 100000), (None, "a row without an id", "en", "src1", 19),
        (900007, "Only One", "en", "src1", 8), (900007, "Only One", "en", "src1", 8), (900008, "only one", "en", "src4", 8),
        (900009, "mail a.b+c@x-y.example.com, @@@ q@@r.s t@u. v@w.x.", "en", "src5", 50),
        (900010, "1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.255 4111 1111 1111 1111 4111-1111-1111-1112 +1 (555) 010-9999 +12 +1", "en", "src5", 90),
        (900011, "漢字 🤗  two  spaces\nline", "es", "src6", 20),
    ]
    extra = spark.createDataFrame(odd, base.schema)
    clash = [F.lit(1).alias(c) for c in ("n", "size", "node", "hits", "block", "path", "target", "items", "_x")]
    return base.unionByName(extra).select("*", *clash).persist()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]


def empty(docs):
    return docs.where("1 = 0")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").encode().lower().decode()


# 1 ---------------------------------------------------------------------------------------------


def plain_tiles(doc, item, least):
    """Greedy string tiling by its definition: mark the longest common stretch until none is long enough."""
    dm, im, total = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for t in range(len(item)):
                k = 0
                while p + k < len(doc) and t + k < len(item) and not dm[p + k] and not im[t + k] and doc[p + k] == item[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, t)
        k, p, t = best
        if k < least:
            return total
        for i in range(k):
            dm[p + i] = im[t + i] = True
        total += k


def test_tiles_equal_the_definition():
    from listwright.llm.op1_decontaminate import tiled

    rng = np.random.default_rng(1)
    for _ in range(150):
        item = rng.integers(1, 5, rng.integers(5, 30)).tolist()
        cut = int(rng.integers(0, len(item)))
        doc = rng.integers(1, 5, 10).tolist() + item[cut:] + [9] + item[:cut] + rng.integers(1, 5, 8).tolist()
        assert tiled(doc, item, 3) == plain_tiles(doc, item, 3)
    item = list(range(1, 41))
    assert tiled(item[20:] + [99] + item[:20], item, 5) == 40
    assert tiled(item[:4], item, 5) == 0


def test_repetitive_texts_are_tiled_in_time():
    import time

    from listwright.llm.op1_decontaminate import Index, tiled

    began = time.time()
    assert tiled([1] * 20_000, [1] * 240, 5) == 240
    assert Index([(1, "again and " * 120)]).covered("again and " * 10_000, 0.8) == [(1, 1.0)]
    assert time.time() - began < 5


def plain_contamination(text, items, share=0.8):
    """Ids of the items the text covers, and the largest coverage, by the definition."""
    token = re.compile(r"\w+")
    found, doc = {}, token.findall((text or "").lower())
    for i, t in items:
        item = token.findall((t or "").lower())
        # a pair without a common stretch has no tile
        if i is not None and item and any(" ".join(item[k : k + min(5, len(item))]) in " ".join(doc) for k in range(max(1, len(item) - 4))):
            cover = plain_tiles(doc, item, min(5, len(item))) / len(item)
            if cover >= share:
                found[i] = max(found.get(i, 0), cover)
    return sorted(found), max(found.values(), default=0.0)


@pytest.mark.parametrize("sent_bytes", [16_000_000, 0])
def test_contamination_equals_the_definition(spark, sent_bytes):
    from listwright.llm.op1_decontaminate import contamination

    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(0, 30)}"
    items = [(i, " ".join(word() for _ in range(rng.integers(6, 25)))) for i in range(12)]
    items += [(100, "three small words"), (101, "one"), (None, "no id"), (102, None), (103, "!!"), (0, items[0][1]), (1, "another text of item one here")]
    texts = [None, "", "One two", "we have Three small words here", "three small, other words"]
    for _ in range(40):
        t = [word() for _ in range(8)]
        for i in rng.integers(0, 12, 2):
            w = items[i][1].split()
            k = int(rng.integers(0, len(w)))
            t += w[k:] + [word()] + w[: int(k * rng.random()) + 1]
        texts.append(" ".join(t))
    texts += texts[-3:]
    docs = spark.createDataFrame([(i if i % 9 else None, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, items int, _hits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(docs, bench, sent_bytes=sent_bytes, keep=["doc_id", "text"]).collect()
    assert len(got) == len(texts)
    want = {t: plain_contamination(t, items) for t in texts}
    for r in got:
        assert r["items"] == want[r.text][0] and math.isclose(r.coverage, want[r.text][1], abs_tol=1e-12) and r.contaminated == bool(r["items"])
    assert sum(r.contaminated for r in got) > 5
    assert contamination(docs.where("1 = 0"), bench, sent_bytes=sent_bytes).count() == 0


def test_contamination(spark, docs):
    from listwright.llm.op1_decontaminate import contamination, tokens

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    odd = spark.createDataFrame([(7001, None), (7002, ""), (None, "no id here at all"), (7003, "too short")], "item_id long, text string")
    first = min(items)
    w = items[first].split()
    moved = spark.createDataFrame(
        [(1, "front words " + " ".join(w[len(w) // 2 :]) + " between the halves " + " ".join(w[: len(w) // 2])), (2, items[first].upper()), (3, " ".join(w[: len(w) // 3]))],
        "doc_id long, text string",
    )
    got = {r.doc_id: r for r in contamination(moved, bench.unionByName(odd)).collect()}
    assert first in got[1]["items"] and first in got[2]["items"] and first not in got[3]["items"]
    assert got[2].coverage == 1.0 and got[2].contaminated
    every = contamination(docs, bench.unionByName(odd)).collect()
    assert len(every) == docs.count()
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(r.text)
    for r in every:
        seeds = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        for i in r["items"]:
            assert i == 7003 or any(seeds(tokens(t)) & seeds(tokens(items[i])) for t in texts[r.doc_id])
        # a whole item inside a text is never missed
        for i, t in items.items():
            if any(x and t.lower() in x.lower() for x in texts[r.doc_id]):
                assert i in r["items"]
    joined = contamination(docs, bench.unionByName(odd), sent_bytes=0).select("doc_id", "items").collect()
    key = lambda x: (str(x.doc_id), str(x["items"]))
    assert sorted(map(key, joined)) == sorted(map(key, every))
    assert contamination(empty(docs), bench).count() == 0
    assert not any(r.contaminated for r in contamination(moved, bench.where("1 = 0")).collect())


# 2 ---------------------------------------------------------------------------------------------


def test_url_filter(spark):
    from listwright.llm.op2_urls import RULES, filtered

    urls = [None, "", "no scheme", "http://ORG/", "http://a.org", "http://a.org/x?q=1#f", "http://example.org/es/1", "http://www.example.org/en/12",
            "https://example.org/en/2", "ftp://b.com/fr/", "x://c.com/de/z", "http://notexample.org/es/", "a://b://c/d", "http://h.net/p#a://b"]
    urls += [f"http://h{i % 700}.net/{i}" for i in range(2000)]
    pages = spark.createDataFrame([(i, u, "<p>", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host long")

    def host_path(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]

    listed = lambda h: h != "" and hashlib.md5(h.encode()).hexdigest()[0] in "01"
    condition = F.substring(F.md5(F.col("host").cast("binary")), 1, 1).isin("0", "1")
    for more in ({}, {"page_keys": 100}, {"page_keys": 100, "sent_bytes": 0, "dealt_rows": 150}, {"sent_bytes": 0, "seed": 3}):
        got = {r.page_id: r for r in filtered(pages, condition, **more).collect()}
        assert len(got) == len(urls)
        for i, u in enumerate(urls):
            host, path = host_path(u)
            fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
            _, rule, verdict = max(fits, default=(0, None, "block" if listed(host) else "allow"))
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
            assert got[i].listed == listed(host)
    for size in (0, 32_000_000):
        assert filtered(pages.where("1 = 0"), condition, sent_bytes=size).count() == 0


# 3 ---------------------------------------------------------------------------------------------


def plain_licences(rows, cosine=0.75, share=0.1):
    """(license, score, origin, license_path) of every row (doc_id, text, path), from the definition."""
    from listwright.llm.op3_licences import SHIFT, all_templates

    token = re.compile("[a-z0-9]+(?:[.-][a-z0-9]+)*")
    texts = [token.findall((t or "").lower()) for _, t, _ in rows]
    n, df = len(rows), Counter(w for t in texts for w in set(t))
    vector = lambda w: {t: c * (math.log((n + 1) / (df[t] + 1)) + 1) for t, c in Counter(w).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own = []
    for w in texts:
        good, said = [], 0
        for name, template in all_templates():
            u = vector(template)
            order = sorted(u, key=lambda x: (df[x], x))  # noqa: B023
            enough = [k for k in range(1, len(order) + 1) if sum(u[x] ** 2 for x in order[:k]) - max(u[x] ** 2 for x in order[:k]) > (1 - cosine**2) * norm(u) ** 2]  # noqa: B023
            anchors = [(x, template.index(x)) for x in order[: min(enough, default=len(order))] if df[x]]
            for x, o in anchors:
                for p in (i for i, y in enumerate(w) if y == x):
                    if not any(z in w[max(0, p + q - o - SHIFT) : max(0, p + q - o + SHIFT + 1)] for z, q in anchors if z != x):
                        continue
                    passage = w[max(0, p - o) : p - o + len(template)]
                    v = vector(passage)
                    s = round(sum(a * u.get(t, 0) for t, a in v.items()) / norm(u) / norm(v), 4)
                    if s >= cosine:
                        good.append((-s, -len(template), name))
                        said = max(said, len(passage))
        own.append((min(good), said >= share * len(w)) if good else None)
    files = {}
    for (_, _, path), found in zip(rows, own):
        if found and found[1]:
            (s, _, name), _ = found
            files[path] = min(files.get(path, (0, "")), (s, name))
    out = []
    for (_, _, path), found in zip(rows, own):
        if found:
            out.append((found[0][2], -found[0][0], "own", path))
            continue
        parts = path.split("/")
        above = next((d for d in ("/".join(parts[:k]) for k in range(len(parts), 0, -1)) if d in files), None)
        out.append((files[above][1], -files[above][0], "inherited", above) if above else (None, None, "none", None))
    return out


def licence_rows():
    from listwright.llm.op3_licences import TEMPLATES

    body = lambda name: max((w for x, w in TEMPLATES if x == name), key=len)
    filler = " ".join(f"word{i}" for i in range(300))
    return [
        (1, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + body("MIT"), "a/b"), (2, "nothing here", "a/b/c"), (3, "nothing", "a/d"),
        (4, "x " * 400 + "\nLicensed under CC BY-NC 4.0.\n", "e"), (5, None, "a/b"), (6, "plain", "e/f"),
        (7, "This work is licensed under the GNU General Public License, version 3.", "a/b/c"), (8, "", "a/b/c/d"), (None, "licence", "q"),
        (9, "// SPDX-License-Identifier: MIT\nint main() {}", "s"), (10, "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\n"
         "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n1. Definitions.\n\n" + filler, "t"), (11, "Copyright 1999 Us.\n" + body("BSD-3-Clause") + " ARE DISCLAIMED.", "u"),
        (12, filler + " this thing is Released under the MIT License. and more " + filler, "v"), (13, "code", "u/x/y"), (14, "SPDX-License-Identifier: FOO-9.1", "w"),
        (15, "license license released " * 400, "w/z"), (16, "nothing", "s/deep"), (16, "nothing", "s/deep"), (17, "Released under the\n MIT\n license", "k"), (18, "x", "k/l"),
    ]


def test_licences(spark, docs):
    from listwright.llm.op3_licences import licences

    rows = licence_rows()
    small = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, folder string, term int")
    got = licences(small, F.col("folder"))
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
    by = lambda x: str(x)
    want = sorted(((d, p, *x) for (d, _, p), x in zip(rows, plain_licences(rows))), key=by)
    assert sorted(((r.doc_id, r.path, r.license, r.score, r.origin, r.license_path) for r in got.collect()), key=by) == want
    names = {r[0]: (r[2], r[4]) for r in want}
    assert names[1] == names[9] == names[12] == names[17] == ("MIT", "own") and names[10] == ("Apache-2.0", "own") and names[11] == ("BSD-3-Clause", "own")
    assert names[5] == names[16] == names[18] == ("MIT", "inherited") and names[13] == ("BSD-3-Clause", "inherited") and names[8] == ("GPL-3.0", "inherited")
    assert names[14] == names[15] == names[6] == (None, "none")
    whole = licences(docs)
    assert whole.count() == docs.count() and licences(empty(docs)).count() == 0


def test_licences_of_documents_equal_the_definition(spark):
    from listwright.llm.queries import op3_license_scan

    rows = [(r.doc_id, r.text, f"{r.source}/{r.lang}/{r.doc_id // 64}") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((d, *x) for (d, _, _), x in zip(rows, plain_licences(rows)))
    assert sorted((r.doc_id, r.license, r.score, r.origin, r.license_path) for r in op3_license_scan(spark, SF).collect()) == want
    assert any(x[3] == "own" for x in want)


def test_licence_notices_weigh_common_words_by_their_true_frequency(spark):
    from listwright.llm.op3_licences import licences

    header = "Software released under a MIT license."
    for n in (200, 5000):  # the same notice among few and many documents that hold its extra words
        texts = [header, *[f"wir kommen mit a software number {i} that was released under the old name" for i in range(n - 1)]]
        data = spark.createDataFrame([(i, t, "en", f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
        rows = [(i, t, f"s{i}/en/{i // 64}") for i, t in enumerate(texts)]
        got = sorted((r.doc_id, r.license, r.score, r.origin) for r in licences(data).collect() if r.origin != "none")
        assert got == [(d, *x[:3]) for (d, _, _), x in zip(rows, plain_licences(rows)) if x[2] != "none"] and got[0][:2] == (0, "MIT")


# 4 ---------------------------------------------------------------------------------------------


def test_targets_and_flow():
    from listwright.llm.op4_mixing import flow, targets

    sizes = {"a": 100, "b": 10, "c": 300, None: 50}
    got = targets(sizes, 460)
    assert got["b"] == 30 and abs(sum(got.values()) - 460) < 1e-9  # b's share by weight is over 3 * 10
    assert abs(got["c"] / got["a"] - 3) < 1e-9 and abs(got[None] / got["a"] - 1) < 1e-9
    used = flow({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 150, "b": 60})
    assert sum(used.values()) == 210 and used[("a",)] == 100 and used[("a", "b")] == 100 and used[("b",)] == 10
    used = flow({("a",): 10, ("a", "b"): 100}, {"a": 20, "b": 200})
    assert used == {("a",): 20, ("a", "b"): 200}  # marginal costs rise, so both are repeated


def plain_targets(sizes):
    """Shares by weight 1, 2, 3, found by raising the level that no source but the full ones stays under."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    low, high = 0.0, 3.0 * sum(sizes.values()) + 1
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(level * weight[s], 3 * sizes[s]) for s in order) < sum(sizes.values()):
            low = level
        else:
            high = level
    return {s: min(high * weight[s], 3 * sizes[s]) for s in order}


def test_flow_has_the_least_cost():
    import itertools

    from listwright.llm.op4_mixing import COSTS, flow

    rng = np.random.default_rng(6)
    for _ in range(40):
        patterns = [("a",), ("b",), ("a", "b"), ("b", "c"), ()][: rng.integers(2, 6)]
        supply = {p: int(rng.integers(0, 4)) for p in patterns}
        quota = {s: int(rng.integers(0, 9)) for s in "abc"}
        price = lambda p, n: sum(sorted(COSTS * supply[p])[:n])  # noqa: B023, E731

        def fits(used):  # by Hall's condition on sets of sources
            return all(sum(n for p, n in used.items() if p and set(p) <= set(x)) <= sum(quota[s] for s in x) for k in (1, 2, 3) for x in itertools.combinations("abc", k))  # noqa: B023

        every = [dict(zip(patterns, n)) for n in itertools.product(*[range(3 * supply[p] + 1 if p else 1) for p in patterns])]
        most = max(sum(u.values()) for u in every if fits(u))
        least = min(sum(price(p, n) for p, n in u.items()) for u in every if fits(u) and sum(u.values()) == most)
        got = flow(supply, quota)
        assert fits(got) and sum(got.values()) == most and sum(price(p, n) for p, n in got.items()) == least


def test_mixing_without_memberships(spark):
    from listwright.llm.op4_mixing import mixed

    data = [(1, "a b c", "x", ["x"]), (2, "d e", "y", None), (3, "f", "x", []), (None, None, None, ["x", None]), (4, "g h", "x", ["x", "z"]), (4, "g h", "x", ["x", "z"])]
    got = {r.doc_id: r for r in mixed(spark.createDataFrame(data, "doc_id long, text string, source string, sources array<string>"), F.col("sources")).collect()}
    assert len(got) == 5 and got[2].taken == got[3].taken == 0 and (got[2].source_size, got[2].target) == (0, 0.0)


def test_mixing(spark, docs, rows):
    from listwright.llm.op4_mixing import mixed

    got = mixed(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    size = defaultdict(int)
    for _, text, _, source in rows:
        size[source] += len(words(text))
    want = plain_targets(size)
    taken, largest = Counter(), Counter()
    texts = {r[0]: r for r in rows}
    for r in got:
        assert r.size == len(words(texts[r.doc_id][1])) and r.taken == r.size * r.repeats and 0 <= r.taken <= 3 * r.size
        s = texts[r.doc_id][3]
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mixed(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixed(empty(docs)).count() == 0


def test_mixing_overlapping_sources(spark):
    from listwright.llm.op4_mixing import mixed

    data = [(i, "w " * (i % 9 + 1), "a" if i % 2 else "b", ["a", "b"] if i % 3 == 0 else ["a"] if i % 2 else ["b"]) for i in range(400)]
    got = mixed(spark.createDataFrame(data, "doc_id long, text string, source string, sources array<string>"), F.col("sources")).collect()
    assert len(got) == 400 and abs(sum(r.taken for r in got) - sum(r.size for r in got)) < 40


# 5 ---------------------------------------------------------------------------------------------


def brute(vectors, every, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float64)
    out = {}
    for q in ids:
        if q % every == 0:
            d = np.sqrt(((x - np.array(vectors[q], np.float64)) ** 2).sum(axis=1))
            out[q] = sorted((d[j], ids[j]) for j in range(len(ids)) if ids[j] != q)[:k]
    return out


def test_neighbours(spark):
    from listwright.llm.op5_anisotropic import nearest

    base = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    zero, nan = [0.0] * 64, [float("nan")] + [1.0] * 63
    odd = spark.createDataFrame(
        [(5000, zero, 0), (5100, nan, 0), (5200, None, 0), (5300, [None] + [1.0] * 63, 0), (None, [1.0] * 64, 0), (5400, [], 0), (5500, [float("inf")] * 64, 0)]
        + [(6000 + i, [0.125] * 64, 0) for i in range(300)],
        base.schema,
    )
    got = defaultdict(list)
    for r in nearest(base.unionByName(odd)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    vectors = {r.vec_id: r.embedding for r in base.collect()} | {6000 + i: [0.125] * 64 for i in range(300)}
    want = brute(vectors, 100, 10)
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        assert len(got[q]) == 10 and got[q] == sorted(got[q])
        for d, v in got[q]:
            assert math.isclose(d, math.dist(vectors[q], vectors[v]), rel_tol=1e-9, abs_tol=1e-12)
        hits += len({v for _, v in near} & {v for _, v in got[q]})
    assert hits / (10 * len(want)) >= 0.95
    assert [v for _, v in got[6000]] == list(range(6001, 6011))
    few = base.where("vec_id < 4")
    assert [r.vec_id for r in nearest(few).orderBy("rank").collect()] == [v for _, v in brute({r.vec_id: r.embedding for r in few.collect()}, 100, 10)[0]]
    assert nearest(base.where("1 = 0")).count() == 0


@pytest.mark.parametrize("size", [1e-200, 5e-322, 1e200])
def test_neighbours_of_tiny_and_huge_vectors(spark, size):
    from listwright.llm.op5_anisotropic import nearest

    rng = np.random.default_rng(2)
    x = rng.integers(1, 300, (300, 6)).astype(float) * size if size > 1e-300 else rng.integers(1, 300, (300, 6)) * np.float64(5e-324)
    got = nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    unit = x / x.max()
    assert len(got) == 30
    for q in (0, 100, 200):
        d = np.sqrt(((unit - unit[q]) ** 2).sum(axis=1))
        mine = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
        want = [i for i in np.lexsort((np.arange(300), d)) if i != q][:10]
        assert len(set(mine) & set(want)) >= 9 and all(r.score > 0 and math.isfinite(r.score) for r in got if r.query_id == q)


def test_neighbours_of_odd_vectors(spark):
    from listwright.llm.op5_anisotropic import nearest

    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=5).tolist() for i in range(1, 60)} | {100: [1e200] * 5, 200: [1e-200] * 5, 300: [1.0, 2.0, 3.0], 301: [1.0, 2.0, 4.0]}
    rows = [(i, v, 1, 1) for i, v in vectors.items()] + [(7, [9.0] * 5, 1, 1), (7, vectors[7], 1, 1)]
    vectors[7] = min(vectors[7], [9.0] * 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score int")
    got = defaultdict(list)
    for r in nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got[300] == [(301, 1.0)] and set(got) == {100, 200, 300}
    for q in (100, 200):
        assert len(got[q]) == 10
        for v, d in got[q]:
            assert math.isclose(d, math.dist(vectors[q], vectors[v]), rel_tol=1e-9)
    assert sorted(map(tuple, nearest(df.repartition(5)).collect())) == sorted(map(tuple, nearest(df).collect()))


# 6 ---------------------------------------------------------------------------------------------


def test_token_counts(docs, rows):
    import sentencepiece

    from listwright.llm.op6_tokens import model_path, token_counts

    model = sentencepiece.SentencePieceProcessor(model_file=model_path())
    got = sorted(token_counts(docs).collect(), key=str)
    assert len(got) == len(rows)
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t, _, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(empty(docs)).count() == 0


# 7 ---------------------------------------------------------------------------------------------


def test_many_texts_under_one_id_stay_within_the_sample(spark, monkeypatch):
    from listwright.llm import op7_language as op

    taught = []
    learn = op.Tree.learn
    monkeypatch.setattr(op.Tree, "learn", lambda self, text: (taught.append(text), learn(self, text))[1])
    held = next(i for i in range(20) if zlib.crc32(str(i).encode()) % 5)
    df = spark.range(3000).selectExpr(f"{held}L as doc_id", "concat('same length text ', lpad(id, 5, '0')) as text", "'xx' as lang")
    model = op.fit(df.unionByName(df.limit(500)), sample_docs=200)
    assert model.languages == ["xx"] and len(taught) == len(set(taught)) == 200


def test_language(spark, docs):
    from listwright.llm.op7_language import languages

    got = languages(docs).collect()
    assert len(got) == docs.count()
    truth = defaultdict(set)
    for r in docs.collect():
        truth[r.doc_id].add((r.text, r.lang))
    right = n = 0
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        for text, lang in truth[r.doc_id]:
            if not text or not re.search(r"[^\W\d_]", text):
                assert (r.lang_pred, r.score) == ("und", 0.0)
            elif r.held_out and r.doc_id < 900000:
                n, right = n + 1, right + (r.lang_pred == lang)
    assert right / n >= 0.95
    assert languages(empty(docs)).count() == 0
    assert all(r.lang_pred == "und" for r in languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect())


def test_code_lengths_are_those_of_the_tree():
    from listwright.llm.op7_language import Model, Tree

    tree = Tree(3)
    for t in ("the cat sat on the mat", "the hat"):
        tree.learn(t)
    code, escape = tree.freeze()
    model = Model(["en"], [(code, escape)], 3)

    def plain(text):
        w, bits = text.encode(), 0.0
        for i in range(len(w)):
            p, k = 1.0, min(3, i)
            while True:
                context = w[i - k : i]
                after = Counter({key[-1:]: n for key, n in tree.counts.items() if key[:-1] == context and len(key) == k + 1})
                total, distinct = sum(after.values()), len(after)
                if after[w[i : i + 1]]:
                    p *= after[w[i : i + 1]] / (total + distinct)
                    break
                if total:
                    p *= distinct / (total + distinct)
                k -= 1
                if k < 0:
                    p /= 256
                    break
            bits -= math.log2(p)
        return bits

    assert tree.counts[b"e ca"] == 1 and tree.counts[b"t "] == 2  # contexts reach over words
    texts = ["the cat", "zebra hat  the\n", "ünïcode mat " * 3, *("thea"[:k] for k in range(1, 5)), " "]
    for _ in range(2):
        assert np.allclose(model.lengths(texts)[:, 0], list(map(plain, texts)), rtol=1e-12)


class PlainMatching:
    """Prediction by partial matching by the book, method C: a dict of followers a context, a byte at a time."""

    def __init__(self, order, texts):
        self.order, self.after = order, defaultdict(Counter)
        for data in texts:
            for i in range(len(data)):
                for k in range(min(order, i) + 1):
                    self.after[data[i - k : i]][data[i]] += 1

    def bits(self, data):
        out = []
        for i, byte in enumerate(data):
            p = 1 / 256
            for k in range(min(self.order, i) + 1):  # from the shortest context to the longest
                seen = self.after.get(data[i - k : i])
                if seen:
                    whole = sum(seen.values()) + len(seen)
                    p = seen[byte] / whole if seen[byte] else p * len(seen) / whole
            out.append(-math.log2(p))
        return math.fsum(out)


def test_the_whole_query_equals_a_plain_model(spark, tmp_path):
    from listwright.llm.queries import queries

    letters = re.compile(r"[^\W\d_]")
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("char_length(text) < 700 or text is null").limit(150)
    odd = [(910001, None, "en", "s", 0), (910002, "1 2 3 -", "en", "s", 7), (910003, "a", None, "s", 1), (910004, "\u00fc\u4e2d \U0001f600 x", "zz", "s", 6)]
    table.unionByName(spark.createDataFrame(odd, table.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    rows = spark.read.parquet(str(tmp_path / "documents.parquet")).collect()
    # all are below the bounds of the sample, so the models are those of all texts; equal texts of a language are learned once
    taught = {(r.lang, r.text) for r in rows if r.doc_id is not None and not held(r.doc_id) and r.lang is not None and r.text and letters.search(r.text)}
    per = Counter(lang for lang, _ in taught)
    assert len(per) > 3 and max(per.values()) < 200
    models = {x: PlainMatching(4, [t.encode() for lang, t in taught if lang == x]) for x in sorted(per)}
    want = []
    for r in rows:
        if not r.text or not letters.search(r.text):
            want.append((r.doc_id, held(r.doc_id), "und", 0.0))
            continue
        bits = {x: m.bits(r.text.encode()) for x, m in models.items()}
        best = min(bits, key=lambda x: (bits[x], x))
        want.append((r.doc_id, held(r.doc_id), best, 1 / math.fsum(2.0 ** (bits[best] - b) for b in bits.values())))
    got = [(r.doc_id, r.held_out, r.lang_pred, r.score) for r in queries()["op7_ppm_language"](spark, str(tmp_path)).collect()]
    got, want = (sorted(x, key=str) for x in (got, want))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-9)
    assert any(x[1] for x in got) and any(x[2] == "und" for x in got)


def test_code_lengths_do_not_depend_on_what_a_worker_remembers(monkeypatch):
    from listwright.llm import op7_language as op7

    trees = []
    for text in ("the cat sat on the mat and more of it", "der hund lief im wald und noch mehr"):
        tree = op7.Tree(4)
        tree.learn(text)
        trees.append(tree.freeze())
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("the cat mandrwu\n"), rng.integers(1, 3000))) for _ in range(60)]
    whole = op7.Model(["en", "de"], trees).lengths(texts)
    monkeypatch.setattr(op7, "HELD", 1)  # the least table
    monkeypatch.setattr(op7, "PIECE", 700)
    assert np.allclose(op7.Model(["en", "de"], trees).lengths(texts), whole, rtol=1e-12)


# 8 ---------------------------------------------------------------------------------------------

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_fixed_forms_equal_the_patterns():
    from listwright.llm.op8_personal import base_spans, named

    rng = np.random.default_rng(3)
    for _ in range(4000):
        text = "".join(rng.choice(list("ab@@..--12345 +()é\n_%"), rng.integers(0, 60)))
        assert named(base_spans(text)).split(",") == (plain_spans(text) or [""])
    for _ in range(1500):
        text = "".join(rng.choice(list("0123456789. -+"), rng.integers(0, 80)))
        assert named(base_spans(text)).split(",") == (plain_spans(text) or [""])


def test_personal_data(spark, docs, rows):
    from listwright.llm.op8_personal import personal_data

    got = personal_data(docs).collect()
    assert len(got) == len(rows)
    texts = defaultdict(set)
    for i, t, _, _ in rows:
        texts[i].add(t)
    for r in got:
        choices = [plain_spans(t) for t in texts[r.doc_id]]
        assert r.base_sha256 in {hashlib.sha256(",".join(c).encode()).hexdigest() for c in choices}
        base = next(c for c in choices if hashlib.sha256(",".join(c).encode()).hexdigest() == r.base_sha256)
        assert set(base) <= set(r.spans.split(",")) or not base
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in FORMS]
    assert personal_data(empty(docs)).count() == 0


def plain_candidates(text, base):
    """Windows of one to three neighbouring words with a digit or an @, without marks at their ends, off the fixed forms."""
    from listwright.llm.op8_personal import fits

    tokens = [m for m in re.finditer(r"\S+", text or "")]
    out = set()
    for n in (1, 2, 3):
        for k in range(len(tokens) - n + 1):
            if all(re.search("[0-9@]", m[0]) for m in tokens[k : k + n]):
                a, b = tokens[k].start(), tokens[k + n - 1].end()
                while b > tokens[k + n - 1].start() and not text[b - 1].isalnum():
                    b -= 1
                while a < b and not (text[a].isalnum() or text[a] == "+"):
                    a += 1
                name = re.match("[A-Za-z_-]+[=:]", text[a:b])
                if name:  # a name and a mark belong to the words in front
                    a += len(name[0])
                    while a < b and text[a] in "\"'`([{<":
                        a += 1
                if 4 <= b - a <= 512 and not any(s < b and a < e for _, s, e in base) and fits(text[a:b]):
                    out.add((a, b, fits(text[a:b])))
    return out


def plain_personal(texts):
    """Spans and keys of every text, from graphs kept in dictionaries."""
    from listwright.llm.op8_personal import ALL, KINDS, patterns_of

    edges, known = defaultdict(set), {}
    bases = [[(KINDS.index(x.split(":")[0]), *map(int, x.split(":")[1:])) for x in plain_spans(t)] for t in texts]
    for t, base in zip(texts, bases):
        for k, s, e in base:
            known[t[s:e], k] = 1.0
            for p in patterns_of(t, s, e):
                edges[p, k].add(t[s:e])
        for s, e, bits in plain_candidates(t, base):
            for k in range(5):
                if bits >> k & 1:
                    if k == 4 and re.fullmatch("[0-9a-f]{16,128}|AKIA[0-9A-Z]{16}", t[s:e]):
                        known[t[s:e], k] = 1.0
                    for p in patterns_of(t, s, e):
                        edges[p, k].add(t[s:e])
    score = dict(known)
    for _ in range(3):
        best = {}
        for (p, k), words_ in edges.items():
            if sum(score.get((w, k), 0) >= 1 for w in words_) >= 5:
                best[p, k] = sum(score.get((w, k), 0) for w in words_) / len(set().union(*(edges.get((p, x), ()) for x in range(5))))
        by = defaultdict(list)
        for (p, k), c in best.items():
            for w in edges[p, k]:
                by[w, k].append(c)
        for x, cs in by.items():
            if score.get(x, 0) < 1:
                score[x] = 1.0 if max(cs) >= 0.8 else min(0.999, 1 - math.prod(max(1 - c, 1e-9) for c in cs))
    sure = defaultdict(list)
    for (p, k), c in best.items():
        if c >= 0.8:
            sure[p].append(k)
    out = []
    for t, base in zip(texts, bases):
        found, last, more = [], 0, []
        for s, e, bits in plain_candidates(t, base):
            kinds = [k for p in patterns_of(t, s, e) for k in sure[p] if bits >> k & 1]
            if kinds:
                found.append((s, -e, min(kinds)))
        for s, e, k in sorted(found):
            if s >= last:
                more.append((k, s, -e))
                last = -e
        every = [f"{ALL[k]}:{s}:{e}" for k, s, e in sorted(base + more)]
        out.append((",".join(x for x in every if x[:6] != "secret"), ",".join(x for x in every if x[:6] == "secret"), len(every)))
    return out, dict(sure)


def test_candidates_equal_the_definition():
    from listwright.llm.op8_personal import base_spans, candidates

    rng = np.random.default_rng(12)
    for _ in range(3000):
        text = "".join(rng.choice(list("ab@..-12345 +()\n\té=/:9  \"="), rng.integers(0, 70)))
        base = base_spans(text)
        found = list(candidates(text, base))
        assert set(found) == plain_candidates(text, base)


def test_whole_spans_equal_a_plain_bootstrap(spark):
    from listwright.llm.op8_personal import learned
    from listwright.llm.queries import op8_bootstrapped_personal_data

    sf = SF.replace("0.001", "0.01")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, sure = plain_personal([t for _, t in rows])
    got = {r.doc_id: (r.spans, r.secrets, r.n_spans) for r in op8_bootstrapped_personal_data(spark, sf).collect()}
    assert got == {d: x for (d, _), x in zip(rows, want)}
    assert len(learned(spark.read.parquet(f"{sf}/documents.parquet")).collect()) == sum(map(len, sure.values())) > 0
    assert any(x[1] for x in want)


def test_bootstrapping_finds_planted_identifiers_and_little_else(spark):
    from listwright.llm.op8_personal import personal_data

    rng = np.random.default_rng(5)
    fill = lambda: " ".join(f"w{'abcdefgh'[rng.integers(0, 8)]}{'xyz'[rng.integers(0, 3)]}" for _ in range(6))
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    number = lambda: f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
    address = lambda: ".".join(str(rng.integers(10, 250)) for _ in range(4))
    data, planted = [], {}
    for i in range(400):
        data.append((i, f"{fill()} {number()} {fill()} {address()} {fill()} api_key{'=' if i % 2 else ' = '}\"{hexes(40)}\" {fill()}"))
    for i in range(400, 440):  # a number that runs into an address is no fixed form; nor is a key of other letters
        n, key = number(), "Zq7" + hexes(30).upper() + "G7H8"
        mark = " = \"" if i % 2 else "="
        data.append((i, f"{fill()} {n} {address()} {fill()} api_key{mark}{key}\" {fill()}"))
        planted[i] = (n, key)
    for i in range(440, 500):  # decoys: long numbers without a check digit, versions, years
        digits = "".join(map(str, rng.integers(0, 10, 15)))
        data.append((i, f"{fill()} version 10.4.2 of {rng.integers(1900, 2030)} {fill()} {digits}{next(c for c in '0123456789' if not plain_spans(digits + c))} build=AB12-CD34-EF56-7788 {fill()}"))
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    texts = dict(data)
    right = 0
    for i, (n, key) in planted.items():
        cut = [texts[i][int(x.split(":")[1]) : int(x.split(":")[2])] for x in f"{got[i].spans},{got[i].secrets}".split(",") if x]
        right += n in cut and key in cut
    assert right == len(planted)  # all of them are caught
    assert not any(got[i].n_spans for i in range(440, 500))  # and every decoy is left alone


def test_patterns_discover_what_no_form_knows(spark):
    from listwright.llm.op8_personal import personal_data

    data = [(i, f"Filler text {i} then reach me: user{i}@host{i}.example.com or not.") for i in range(30)]
    data += [(100, "Once more, reach me: someone@intranet today"), (101, "a handle like someone@intranet without context"), (102, None)]
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(data, "doc_id long, text string"), keep=["doc_id"], redact=True).collect()}
    assert got[100].spans == "email:21:37" and got[100].n_email == 0
    assert got[101].spans == "" and got[100].redacted == "Once more, reach me: [EMAIL] today" and got[102].redacted is None
    assert got[3].redacted == "Filler text 3 then reach me: [EMAIL] or not."


def test_rare_patterns_are_learned_beside_a_hot_source_and_joined_above_the_bound(spark):
    from listwright.llm.op8_personal import personal_data

    # one address 8,000 times; a sure context of six others; and identifiers no form knows behind that context
    data = [(0, "mail to root@example.com " * 8000), *[(i, f"please contact person{i}@example.com") for i in range(1, 7)]]
    data += [(7, "Please contact odd@host and 12 more"), (8, "Please contact odd@host and 12 more"), (None, None), (9, "nothing@all"), (10, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    outs = []
    for more in ({}, {"pattern_bytes": 0}):
        got = personal_data(df, redact=True, **more).collect()
        by = {r.doc_id: r for r in got}
        assert by[7].spans == by[8].spans == "email:15:23" and by[7].n_email == 0
        assert by[7].redacted == "Please contact [EMAIL] and 12 more"
        assert by[1].spans == "email:15:34" and by[9].spans == by[10].spans == "" and by[None].redacted is None
        outs.append(sorted(map(str, got)))
    assert len(outs[0]) == len(data) and outs[0] == outs[1]


# 9 ---------------------------------------------------------------------------------------------


def plain_classes(rows, width, percent):
    sets = []
    for _, text in rows:
        w = words(lower(text))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def near_copies(n, spread, seed):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(150)]
    out = []
    for _ in range(n):
        w = list(base)
        for p in rng.choice(150, rng.integers(0, spread), replace=False):
            w[p] = f"v{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, docs, rows, width):
    from listwright.llm.op9_minmax import classes

    data = [(i, t) for i, t, _, _ in rows] + [(10_000 + i, t) for i, t in enumerate(near_copies(160, 24, 5) + near_copies(40, 12, 6))]
    table = spark.createDataFrame(data, "doc_id long, text string").withColumn("root", F.lit(1)).withColumn("node", F.lit("x"))
    got = classes(table, width).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(plain_classes(data, width, 80), key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert classes(empty(docs), width).count() == 0


def exact_classes(rows, width):
    """Smallest doc_id reachable over all pairs of similarity 0.8, from an index of the rarest shingles of each set."""
    sets = {}
    for i, text in rows:
        w = words(lower(text))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    df, root, index = Counter(x for s in sets.values() for x in s), {i: i for i in sets}, defaultdict(list)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sorted(sets.items(), key=lambda x: len(x[1])):
        prefix = sorted(s, key=lambda x: (df[x], x))[: len(s) - -(-8 * len(s) // 10) + 1] if s else []
        for j in {j for x in prefix for j in index[x]}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in prefix:
            index[x].append(i)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_no_link_of_a_whole_table_is_lost(spark, width):
    from listwright.llm.op9_minmax import classes

    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    want = exact_classes([(r.doc_id, r.text) for r in docs.collect()], width)
    assert {r.doc_id: r.component_id for r in classes(docs, width).collect()} == want


def test_rows_without_an_id_are_no_cross_join(spark):
    import time

    from listwright.llm.op9_minmax import classes

    texts = near_copies(600, 12, 9)
    took = []
    for ids in (lambda i: i, lambda i: None):
        df = spark.createDataFrame([(ids(i), t) for i, t in enumerate(texts)], "doc_id long, text string")
        began = time.time()
        got = classes(df, 2).collect()
        took.append(time.time() - began)
        assert len(got) == 600 and len({r.root for r in got}) == len({r[2] for r in plain_classes([(i, t) for i, t in enumerate(texts)], 2, 80)})
    assert took[1] < 3 * took[0] + 5


def test_a_hub_is_sent_once_a_block(spark):
    from listwright.llm import op9_minmax as op

    members = [(bytes([1, i // 250, i % 250]), 10, hub) for i in range(1000) for hub in (b"A", b"B") if hub == b"A" or i < 7]
    stars = spark.createDataFrame(members, "node binary, n long, other binary").repartition(3)
    nodes = {m[0] for m in members} | {b"A", b"B"}
    sets = spark.createDataFrame([(x, x * 3, 1, 2) for x in nodes], "node binary, s binary, k1 long, k2 long")
    sized = op.hub_sizes(stars, star=16).cache()
    assert {(bytes(r.other), r.weight, r.parts) for r in sized.collect()} == {(b"A", 1000, 63), (b"B", 7, 1)}
    large = op.hub_sizes(stars.withColumn("n", F.lit(op.BLOCK_BYTES // 8)))  # one set fills a block
    assert {(bytes(r.other), r.parts) for r in large.collect()} == {(b"A", 1000), (b"B", 7)}
    for slab in (1, 10, 62, 63, 1024):
        got = [(bytes(r.block), r.side, bytes(r.comp), bytes(r.node), bytes(r.s)) for r in op.star_blocks(stars, sized, sets, slab).collect()]
        assert all(comp == node and s == node * 3 for _, _, comp, node, s in got)
        hubs = [(block, node) for block, side, _, node, _ in got if side == 0]
        assert len(hubs) == len(set(hubs)) == 64
        meeting = sorted((node, dict(hubs)[block]) for block, side, _, node, _ in got if side == 1)
        assert meeting == sorted((node, hub) for node, _, hub in members)  # each meets its hub, once
    sized.unpersist()


def test_near_duplicates_of_large_ids_beside_null_ones(spark):
    from listwright.llm.op9_minmax import classes

    big = (1 << 62) + 1
    df = spark.createDataFrame([(big, "a b c d"), (None, "a b c d"), (big + 1, "x y")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in classes(df, 2).collect()) == [(0, big, False), (big, big, True), (big + 1, big + 1, True)]


def test_components_of_a_chain(spark):
    from listwright.llm.common import components

    edges = spark.range(300).selectExpr("(id * 7919) % 301 as a", "((id + 1) * 7919) % 301 as b").union(spark.createDataFrame([(None, 3), (500, 501), (501, 500)], "a long, b long"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {500: 500, 501: 500}


# 10 --------------------------------------------------------------------------------------------


def plain_scores(rows, order, alpha):
    grams, own = Counter(), []
    for _, text in rows:
        w = words(lower(text))
        mine = Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
        own.append((w, mine))
        grams.update(mine)
    total = sum(n for g, n in grams.items() if len(g) == 1)
    out = []
    for (doc_id, _), (w, mine) in zip(rows, own):
        left = lambda g: grams[g] - mine[g]  # noqa: B023, E731
        others, log = total - len(w), 0.0
        for i in range(len(w)):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if left(g):
                    log += math.log10(factor * left(g) / (left(g[:-1]) if n > 1 else others))
                    break
                factor *= alpha
            else:
                log += math.log10(factor / alpha / (others + 1))
        out.append((doc_id, len(w), log))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores(docs, rows, order):
    from listwright.llm.op10_backoff import scores

    data = [(i, t) for i, t, _, _ in rows]
    got, far = (sorted(((r.doc_id, r.n_words, r.log10_score) for r in scores(docs, order=order, block_bytes=100_000, **more).collect()), key=str) for more in ({}, {"one_hop": 1}))
    assert [x[:2] for x in far] == [x[:2] for x in got] and np.allclose([x[2] for x in far], [x[2] for x in got], rtol=1e-9)
    want = sorted(plain_scores(data, order, 0.4), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-9)
    assert scores(empty(docs), order=order).count() == 0


def test_registered_backoff_tells_fluent_trigrams_from_broken_ones(spark, tmp_path):
    from listwright.llm.queries import op10_stupid_backoff

    # every word and bigram of both last documents occurs elsewhere, "one two three" does and "one two four" does not
    texts = ["zero one two three", "five one two three", "six two four", "seven two four", "one two three", "one two four"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.n_words, r.log10_score) for r in op10_stupid_backoff(spark, str(tmp_path)).collect())
    want = sorted(plain_scores(list(enumerate(texts)), 3, 0.4))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want])
    by_id = {d: s for d, _, s in got}
    assert by_id[4] > by_id[5] + 0.3
