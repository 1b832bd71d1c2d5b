"""License scans against the cosine of every window of every template; nothing here knows how candidates are found."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from listwright.llm.op3_licences import COSINE, TEMPLATES, all_templates, licences

SHORT = {
    "This project is licensed under the MIT License - see the LICENSE.md file": "MIT", "Released under the terms of the MIT License": "MIT",
    "License :: OSI Approved :: MIT License": "MIT", "Licensed under GPL v2 or later": "GPL-2.0", "Licensed under the GNU GPLv3": "GPL-3.0",
    "This software is licensed under the BSD 2-Clause license": "BSD-2-Clause", "Licensed under the ISC license": "ISC",
}
TOKEN = re.compile("[a-z0-9]+(?:[.-][a-z0-9]+)*")


def best_windows(texts):
    """The best cosine of each text: all windows of a template's length, all templates."""
    n, df = len(texts), Counter(w for t in texts for w in set(t))
    idf = lambda x: math.log((n + 1) / (df[x] + 1)) + 1
    out = [0.0] * n
    for _, template in all_templates():
        u, size = {x: c * idf(x) for x, c in Counter(template).items()}, len(template)
        norm = math.sqrt(sum(x * x for x in u.values()))
        for i, w in enumerate(texts):
            if u.keys().isdisjoint(w):
                continue
            held = Counter(w[:size])
            for s in range(max(1, len(w) - size + 1)):
                if s:
                    held[w[s - 1]] -= 1
                    held[w[s + size - 1]] += 1
                dot = sum(u[x] * held[x] * idf(x) for x in u)
                if dot:
                    out[i] = max(out[i], dot / norm / math.sqrt(sum((c * idf(x)) ** 2 for x, c in held.items())))
    return out


def test_recall(spark):
    rng = random.Random(1)
    filler = [f"w{i}" for i in range(2000)]
    some = lambda k: [rng.choice(filler) for _ in range(k)]
    texts = list(SHORT)
    for _ in range(160):
        wording, rate, out = rng.choice(TEMPLATES)[1].split(), rng.choice([0, 0.05, 0.1, 0.2]), []
        for x in wording:  # words are left out, put in and replaced
            r = rng.random()
            out += [] if r < rate / 3 else [*some(1), x] if r < 2 * rate / 3 else some(1) if r < rate else [x]
        texts.append(" ".join([*some(rng.randint(5, 60)), *out, *some(rng.randint(5, 60))]))
    texts += [" ".join(some(80)) for _ in range(160)]
    want = {i for i, c in enumerate(best_windows([TOKEN.findall(t.lower()) for t in texts])) if c >= COSINE}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("l")})
    got = {r.doc_id: r for r in licences(df, F.concat(F.lit("d/"), F.col("doc_id").cast("string"))).collect()}
    own = {i for i, r in got.items() if r.origin == "own"}
    assert own <= want and len(want) > 120 and len(own) >= 0.95 * len(want)
    assert [got[i].license for i in range(len(SHORT))] == list(SHORT.values())
