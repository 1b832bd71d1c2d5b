"""The pipeline on the smallest tables, stage by stage against what each stage has to do."""

import re
from collections import Counter

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import corpus_pipeline as p

    from .test_operators import plain_classes, plain_spans

    assert [n for n, _ in p.STAGES] == ["language", "near_dedup", "decontaminate", "personal", "mix"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(910001, None, "en", "src0", 0), (910002, "1 2 3", "en", "src0", 5), (None, "a row of its own without id", "en", "src0", 27),
           (910003, "twice the very same row", "en", None, 23), (910003, "twice the very same row", "en", None, 23)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("n", F.lit(0))
    kept = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        if name != "mix":
            assert out.columns == p.COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
        assert kept[name]
    letter = lambda t: t and re.search(r"[^\W\d_]", t)
    before = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [x[:2] for x in odd]
    assert Counter(kept["language"]) == Counter(x for x in before if letter(x[1]))
    want = {(d, t) for (d, t), (_, _, c) in zip(kept["language"], plain_classes(kept["language"], 5, 80)) if d == c or d is None}
    assert Counter(kept["near_dedup"]) == Counter(want)
    assert set(kept["decontaminate"]) <= set(kept["near_dedup"])
    assert len(kept["personal"]) == len(kept["decontaminate"])
    assert not any(plain_spans(t) for _, t in kept["personal"])
    rows = docs.collect()
    assert {(r.doc_id, r.text) for r in rows} <= set(kept["personal"])
    assert all(r.taken == r.size * r.repeats and 0 < r.repeats <= 3 for r in rows)


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("1 = 0").withColumn("root", F.lit(1)).withColumn("key", F.lit(2))
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and out.columns[:5] == p.COLUMNS


def test_an_id_with_several_texts_loses_no_text(spark):
    import corpus_pipeline as p

    long = " ".join(f"w{i}" for i in range(60))
    data = [(3, long, "en", "s", 1), (5, "a text of its own that no other row has", "en", "s", 1), (5, long + " more", "en", "s", 1), (6, None, "en", "s", 1), (6, " ", "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    for k in (1, 4):
        got = Counter((r.doc_id, r.text) for r in p.near_dedup(spark, docs.repartition(k), SF).collect())
        assert got == Counter({(3, long): 1, (5, data[1][1]): 1, (6, None): 1, (6, " "): 1, (None, None): 1})


def test_run(spark):
    import os

    import corpus_pipeline as p
    from listwright.llm.common import clean, own_folder

    clean(spark)
    out = p.run(spark, SF)
    assert out.count() > 0
    folder = own_folder(spark).removeprefix("file:")
    assert [x.split("-")[0] for x in os.listdir(folder)] == ["mix"]  # nothing else is left behind
    clean(spark)
    assert not os.path.exists(folder)
