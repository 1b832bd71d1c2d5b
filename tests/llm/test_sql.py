"""The SQL of the registered queries on rows that the given tables have not."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.llm.test_operators import docs, empty  # noqa: F401


def plain(found):
    return sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in found)


@pytest.mark.parametrize("name", ["op4_flow_mixing", "op9_minmax_near_dedup", "op10_stupid_backoff"])
def test_awkward_documents(spark, docs, name, tmp_path):  # noqa: F811
    for part in (docs, empty(docs)):
        folder = tmp_path / str(part is docs)
        part.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(folder / "documents.parquet"))
        duck = duckdb.connect()
        duck.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
        got = entry.queries()[name](spark, str(folder))
        want = duck.sql(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
        assert plain(got.collect()) == plain(want)


def test_documents_without_words_do_not_move_the_end_of_the_mix(spark, monkeypatch):
    from listwright.llm import op4_mixing

    # all are drawn alike and so taken by id; the one that crosses the rest is left, and one without words comes behind all
    monkeypatch.setattr(op4_mixing, "drawn", lambda seed: F.lit(5).cast("long"))
    data = [(i, "w " * 10, "ab"[i % 2]) for i in range(40)] + [(99, "", "a"), (98, None, "b")]
    got = op4_mixing.mixed(spark.createDataFrame(data, "doc_id long, text string, source string"))
    assert {r.source: r.taken for r in got.groupBy("source").agg(F.sum("taken").alias("taken")).collect()} == {"a": 130, "b": 270}
