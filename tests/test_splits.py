"""Reading in splits gives what reading the whole text gives, wherever it is cut."""

import random

import pytest
from pyspark.sql import functions as F

from listwright.sources import splits
from listwright.sources.leads import ParseError, leads_from_text, parse, records
from listwright.operators import mapping


def drawn(seed, n=60):
    rng = random.Random(seed)
    marks = ['"', '"', ",", "\n", "\n", "\r\n", "\r", "a", "b c", "é", '""', "x,y\n", ";"]
    return "".join(rng.choice(marks) for _ in range(rng.randint(1, n)))


def read_in_parts(parts, delimiter):
    """The parts' summaries put together in order, and each part read from its state."""
    inside, line, pending, out = False, 1, None, []
    for k, text in enumerate(parts):
        turn, lines0, lines1, _, _, _ = splits.summary(text)
        for kind, at, what, open_end in splits.pieces(text, inside, line, k == len(parts) - 1, delimiter):
            if kind == "head":
                pending[1] += what
                if splits.first_end(what, True):
                    out += torn(pending, delimiter)
                    pending = None
            elif kind == "tail":
                pending = [at, what]
            else:
                out.append((at, what, open_end))
        inside, line = inside != bool(turn), line + (lines1 if inside else lines0)
    return out + (torn(pending, delimiter) if pending else [])


def torn(pending, delimiter):
    return [(pending[0] + at - 1, fields, open_end and pending[0] + open_end - 1) for at, fields, open_end in records(pending[1], delimiter)]


def test_every_cut_of_random_texts():
    for seed in range(400):
        text = drawn(seed)
        want = [(a, f, e) for a, f, e in records(text, ",")]
        ends = [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)]
        for cut in ends:
            assert read_in_parts([text[:cut], text[cut:]], ",") == want, (seed, cut)
        bounds = [0, *ends, len(text)]
        assert read_in_parts([text[a:b] for a, b in zip(bounds, bounds[1:])], ",") == want, seed


@pytest.fixture
def tiny(spark):
    """Ranges of a few bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "24", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def texts():
    rng = random.Random(2)
    yield "﻿Firm;Mail\n" + "".join(f'"{"x" * rng.randint(0, 20)}\n;{i}";m{i}\n' for i in range(8)) + "only\n;\n  \n\n"
    yield 'A,B\r\n1,2\r\n"open\nto the, end\n'
    yield 'A,B\n1,2\n3,"4\n5\n6'
    yield 'A,B\n"' + "long\n" * 30 + '",2\n7,8'
    for seed in range(3):
        yield "A,B\nk,l\n" + drawn(seed + 50, 90)


def test_files_in_tiny_ranges_equal_the_whole(tiny, tmp_path):
    for k, text in enumerate(texts()):
        path = tmp_path / f"list{k}.csv"
        path.write_bytes(text.encode())
        want = parse(text)
        assert k not in (0, 3) or splits.lines(tiny, str(path)).select("start").distinct().count() > 1
        got = splits.split_leads(tiny, str(path))
        assert (got.headers, got.delimiter, got.total) == (want.headers, want.delimiter, want.total), text
        assert [(r.id, list(r.fields)) for r in got.rows.orderBy("id").collect()] == list(enumerate(want.rows)), text
        assert sorted(map(tuple, got.malformed.collect())) == sorted(want.malformed), text
        assert (got.n_rows, got.n_malformed) == (len(want.rows), len(want.malformed)), text


def test_errors_and_bytes_that_are_no_text(spark, tmp_path):
    for name, content, error in (("e.csv", b"", "File is empty."), ("b.csv", b" \n\t\r\n", "File is empty."), ("q.csv", b'""', "File has no rows."), ("h.csv", b"A,B\n", "No data rows found."), ("m.csv", b"A,B\n1\n", "No data rows found.")):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(ParseError, match=error):
            splits.split_leads(spark, str(tmp_path / name))
    (tmp_path / "u.csv").write_bytes(b"A,B\n\xff\xfe,2\n")
    assert [list(r.fields) for r in splits.split_leads(spark, str(tmp_path / "u.csv")).rows.collect()] == [["��", "2"]]
    with pytest.raises(ParseError):
        splits.split_leads(spark, str(tmp_path / "*.csv"))


def test_summaries_of_lists_equal_the_whole(tiny, tmp_path):
    for k, text in enumerate([*texts(), " \n\t\n", '""', "A;B\n", "A\tB\n1\n"]):
        (tmp_path / f"{k:02}.csv").write_bytes(text.encode())
    got = {r.source_file.rsplit("/", 1)[1]: r for r in splits.list_summaries(tiny, str(tmp_path / "*.csv")).collect()}
    names = {",": "comma", ";": "semicolon", "\t": "tab"}
    for path in sorted(tmp_path.iterdir()):
        want, r = parse(path.read_bytes().decode()), got.pop(path.name)
        assert r.error == (want.error or (None if want.rows else "No data rows found.")), path.name
        if not want.error:
            assert (r.rows, r.delimiter, r.malformed) == (len(want.rows), names[want.delimiter], len(want.malformed)), path.name
    assert not got


def test_a_list_says_what_it_holds_without_a_job(spark, tmp_path):
    (tmp_path / "a.csv").write_text('A,B\n1,2\nonly\n3,"4')
    for w in (splits.split_leads(spark, str(tmp_path / "a.csv")), leads_from_text(spark, 'A,B\n1,2\nonly\n3,"4')):
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        assert w.summary() == "2 rows, comma delimited, 2 malformed"
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
        assert (w.rows.count(), w.malformed.count()) == (2, 2)


def test_lists_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Company,Website\nOne,one.example\n\nbad\nTwo,two.example\n")
    (tmp_path / "b.csv").write_text("Website;Organization;zip;Organization\nthree.example;first;9;Three\n")
    (tmp_path / "c.csv").write_text("﻿Mail\tEmployer\nx@four.example\tFour\n")
    (tmp_path / "d.csv").write_text("Website\nnobody.example\n")
    (tmp_path / "e.csv").write_text("")
    got = splits.read_lists(spark, str(tmp_path / "*.csv")).orderBy("id").collect()
    assert [(r.company, r.domain, r.email, r.row) for r in got] == [("One", "one.example", "", 0), ("Two", "two.example", "", 1), ("Three", "three.example", "", 0), ("Four", "", "", 0)]
    assert len({r.id for r in got}) == 4


def test_places_equal_the_suggested_mapping(spark):
    rng = random.Random(3)
    pool = ["Company", "company_name", "E-mail", "Work Email", "First", "URL", "zip", "Surname", "town", " State ", "# Employees", "Organization"]
    lists = [[rng.choice(pool) for _ in range(rng.randint(1, 7))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, h array<string>")
    for r in df.select("i", *[mapping.place_of(F.col("h"), k).alias(k) for k in mapping.KEYS]).collect():
        found = mapping.suggest_mapping(lists[r.i])
        assert {k: lists[r.i][r[k] - 1] if r[k] else None for k in mapping.KEYS} == found
        assert all(not r[k] or lists[r.i][r[k]:].count(found[k]) == 0 for k in mapping.KEYS)


def test_exports_in_parts_are_the_file(spark, tmp_path):
    from listwright.operators import report
    from listwright.plans import registry

    r = registry.lead_records(spark, "/root/testdata/sf0.001")
    for k, df in enumerate((r, r.where("1 = 0"))):
        path = tmp_path / f"out{k}"
        assert report.write_export(df.repartition(3), str(path)) == df.count()
        parts = sorted(path.iterdir())
        assert b"".join(p.read_bytes() for p in parts).decode() == report.export_text(df) and all(p.name.startswith("part-") for p in parts)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    report.write_export(r, f"file://{tmp_path}/out0", "needs-enrichment", mode="overwrite")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    parts = sorted((tmp_path / "out0").iterdir())
    assert len(parts) > 1 and b"".join(p.read_bytes() for p in parts).decode() == report.export_text(r, "needs-enrichment")
    assert parts[0].read_bytes().startswith(b"Company,Domain")
