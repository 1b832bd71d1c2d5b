"""The list-cleaning engine: properties of its rules on drawn data, and stated facts."""

import random
import re
import string

import duckdb
import pytest
from pyspark.sql import functions as F

from listwright.functions import rubric, text
from listwright.functions.schema import FIELDS, KEYS, LABELS, SUFFIXES
from listwright.operators import dedup, mapping, report, review
from listwright.operators.lineage import cut
from listwright.plans import registry
from listwright.plans.session import Workspace
from listwright.sources.leads import ParseError, detect_delimiter, parse, rows_to_maps

STEMS = ["Quarry", "Birch", "Lantern", "Mosaic", "Pylon", "Estuary", "Gable", "Thicket"]


def values(spark, f, inputs):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def word(rng, low=3, high=9):
    return "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(low, high)))


# Parsing ---------------------------------------------------------------------------------------------


def written(rng, rows, mark, end):
    """Rows as text, cells quoted wherever they must be and now and then where they need not."""

    def cell(v):
        return '"' + v.replace('"', '""') + '"' if any(c in v for c in (mark, '"', "\r", "\n")) or rng.random() < 0.2 else v

    return end.join(mark.join(map(cell, r)) for r in rows)


@pytest.mark.parametrize("mark", [",", ";", "\t"])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_what_is_written_is_read_again(mark, end):
    rng = random.Random(mark + end)
    for _ in range(60):
        width = rng.randint(2, 5)
        head = [word(rng) + str(i) for i in range(width)]
        rows = [["".join(rng.choice('xyz "\n' + mark) for _ in range(rng.randint(0, 5))) + "k" for _ in range(width)] for _ in range(rng.randint(0, 6))]
        source = rng.choice(["", "﻿"]) + end.join([mark.join(head)] * 10)  # ten lines tell the delimiter
        p = parse(source + end + written(rng, rows, mark, end) + rng.choice(["", end, end * 2]) if rows else source)
        assert p.delimiter == mark and p.headers == head and p.rows == [head] * 9 + rows and not p.malformed and p.error is None


def test_quotes_open_anywhere_and_blank_lines_are_passed_over():
    p = parse('A,B\nle"ft, ri"ght,1\n  \nx,"y""z"w\n\n')
    assert p.rows == [["left, right", "1"], ["x", 'y"zw']] and p.total == 3
    assert parse("\nP,Q\n").headers == [""] and parse("\nP,Q\n").malformed == [(2, "P,Q", "Expected 1 columns, found 2.")]
    assert detect_delimiter("p,q;r\n") == "," and detect_delimiter('"p;q;r",s\n') == "," and detect_delimiter("p") == ","
    assert detect_delimiter("a,b\n" * 10 + "a;b;c;d\n" * 50) == ","  # only ten lines count


def test_ragged_rows_and_open_quotes_are_kept_apart():
    rng = random.Random(8)
    for _ in range(40):
        rows = [[word(rng) for _ in range(rng.choice([3, 3, 2, 4]))] for _ in range(12)]
        p = parse("\n".join(",".join(r) for r in [["P", "Q", "R"], *rows]))
        assert p.rows == [r for r in rows if len(r) == 3]
        assert p.malformed == [(i + 2, ",".join(r), f"Expected 3 columns, found {len(r)}.") for i, r in enumerate(rows) if len(r) != 3]
    p = parse('P,Q\n1,2\n"two\nlines",z\n3,"open')
    assert p.rows[-1] == ["3", "open"] and p.malformed == [(5, "(end of file)", "Unterminated quoted field at end of file — last record may be truncated.")]
    assert parse('P,Q\n1,2\n"').malformed == []


def test_errors_are_values():
    assert [parse(x).error for x in (None, 7, "", " \n\t", '""')] == ["Input is not text.", "Input is not text.", "File is empty.", "File is empty.", "File has no rows."]
    assert rows_to_maps(["A", "A", "B"], [["1", "2", "3"], ["4"]]) == [{"A": "2", "B": "3"}, {"A": "", "B": ""}]
    assert report.to_csv(["A", "B"], [{"B": None, "A": 'x"y'}]) == 'A,B\r\n"x""y",'


# Functions --------------------------------------------------------------------------------------------


def test_a_suffix_changes_neither_name_nor_key(spark):
    rng = random.Random(3)
    names = [f"{rng.choice(STEMS)}{word(rng)} {rng.choice(STEMS)}" for _ in range(120)]
    dressed = []
    for n in names:
        tail = "".join(rng.choice([" ", ", ", "  "]) + rng.choice([str.upper, str.lower, str.title])(rng.choice(SUFFIXES)) + rng.choice(["", "."]) for _ in range(rng.randint(1, 3)))
        dressed.append(rng.choice(["", " ", "\t　"]) + n.replace(" ", rng.choice([" ", "   "])) + tail + rng.choice(["", ",", ".", " "]))
    assert values(spark, text.normalize_company, dressed) == names
    assert values(spark, text.company_key, dressed) == [re.sub("[^a-z0-9]", "", n.lower()) for n in names]


def test_suffixes_are_stripped_token_by_token(spark):
    rng = random.Random(9)
    single = {s for s in SUFFIXES if " " not in s}
    names = [" ".join(rng.choice([*single, "mill", "weir", "x1"]) for _ in range(rng.randint(1, 6))) for _ in range(2000)]

    def rule(name):
        tokens = name.split(" ")
        while len(tokens) > 1 and tokens[-1] in single:
            tokens.pop()
        return " ".join(tokens)

    assert [g.lower() for g in values(spark, text.normalize_company, names)] == list(map(rule, names))


def test_case_changes_only_where_a_name_has_one_case(spark):
    rng = random.Random(5)
    words = [word(rng, 4, 8) for _ in range(80)]
    title = [w.capitalize() for w in words]
    assert values(spark, text.normalize_company, words) == title == values(spark, text.normalize_company, [w.upper() for w in words])
    mixed = [w[0] + w[1:].upper() for w in words]
    assert values(spark, text.normalize_company, mixed) == mixed
    facts = {"QRS LAMPS": "QRS Lamps", "qrs lamps": "Qrs Lamps", "(BIRCH ARM O'DAY": "(Birch ARM O'day", "ÉTAGE BIRCH": "ÉTage Birch", "LLC": "LLC", "Weir,LLC": "Weir,LLC", "": "", None: "", "鉄道": "鉄道"}
    assert dict(zip(facts, values(spark, text.normalize_company, facts))) == facts
    assert values(spark, text.company_key, ["鉄道", None]) == ["", ""]


def test_what_surrounds_a_host_does_not_change_it(spark):
    rng = random.Random(6)
    hosts = [".".join(word(rng, 1, 8) for _ in range(rng.randint(1, 3))) + "." + word(rng, 2, 5) for _ in range(150)]
    around = []
    for h in hosts:
        shown = rng.choice([h, h.upper()])
        kind = rng.randrange(3)
        if kind == 0:
            around.append(f"{word(rng)}@{shown}")
        else:
            around.append(rng.choice(["", "http://", "HTTPS://"]) + rng.choice(["", "www.", "WWW."]) + shown + rng.choice(["", ":8080"]) + rng.choice(["", "/", "/p?q=1", "#f", "?x=/y"]))
    around = [rng.choice(["", " ", "﻿"]) + a + rng.choice(["", "\n", " "]) for a in around]
    assert values(spark, text.extract_domain, around) == hosts
    assert values(spark, text.extract_domain, [h + "." for h in hosts]) == hosts and all(values(spark, text.is_valid_domain, hosts))
    assert values(spark, text.extract_domain, ["no site", "", None, "https://u:p@h.io/x", "https://h.io/@u", "x" * 250 + ".io"]) == [None] * 6


def test_domains_that_are_none(spark):
    rng = random.Random(7)
    for damage in (lambda h: h.replace(".", "..", 1), lambda h: "." + h, lambda h: "-" + h, lambda h: h.split(".")[0], lambda h: h + "\n", lambda h: h[:-1] + "1", lambda h: h + "." + "y" * 64):
        assert not any(values(spark, text.is_valid_domain, [damage(word(rng) + "." + word(rng, 2, 4)) for _ in range(20)]))
    mails = [f"{word(rng)}@{word(rng)}.{word(rng, 1, 3)}" for _ in range(30)]
    assert all(values(spark, text.is_likely_email, [f" {m}\t" for m in mails]))
    for damage in (lambda m: m.replace("@", " @"), lambda m: m.replace("@", "@@"), lambda m: m.replace(".", ""), lambda m: m.replace("@", ""), lambda m: m[: m.index("@") + 1]):
        assert not any(values(spark, text.is_likely_email, map(damage, mails)))


def test_distance_and_similarity(spark):
    rng = random.Random(2)
    data = []
    for _ in range(200):
        a = word(rng, 4, 12)
        k = rng.randint(0, 3)
        b = a + "".join(rng.choice("0123456789") for _ in range(k))  # k letters that a has not: k edits
        data.append((a, b, k))
    df = spark.createDataFrame([*data, (None, "four", 4), (None, "", 0)], "a string, b string, k int")
    got = df.select("a", "b", "k", text.distance(F.col("a"), F.col("b")).alias("d"), text.distance(F.col("b"), F.col("a")).alias("e"), text.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        longest = max(len(r.a or ""), len(r.b))
        assert r.d == r.e == r.k and abs(r.s - (1 - r.k / longest if longest else 1)) < 1e-12


def test_sql_functions(spark):
    text.register_sql(spark)
    r = spark.sql("select normalize_company('GABLE, LLC') n, company_key('Gable Inc') k, extract_domain('https://www.x.io/a') d, is_valid_domain('x') v").first()
    assert tuple(r) == ("Gable", "gable", "x.io", False)


# Mapping, records, rubric --------------------------------------------------------------------------------


def test_headers_find_their_fields():
    rng = random.Random(1)
    for _ in range(100):
        chosen = {key: rng.choice([a for a in aliases if a == mapping.normalize_header(a)]) for key, _, aliases in FIELDS if rng.random() < 0.6}
        shown = {k: rng.choice(["", " "]) + rng.choice([str.upper, str.title, str.lower])(a.replace(" ", rng.choice([" ", "_", "-", "  "]))) for k, a in chosen.items()}
        headers = [*shown.values(), "zip", "E-mail"]
        rng.shuffle(headers)
        found = mapping.suggest_mapping(headers)
        assert {k: h for k, h in found.items() if h} == shown
        if "company" in shown:
            assert mapping.confirm_mapping(headers, found) == found
        else:
            with pytest.raises(mapping.MappingError):
                mapping.confirm_mapping(headers, found)
    with pytest.raises(mapping.MappingError):
        mapping.confirm_mapping(["a"], {"company": "b"})


def test_scores_follow_the_weights(spark):
    rng = random.Random(4)
    for _ in range(12):
        items = [rubric.Item(k, LABELS[k], rng.randint(0, 9), rng.random() < 0.4) for k in rng.sample(KEYS, rng.randint(1, 8))]
        record = {k: rng.choice(["v", " ", None]) for k in KEYS}
        r = spark.range(1).select(rubric.score({k: F.lit(v) for k, v in record.items()}, items).alias("r")).first().r
        lacking = [i for i in items if record[i.field] != "v"]
        total, earned = sum(i.weight for i in items), sum(i.weight for i in items if i not in lacking)
        assert r.score == (int(earned / total * 100 + 0.5) if total else 0)
        assert [m.field for m in r.missing] == [i.field for i in lacking] and r.ready == (not any(i.required for i in lacking))
    r = spark.range(1).select(rubric.score({}, []).alias("r")).first().r
    assert (r.score, list(r.missing), r.ready) == (0, [], False)
    assert len(rubric.all_rows()) == 13 and sum(i.weight for i in rubric.active(rubric.all_rows())) == 100
    assert [rubric.weight_from_text(x) for x in ("12x", "-3", "", None)] == [12, 0, 0, 0]


# Duplicates ------------------------------------------------------------------------------------------------


def table(spark, leads):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(leads)], "id long, company string, domain string, email string")


def listed(groups):
    return [(list(r.ids), r.reason, round(r.score, 9)) for r in groups.orderBy("block_first", "local_no").collect()]


def by_sql(spark, df, threshold):
    """Groups of the pairs that match, folded by the recursive SQL of the registered queries."""
    p = dedup.candidate_pairs(df).withColumn("sim", text.similarity(F.col("key1"), F.col("key2")))
    reason = F.expr(f"case when dom1 = dom2 then 'exact-domain' when key1 = '' or key2 = '' then null when key1 = key2 then 'exact-name' when sim >= {threshold!r}D then 'fuzzy-name' end")
    duck = duckdb.connect()
    for name, found in (("matched", p.select("block", "id1", "id2", reason.alias("reason"), "sim")), ("keyed", dedup.keyed(df))):
        duck.register(f"{name}_rows", found.toArrow())
        duck.sql(f"create table {name} as select * from {name}_rows")
    return [(list(i), r, round(s, 9)) for i, r, s in duck.sql(f"WITH RECURSIVE {registry.FOLDED} SELECT ids, reason, score FROM groups ORDER BY block_first, local_no").fetchall()]


def drawn(seed, n):
    """Leads with few letters, domains that share a block, hot names and hot domains."""
    rng = random.Random(seed)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(rng.choice([3, 8, 40]))] + ["", "hotname"]
    hosts = ["", ""] + [f"fer{c}{d}.io" for c in "abc" for d in "xy"][: rng.choice([1, 3, 6])] + ["other.io"]
    return [(rng.choice(names) + rng.choice(["", "", "z"]), rng.choice(hosts), "") for _ in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_groups_equal_the_fold_of_all_pairs(spark, seed):
    df = table(spark, drawn(seed, 90))
    threshold = (0.5, 0.7, 0.85)[seed % 3]
    want = by_sql(spark, df, threshold)
    for split_above in (0, 10**9):  # by components, and by block
        got, _ = dedup.find_duplicates(df, threshold, split_above=split_above)
        assert listed(got) == want
    assert want


def test_classes_fold_as_their_pairs_do():
    """Many small lists straight through the fold, and all of them at once, pair by pair, in SQL."""
    lists, duck = {}, duckdb.connect()
    duck.sql("create table keyed (block int, id bigint, dom varchar, key varchar); create table near (block int, a varchar, b varchar, sim double)")
    for block in range(300):
        rng = random.Random(block)
        rows = [(1000 * block + 3 * i, rng.choice([None, "p", "q", "r"]), rng.choice(["", "m", "n", "o", "w"])) for i in range(rng.randint(2, 14))]
        close = [(*x, rng.choice([0.86, 0.9, 0.95])) for x in (("m", "n"), ("n", "o"), ("o", "w")) if rng.random() < 0.5]
        lists[block] = rows, close
        duck.executemany("insert into keyed values (?, ?, ?, ?)", [(block, *r) for r in rows])
        if close:
            duck.executemany("insert into near values (?, ?, ?, ?)", [(block, *c) for c in close])
    duck.sql("""create table matched as select * from (select x.block, x.id as id1, y.id as id2, case when x.dom = y.dom then 'exact-domain'
        when x.key <> '' and x.key = y.key then 'exact-name' when sim is not null then 'fuzzy-name' end as reason, sim
        from keyed x join keyed y on x.block = y.block and x.id < y.id left join near on near.block = x.block and a = least(x.key, y.key) and b = greatest(x.key, y.key))""")
    want = duck.sql(f"WITH RECURSIVE {registry.FOLDED} SELECT ids, reason, score FROM groups ORDER BY block_first, local_no").fetchall()
    got = [(list(g.ids), g.reason, g.score) for rows, close in lists.values() for g in dedup.fold(rows, close)]
    assert got == [(list(i), r, s) for i, r, s in want]


def test_one_large_domain_is_a_matter_of_seconds():
    import time

    n = 100_000
    rows = ((i, "hot.io", f"name{i % 997}") for i in range(n))
    began = time.time()
    groups = dedup.fold(rows, [(f"name{k}", f"name{k + 1}", 0.9) for k in range(996)])
    assert len(groups) == 1 and len(groups[0].ids) == n and groups[0].score == 1.0 and time.time() - began < 20


def test_many_components_of_one_block_are_dealt_out(spark):
    # one block, and pairs that have nothing to do with each other
    df = spark.range(4000).selectExpr("id", "'' as company", "concat('fer', id div 2, '.io') as domain", "'' as email")
    groups = dedup.assign_groups(dedup.keyed(df), split=True)
    assert groups.groupBy("block_first").agg(F.count("*").alias("n"), F.max("local_no").alias("last")).collect() == [(0, 2000, 1999)]
    assert groups.where("ids[1] <> ids[0] + 1 or size(ids) <> 2").isEmpty()
    parts = [x for x in groups._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(block" in x and "part" in x]
    assert parts


def test_groups_are_kept_up_to_date(spark):
    from listwright.operators.incremental import Matches

    df = table(spark, drawn(4, 120)).cache()
    for threshold in (0.5, 0.85):
        matches, groups = Matches.of(df.where("id % 5 <> 0")), None
        groups = matches.groups(threshold)
        matches, groups = matches.add(df.where("id % 5 = 0 and id < 70"), groups, threshold)
        matches, groups = matches.add(df.where("id % 5 = 0 and id >= 70"), groups, threshold)
        whole = listed(dedup.find_duplicates(df, threshold)[0])
        assert listed(groups) == listed(matches.groups(threshold)) == whole
    # a block that gets nothing new is not folded again
    other = table(spark, [("zzz", "qqq.io", "")]).selectExpr("id + 1000 as id", "company", "domain", "email")
    groups = cut(groups)
    again = matches.add(other, groups)[1]
    assert listed(again) == listed(groups)
    with pytest.raises(ValueError):
        matches.groups(0.4)
    df.unpersist()


def test_warning_and_thresholds(spark):
    df = table(spark, drawn(3, 30))
    assert dedup.find_duplicates(df)[1] is None and "30 rows" in dedup.find_duplicates(df, max_rows=29)[1] and dedup.find_duplicates(None) == (None, None)
    assert dedup.find_duplicates(df.where("1 = 0"))[0].collect() == []
    assert [dedup.clamp_threshold(x) for x in ("0.1", "x", "0.876", "7", "0.5")] == [0.5, None, 0.88, 1.0, 0.5]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.85, 0.9, 1.0])
def test_matching_pairs_equal_all_pairs_classified(spark, threshold):
    rng = random.Random(int(threshold * 100))
    leads = [("".join(rng.choice("abc ") for _ in range(rng.randint(0, 14))), rng.choice(["", "", "", "fern.io", "ferry.io", "fell.io"]), "") for _ in range(150)]
    leads += [(n[:k] + rng.choice("abc") + n[k + rng.randint(0, 1) :], "", "") for n, _, _ in leads[:80] for k in [rng.randint(0, len(n))]]
    df = table(spark, leads)
    p = dedup.candidate_pairs(df).withColumn("sim", text.similarity(F.col("key1"), F.col("key2")))
    reason = F.expr(f"case when dom1 = dom2 then 'exact-domain' when key1 = '' or key2 = '' then null when key1 = key2 then 'exact-name' when sim >= {threshold}D then 'fuzzy-name' end")
    want = p.withColumn("reason", reason).where("reason is not null").selectExpr("id1", "id2", "reason", "if(reason = 'fuzzy-name', sim, 1.0D) as score")
    got = dedup.matching_pairs(df, threshold).select("id1", "id2", "reason", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pieces_compare_few_names(spark):
    rng = random.Random(12)
    names = spark.createDataFrame([("b", word(rng, 14, 20)) for _ in range(600)], "block string, key string").withColumn("n", F.length("key"))
    assert dedup.compared_names(names, 0.85).count() < 600 * 599 / 2 / 10


# Review, export, whole lists -----------------------------------------------------------------------------------


def test_ledger():
    e = review.Event
    s = review.fold_ledger([e("merge", (5, 2, 9), 2), e("discard", (5,)), e("keep", (7, 8)), e("undo")])
    assert s.records == {5: (None, 2), 9: (None, 2)} and s.groups == {"2-5-9": "merged"}
    assert review.fold_ledger([e("discard", (1,)), e("discard", (1,)), e("undo"), e("undo")]).records == {}
    s = review.fold_ledger([e("discard", (3,)), e("merge", (1, 2, 3)), e("merge", (1, 2, 3), 2), e("undo"), e("undo"), e("undo"), e("undo"), e("keep", (9, 8))])
    assert s.records == {} and s.groups == {"8-9": "kept-separate"}


@pytest.mark.parametrize("n, ids, undo", [(3000, 300, 0.3), (3000, 3000, 0.48), (2000, 40, 0.0), (1, 5, 0.0), (30, 4, 0.7)])
def test_a_ledger_table_folds_as_a_list_does(spark, n, ids, undo):
    rng = random.Random(n + ids)
    events = []
    for k in range(n):
        if rng.random() < undo:
            events.append(review.Event("undo"))
        elif rng.random() < 0.5:
            events.append(review.Event("discard", (rng.randrange(ids),)))
        else:
            some = tuple(rng.randrange(ids) for _ in range(rng.randint(1, 4)))
            events.append(review.Event(rng.choice(["merge", "merge", "keep"]), some, rng.choice([None, some[-1]])))
    state = review.fold_ledger(events)
    df = spark.createDataFrame([(5 * k, e.action, list(e.ids), e.primary) for k, e in enumerate(events)], "seq long, action string, ids array<long>, primary long").repartition(7)
    stand = review.standing(review.touches(df))
    assert {r.id: (r.exclude_reason, r.merged_into) for r in review.effects(stand).collect()} == state.records
    keys = df.where("action in ('merge', 'keep')").select("seq", text.group_key(F.col("ids")).alias("group_key"))
    assert {r.group_key: r.resolution for r in review.resolutions(stand, keys).collect()} == state.groups


def test_an_empty_ledger_table(spark):
    df = spark.createDataFrame([], "seq long, action string, ids array<long>, primary long")
    assert review.effects(review.standing(review.touches(df))).collect() == []


LIST = """Business Name,URL,E_mail,Contact Email,Given Name,Sector
Gable Inc.,https://www.gable.pt,,ann@gable.pt,Ann,Roofs
"GABLE, LLC",gable.pt,,a@gable.pt,Ann,Roofs
pylon,,,raj@pylon.dev,Raj,
Too short,only two
,bad domain,,nope,,
"""


def test_workspace(spark, tmp_path):
    path = tmp_path / "leads.csv"
    path.write_text(LIST)
    w = Workspace.read(spark, str(path))
    assert w.parsed.summary() == "4 rows, comma delimited, 1 malformed"
    assert tuple(w.kpi_row().first()) == (4, 1, 1, 1, 0, "3 / 4", 1)
    w = w.decide(review.Event("merge", (0, 1)), review.Event("discard", (3,)))
    assert tuple(w.kpi_row().first()) == (4, 1, 1, 0, 2, "2 / 2", 1)
    assert [r.status for r in w.preview().orderBy("row").collect()] == ["active", "merged → #1", "active", "discarded"]
    assert w.decide(review.Event("undo")).preview().where("row = 4").first().domain == "invalid: bad domain"
    lines = w.export().split("\r\n")
    assert lines[1] == "Gable,gable.pt,ann@gable.pt,Ann,,,,Roofs,,,,,,80,yes," and len(lines) == 3
    assert w.export("needs-enrichment").count("\r\n") == 0
    assert w.with_threshold("2").threshold == 1.0 and w.reset().ledger == ()
    with pytest.raises(ParseError):
        Workspace.read(spark, str(tmp_path / "leads.xls"))
    with pytest.raises(ParseError):
        Workspace.of_text(spark, "A,B\n")


def test_sample_list(spark):
    w = Workspace.sample(spark)
    assert w.parsed.summary() == "8 rows, comma delimited, 0 malformed" and w.mapping["employeeCount"] == "Headcount" and w.mapping["state"] is None
    assert tuple(w.kpi_row().first()) == (8, 0, 3, 3, 0, "4 / 8", 1)
    got = [(list(r.ids), r.reason) for r in w.groups().orderBy("block_first", "local_no").collect()]
    assert got == [([0, 1], "exact-domain"), ([2, 3], "exact-domain"), ([4, 5], "exact-name")]
    assert tuple(report.export_counts(w.records()).first()) == (8, 4)
    assert w.decide(review.Event("merge", (0, 1))).export().split("\r\n")[1].startswith("Harbour & Vale,harbourvale.example,ida@")


def test_stream(spark, tmp_path):
    from listwright.streaming.stateless import scored_stream

    rows = spark.createDataFrame([(1, "GABLE INC", "gable.pt", "a@gable.pt")], "id long, c string, d string, e string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = scored_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), {"company": "c", "domain": "d", "email": "e"})
    q = stream.writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("select normalized_company n, result.score s from scored").first()
    assert (r.n, r.s) == ("Gable", 70)
