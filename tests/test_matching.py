"""Names in texts, against trying every name on every text; long filing lists; runs that processes share."""

import json
import random

from cedarledger.operators import matching
from cedarledger.sources import filings


def test_names_against_every_pair(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abAB é#") for _ in range(n))
    names = [word(r.choice((1, 2, 3, 5, 8, 9, 12))) for _ in range(150)] + ["", None, "Plaza", "plaza", "aaaa", "aaaaaaaaaaaa"]
    texts = [(i, word(r.choice((0, 1, 3, 10, 60)))) for i in range(80)]
    texts += [(80, None), (81, "The PLAZA"), (82, "a" * 5000), (82, "a" * 5000), (83, max((n for n in names if n), key=len).upper())]
    texts = [(k, t if i % 9 or t is None else f"{t}{r.choice([n for n in names if n])}z") for i, (k, t) in enumerate(texts)]
    got = matching.contained(
        spark.createDataFrame(texts, "question_id int, question string"), spark.createDataFrame([(n,) for n in names], "name string")
    ).collect()
    want = {(k, n) for k, t in texts for n in names if n and t and n.lower() in t.lower()}
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    empty = spark.createDataFrame([], "name string")
    assert matching.first_contained(spark.createDataFrame(texts, "question_id int, question string"), empty).count() == 0


def test_names_are_never_one_row(spark):
    names = spark.range(50_000).selectExpr("concat('Building ', id, ' Court') AS name")
    asked = spark.range(2_000).selectExpr("id AS question_id", "concat('noi of building ', id * 25, ' court?') AS question")
    found = matching.first_contained(asked, names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan and "collect_set" not in plan
    rows = {r["question_id"]: r["name"] for r in found.collect()}
    assert rows == {i: f"Building {i * 25} Court" for i in range(2_000)}


def lists(ns):
    return {
        "accessionNumber": [f"a{n}" for n in ns], "filingDate": [f"2024-01-{n:02d}" for n in ns],
        "reportDate": [""] * len(ns), "form": ["10-D"] * len(ns), "primaryDocument": ["x.htm"] * len(ns)
    }


def test_filing_lists_go_on_in_further_files(spark, tmp_path):
    def put(folder, name, content):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(json.dumps(content))

    main = lambda ns, files: {"cik": "7", "name": "Deal", "filings": {"recent": lists(ns), "files": files}}
    put("whole", "CIK7.json", main([9, 8, 7, 6, 5, 4, 3], []))
    put("split", "CIK7.json", main([9, 8, 7], [{"name": "CIK7-001.json"}, {"name": "CIK7-002.json"}, {"name": "gone.json"}]))
    put("split", "CIK7-001.json", lists([7, 6, 5]))  # one that the main list has too
    put("split", "CIK7-002.json", lists([4, 3]))
    put("split", "stray.json", lists([1]))  # nobody names it
    whole, split = (filings.submissions(spark, str(tmp_path / f)).orderBy("seq").collect() for f in ("whole", "split"))
    assert whole == split and [r["accession_number"] for r in split] == ["a3", "a4", "a5", "a6", "a7", "a8", "a9"]


def test_pieces_of_a_small_file_are_not_broadcast(spark, tmp_path):
    spark.range(3_000).selectExpr("id AS question_id", "concat('tell me about Brand#', id % 25, ' and more') AS question", "concat('Brand#', id % 25) AS name").coalesce(1).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    found = matching.contained(t, t)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == plan.count("BroadcastHashJoin") == 1  # the sieve's longs
    assert found.count() == sum(1 + (i % 25 > 9) for i in range(3_000))  # Brand#1 is in Brand#10 too


def test_names_within_a_column(spark):
    texts = spark.createDataFrame([(1, 1, "has aB and cd"), (2, 2, "has ab and cd"), (3, None, "ab cd"), (4, 3, "ab")], "question_id int, at int, question string")
    names = spark.createDataFrame([(1, "AB"), (1, "x"), (2, "cd"), (2, "d"), (None, "ab"), (3, "")], "at int, name string")
    got = sorted(tuple(r) for r in matching.contained(texts, names, within="at").collect())
    assert got == [(1, 1, "AB"), (2, 2, "cd"), (2, 2, "d")]
