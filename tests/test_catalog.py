"""Every named query against its SQL on the smallest tables, and the entry module with and without its optional part."""

import os
import subprocess
import sys

import pytest

from cedarledger.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(
        (
            tuple(
                f"{x:.6f}" if isinstance(x, float) else None if x != x or x is None else str(x) for x in r
            ) for r in df.astype(object).where(df.notna(), None).itertuples(index=False)
        ),
        key=str
    )


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    assert plain(catalog.queries()[name](spark, SF).toPandas()) == plain(duck.execute(catalog.oracle_sql()[name]).df())


def test_no_neighbours_without_the_query_vector(spark, tmp_path):
    for i, ids in enumerate(([], [1, 2])):
        spark.createDataFrame(
            [(k, [1.0, 0.5]) for k in ids], "vec_id long, embedding array<float>"
        ).write.parquet(f"{tmp_path}/{i}/embeddings.parquet")
        assert catalog.vector_topk(spark, f"{tmp_path}/{i}").collect() == []


def test_filters_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F

    df = catalog.balance_drift(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "o_orderpriority" not in plan and "BatchEvalPython" not in plan and F is not None


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_optional_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for x in os.listdir(root):
        if x in ("__spark_entry__.py",):
            (tmp_path / x).symlink_to(f"{root}/{x}")
    (tmp_path / "cedarledger").mkdir()
    for x in os.listdir(f"{root}/cedarledger"):
        if x not in ("llm", "__pycache__"):
            (tmp_path / "cedarledger" / x).symlink_to(f"{root}/cedarledger/{x}")
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2:3].isdigit() for n in e.queries()), len(e.oracle_sql()))"
    out = subprocess.run(
        [sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)},
        capture_output=True, text=True, timeout=120
    )
    assert out.returncode == 0, out.stderr
    n, llm, sql = out.stdout.split()
    assert int(n) == len(catalog.queries()) and llm == "False" and int(sql) == len(catalog.oracle_sql())
