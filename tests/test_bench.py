import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_line_with_all_figures():
    """The whole program on the smallest tables, over a few queries; a query that fails is named and hides no other."""
    code = (
        "import bench, __spark_entry__ as e; q = e.queries()\n"
        "def broken(spark, sf_dir): raise ValueError('no')\n"
        "q['top_movers'] = broken; e.queries = lambda: q\n"
        "bench.HEADLINE = ('status_changes', 'top_movers', 'deal_summary'); bench.main()"
    )
    env = os.environ | {"BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2", "BENCH_MEMORY": "2g"}
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    out = json.loads(done.stdout.strip().splitlines()[-1])
    assert done.returncode == 0 and set(out["queries"]) == {"status_changes", "deal_summary"} == set(out["duckdb"])
    assert out["value"] > 0 and out["sf"] == "0.001" and "no" in out["failed"]["top_movers"]
    assert all(v is not None for v in out["duckdb"].values())
