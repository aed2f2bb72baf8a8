import json
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(f"{SF}/orders.parquet"), reason="test tables not present")
def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF, BENCH_CPUS="2", BENCH_QUERIES="churn_rate,reason_share",
               BENCH_DRIVER_MEMORY="2g")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=600, check=True).stdout
    lines = [ln for ln in out.splitlines() if ln.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == 0.001 and set(d["queries"]) == {"churn_rate", "reason_share"}
    assert d["value"] == pytest.approx(sum(d["queries"].values()), abs=1e-2)


def test_core_queries_stay_when_a_package_of_the_optional_part_is_missing(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as entry
    from churnlens.plans.catalog import QUERIES

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "corpus_pipeline" or name.startswith("churnlens.llm"):
            raise ImportError("No module named 'sentencepiece'", name="sentencepiece")
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    for m in [m for m in sys.modules if m.startswith("churnlens.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    assert set(entry.queries()) == set(QUERIES) == set(entry.oracle_sql())
