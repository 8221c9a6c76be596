"""The driver contract, and that nothing depends on the removable parts."""

import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 180
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_imports_llm():
    for p in (ROOT / "aspectra").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"(from|import)\s+\S*llm", p.read_text()), p


def test_works_without_llm(tmp_path):
    for p in (ROOT / "aspectra").rglob("*.py"):
        to = tmp_path / p.relative_to(ROOT)
        if "llm" not in to.parts[len(tmp_path.parts) :]:
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and 'pipeline' not in q, len(q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_no_python_in_plans(spark):
    """What is native stays native: no Python operator in the plans of batch queries."""
    from aspectra.plans import catalog, parsing, quality, reshaping, scores

    for name, query in catalog.queries().items():
        if query.__module__ in {m.__name__ for m in (scores, parsing, quality, reshaping)}:
            plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert not re.search("Python|Pandas|ArrowEval|CartesianProduct", plan), name


def test_filters_reach_the_scan(spark):
    from aspectra.plans import catalog

    plan = catalog.queries()["scan_parquet_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), IsNotNull(n_chars), EqualTo(lang,de), GreaterThan(n_chars,1000)]" in plan and "text:string" not in plan
