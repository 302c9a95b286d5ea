"""The registry, whole queries on the smallest tables, and the parts that must not depend on each other."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p1_found", "p5_found", "p7_found", "rank_top5"} <= set(queries)


def test_core_stands_without_the_optional_package():
    code = "import sys, importlib.abc\nclass B(importlib.abc.MetaPathFinder):\n def find_spec(self, n, p, t=None):\n  if n.startswith('stackweave.llm'): raise ModuleNotFoundError(n, name=n)\nsys.meta_path.insert(0, B())\nimport __spark_entry__ as e\nassert 'p1_found' in e.queries() and 'p2_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for path in (ROOT / "stackweave").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


BLOCKED = """
import sys, importlib.abc
class Blocked(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name.startswith(%r):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as e
"""


def test_only_the_optional_package_may_lack_something():
    lacking = BLOCKED % (("ahocorasick", "regex"),) + "assert 'p1_found' in e.queries() and 'p8_ids' not in e.queries()"
    subprocess.run([sys.executable, "-c", lacking], cwd=ROOT, check=True)
    broken = BLOCKED % ("stackweave.queries.reference",) + "e.queries()"
    assert subprocess.run([sys.executable, "-c", broken], cwd=ROOT, capture_output=True).returncode != 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_every_core_query_runs(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    for name, f in entry.queries().items():
        if f.__module__.startswith("stackweave.queries"):
            f(spark, DATA).count()
    assert spark.conf.get("spark.sql.session.timeZone") == before
