import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries)
    assert {"p1_found", "p2_found", "p4_found", "p6_found"} <= set(queries)


def test_the_rest_does_not_need_the_llm_subpackage():
    code = "import sys; sys.modules['tracewright.llm'] = None; import __spark_entry__ as e; names = e.queries(); print('p7_ids' in names, 'p1_found' in names)"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["False", "True"]


@pytest.mark.skipif(not os.path.isdir(entry.SMALL), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
