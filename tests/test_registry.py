from __future__ import annotations

import subprocess
import sys

from .conftest import ROOT


def test_core_never_imports_the_training_data_subpackage():
    code = "import sys, forgelens.registry; assert not any(m.startswith('forgelens.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_entry_works_without_the_subpackage():
    code = (
        "import importlib.util as u; f = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n == 'forgelens.llm' else f(n, *a)\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'ag1_file_stats' in q and not any(k.startswith('p1_') for k in q) and 'p7_found' in q\n"
        "assert set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
