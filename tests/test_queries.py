"""Every core query that has SQL gives what the SQL gives; the others run."""

import os

import pytest
from conftest import rows_of

import __spark_entry__ as entry


def _core():
    return sorted(n for n in entry.queries() if not (n[0] == "p" and n[1].isdigit()) or n.startswith("p5"))


@pytest.mark.parametrize("name", _core())
def test_query(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in entry.oracle_sql():
        r = duck.execute(entry.oracle_sql()[name])
        want = rows_of([c[0] for c in r.description], r.fetchall())
        assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_alone():
    import re

    root = os.path.join(os.path.dirname(os.path.abspath(entry.__file__)), "weftline")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"^\s*(from|import) weftline\.llm", open(os.path.join(folder, n)).read(), re.M), n


def test_core_runs_without_the_subpackage():
    import subprocess
    import sys

    code = (
        "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['weftline.llm'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'p5_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q), len(q)"
    )
    root = os.path.dirname(os.path.abspath(entry.__file__))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
