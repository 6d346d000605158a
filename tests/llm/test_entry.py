import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from fieldlens.llm import queries

from ..test_queries import plain

TOP = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small_tables, name):
    mine = queries.queries()[name](spark, small_tables).toPandas()
    c = duckdb.connect()
    for p in Path(small_tables).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    other = c.execute(queries.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert plain(mine) == plain(other)


def test_all_eleven_are_registered():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_nothing_else_imports_the_subpackage():
    for p in (TOP / "fieldlens").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text())


def test_entry_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(TOP / "fieldlens", tmp_path / "fieldlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; n = e.queries(); assert n and e.oracle_sql() and 'pipeline' not in n and not any(x.startswith('op') and x[2].isdigit() for x in n)"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
