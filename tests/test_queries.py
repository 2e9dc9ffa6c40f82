"""Every registered query that has SQL, against DuckDB on the small tables; and the package without the corpus part."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from tests.conftest import SF
from tidewell import plans

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return v if v is None else str(v)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, con, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    result = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert got == want


def test_without_corpus_part(tmp_path):
    """The rest imports and lists its queries when the corpus subpackage and pipeline are gone."""
    for name in ("tidewell", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", os.path.join(ROOT, name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tidewell/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
