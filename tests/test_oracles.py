"""Every query with a DuckDB equivalent gives the same rows on the smallest tables."""

import glob
import math
import os
from collections import Counter

import pytest

DATA = os.environ.get("SIFTLODE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _entry():
    import __spark_entry__

    return __spark_entry__


@pytest.mark.parametrize("name", sorted(_entry().oracle_sql()))
def test_equal(spark, duck, name):
    df = _entry().queries()[name](spark, DATA)
    cur = duck.execute(_entry().oracle_sql()[name])
    names, cols = [d[0] for d in cur.description], sorted(df.columns)
    assert sorted(names) == cols
    want = Counter(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    got = Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    assert got == want


def test_import_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__))).stdout) > 50
