"""Every query against its SQL on the smallest tables."""

import math
import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from paneloom.plans import registry

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(map(norm, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert not any("nan" in r for r in got), "NaN is no result: nulls are"
    if name not in registry.ORACLE:
        assert columns
        return
    rel = duck.sql(registry.ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_workers_get_the_package_from_any_folder(tmp_path):
    """A driver that found the package by its own path only: workers can't rely on its folder or PYTHONPATH."""
    code = (
        f"import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})\n"
        "import __spark_entry__ as e\nfrom paneloom.session import local_session\n"
        f"print('ROWS', e.queries()['p4_found'](local_session(2, 2, '2g'), {DATA!r}).count())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
