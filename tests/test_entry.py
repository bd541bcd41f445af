"""Every registered query that has SQL gives DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.errors import PythonException

from gravelsift.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return None
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return round(float(v), 9) if isinstance(v, float) else v


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    sets = [sorted((tuple(map(plain, r)) for r in x[sorted(x.columns)].itertuples(index=False)), key=repr) for x in (got, want)]
    assert sets[0] == sets[1]


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no tables")
@pytest.mark.parametrize("name", ["analyze_service", "jamo_match", "substring_match"])
def test_query_where_workers_lack_a_library(spark, name, tmp_path, monkeypatch):
    """The rows are the same where the automaton's library isn't installed; a broken one is an error."""
    want = sorted(map(tuple, QUERIES[name](spark, DATA).collect()), key=repr)
    files = {"missing": ("sitecustomize", "import sys\nsys.modules['ahocorasick'] = None"), "broken": ("ahocorasick", "raise ImportError('undefined symbol')")}
    for folder, (module, code) in files.items():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / f"{module}.py").write_text(code)
    monkeypatch.setitem(spark.sparkContext.environment, "PYTHONPATH", str(tmp_path / "missing"))
    assert sorted(map(tuple, QUERIES[name](spark, DATA).collect()), key=repr) == want != []
    monkeypatch.setitem(spark.sparkContext.environment, "PYTHONPATH", str(tmp_path / "broken"))
    with pytest.raises(PythonException, match="undefined symbol"):
        QUERIES[name](spark, DATA).collect()


def test_queries_without_sql(spark):
    """Tested against held-out rows elsewhere; here over the smallest tables, alike at each run."""
    assert set(QUERIES) - set(SQL) == {"trained_gate"}
    first, again = (sorted(map(tuple, QUERIES["trained_gate"](spark, DATA).collect())) for _ in range(2))
    assert first == again and all(score >= 0.3 for *_, score in first)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
