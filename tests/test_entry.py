import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from graphmill.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
#: One query of each kind; the driver compares all of them on larger tables.
SOME = ["compacted", "search_after_changes", "exported", "haystacks", "language_outcomes", "p1_found", "p1_periods", "scan_knowledge", "and_or_not", "content_pairs", "triple_full", "khop_3", "vector_both", "search_or_not", "search_in_query", "similar_in_query", "retrieval_metrics", "latency_percentile", "token_f1", "embedding_texts"]


def plain(v):
    if isinstance(v, float):
        return round(v, 5) if v == v else "NaN"
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = db.execute(ORACLES[name])
    order = [[c[0] for c in found.description].index(n) for n in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in order)) for r in found.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["name", "content", "created_at"]
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_core_stands_alone():
    """Nothing outside the package for training data imports it."""
    code = "import sys; sys.modules['graphmill.llm'] = None\nimport __spark_entry__ as e\nassert e.llm is None and 'p1_found' in e.queries() and 'p2_found' not in e.queries()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
