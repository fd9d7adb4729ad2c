"""Every base query gives the rows of its SQL."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from vocalith.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if not n.startswith("stream_")])
def test_query(spark, database, name):
    rows = queries.QUERIES[name](spark, SF)
    order = sorted(rows.columns)
    mine = sorted(map(str, (tuple(r[c] for c in order) for r in rows.collect())))
    if name in queries.SQL:
        found = database.execute(queries.SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == order
        assert mine == sorted(map(str, (tuple(dict(zip(names, r, strict=True))[c] for c in order) for r in found.fetchall())))
    else:
        assert mine


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_a_missing_package_leaves_the_base():
    """Whatever package the optional operators lack, the entry and the base queries work."""
    root = str(Path(entry.__file__).parent)
    code = "import sys; sys.modules['xxhash'] = sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= len(queries.QUERIES) and out[1] == "False"
