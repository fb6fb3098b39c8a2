"""The registered queries of the subpackage: against their DuckDB SQL where there is one, else their shape, on the smallest table set."""

import math
from pathlib import Path

import duckdb
import pytest

from gleaner.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "labels"]


@pytest.fixture(scope="module")
def engine():
    if not Path(FOLDER).is_dir():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, engine, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = engine.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_return_every_document(spark, engine, name):
    got = QUERIES[name](spark, FOLDER)
    n = engine.execute("SELECT count(DISTINCT doc_id) FROM documents").fetchone()[0]
    ids = got.select("doc_id").distinct().count()
    assert ids == n if name != "pipeline" else 0 < ids < n
