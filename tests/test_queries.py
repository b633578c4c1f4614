"""Every query against its SQL on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from loamgraph.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


#: Beyond SQL: chunks, patterns with look-ahead, subsequences, greedy choice. test_rules.py compares them with plain Python.
WITHOUT_SQL = {"chunk_documents", "structured_facts", "evidence_items", "evidence_documents", "evidence_coverage", "diversify_chunks", "fuzzy_candidates", "auto_merge_flags", "resolve_components", "diversified_context", "evidence_packs", "question_grades", "resolve_persons", "vector_index_topk"}


def test_every_other_query_has_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == WITHOUT_SQL and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, name):
    got = QUERIES[name](spark, DATA)
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = want.fetchall()
    assert rows
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=key) == sorted((tuple(map(plain, r)) for r in rows), key=key)
