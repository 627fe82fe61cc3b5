"""The registered queries that SQL can express, against DuckDB, and that every operator has one."""

import re

import duckdb
import numpy as np
import pytest

import __spark_entry__
from palimpsest.llm.queries import ORACLES, QUERIES


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 11))
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.01")
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(r) for r in want.select(columns).fetchall())


def test_neighbours_of_the_table_by_brute_force(spark):
    """op4 as it is registered, on whole embeddings: recall, exact scores, order, and 20 for each query."""
    sf_dir = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    place = {int(v): i for i, v in enumerate(ids)}
    found: dict[int, list] = {}
    for r in sorted(QUERIES["op4_neighbours"](spark, sf_dir).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == {int(v) for v in ids if v % 20 == 0}
    hit = 0
    for q, mine in found.items():
        score = x @ x[place[q]]
        score[place[q]] = -np.inf
        want = ids[np.lexsort((ids, -score))[:20]]
        hit += len(set(want.tolist()) & {v for v, _ in mine})
        assert len({v for v, _ in mine}) == 20 and mine == sorted(mine, key=lambda p: (-p[1], p[0]))
        assert all(abs(score[place[v]] - s) < 1e-12 for v, s in mine)
    assert hit / (20 * len(found)) >= 0.95
