"""The registered queries of the engine against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from strataflow import queries_api

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations", "documents", "pages")
#: Those that the other tests don't reach, and one of each kind; the driver runs all of them.
CHOSEN = (
    "flagship", "key_semi_join", "refusals", "mixed_units", "default_order", "limit_without_order", "paths_named_by_joins", "paths_steps_by_joins", "closure_lineitem", "walk_citations", "host_edge_paths",
    "host_volatile", "lookup_batches", "lookup_join", "lookup_page", "lookup_walk", "timed_federation", "version_sets", "cites_at", "witnesses", "cypher_shortest_path", "cypher_key_value", "cypher_refusals", "analyses", "agent_server", "plain_language",
)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_agrees_with_its_sql(spark, tables, name):
    df = queries_api.QUERIES[name](spark, FOLDER)
    found = tables.execute(queries_api.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(map(repr, r))
    want = sorted([tuple(map(plain, r)) for r in found.fetchall()], key=key)
    assert sorted([tuple(map(plain, r)) for r in df.select(*names).collect()], key=key) == want


def test_lines_without_a_key_are_told_as_often_as_there_are(spark, tmp_path):
    os.makedirs(f"{tmp_path}/tables")
    con = duckdb.connect()
    for t in TABLES:
        source = f"{FOLDER}/{t}.parquet"
        if not os.path.exists(source):
            pytest.skip("no test tables")
        again = f" UNION ALL SELECT * REPLACE (l_tax + 1 AS l_tax) FROM '{source}' UNION ALL SELECT * FROM '{source}'" if t == "lineitem" else ""
        con.execute(f"COPY (SELECT * FROM '{source}'{again}) TO '{tmp_path}/tables/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/tables/{t}.parquet'")
    got = queries_api.QUERIES["key_semi_join"](spark, f"{tmp_path}/tables").select("o", "l").collect()
    want = con.execute(queries_api.ORACLES["key_semi_join"]).fetchall()
    assert len(want) == 3 * len(set(want)) and sorted(map(tuple, got)) == sorted(want)


def test_every_query_has_its_sql():
    assert set(queries_api.QUERIES) == set(queries_api.ORACLES)
