"""The SQL of split runs gives one answer, in whatever order rows of one half of a commit come."""

import os

import duckdb
import pytest

from chronolith.oracles import oracle_sql

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_rows_that_tie_in_order_play_no_part():
    connection = duckdb.connect()
    connection.execute("SET threads = 1")
    for t in ("orders", "lineitem", "part"):
        connection.execute(f"CREATE TABLE {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    runs = oracle_sql()["coupling_split_runs"].split(",\nfp AS")[0] + " SELECT file, sha, count(*) FROM f GROUP BY ALL ORDER BY ALL"
    found = connection.execute(runs).fetchall()
    assert found and found == connection.execute(runs.replace("FROM l1)", "FROM (SELECT * FROM l1 ORDER BY starts, file))")).fetchall()
    assert "FROM l1)" in runs
