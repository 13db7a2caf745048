"""The queries that SQL can say against their SQL."""

import pytest

from strata.llm import queries
from tests.llm.test_text_scans import Folder
from tests.oracle import connect, plain, same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    same(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_odd_rows(spark, odd, tmp_path, name):
    """Nulls, repeated rows, empty and long texts."""
    items = [(1, "alpha beta"), (2, "Beta gamma delta"), (3, None), (4, "")]
    folder = Folder(tmp_path).put("documents", odd).put("benchmark", spark.createDataFrame(items, "item_id long, text string"))
    df = queries.QUERIES[name](spark, folder.path)
    con = connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{folder.path}/{table}.parquet/*.parquet'")
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    theirs = [tuple(map(plain, r)) for r in found.fetchall()]
    assert sorted(theirs, key=repr) == sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
