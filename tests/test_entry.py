import duckdb
import pytest

import __spark_entry__ as entry
from lodestone import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_matches_sql(spark, name):
    df = plans.queries()[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = c.sql(sql)
    assert sorted(r.columns) == sorted(df.columns)
    flat = lambda rs: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in row]) for row in rs)
    assert flat(rows) == flat(r.select(*[f'"{x}"' for x in sorted(r.columns)]).fetchall())


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"doc_id", "item_id", "char_start", "char_end"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
