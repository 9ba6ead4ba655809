import duckdb
import pytest

import __spark_entry__ as entry
from tachado import queries

DIR = "/root/testdata/sf0.001"
TABLES = "documents customer orders lineitem"


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["scan_email_spans", "interval_packing", "interval_sweep", "interval_merge", "substring_prune", "fuzzy_pairs", "clean_pages", "name_functions", "validity_filters", "casefile_clusters"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = queries.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got == sorted(want.fetchall())
