"""The driver's contract, and the graph queries against DuckDB at the smallest scale."""

import math

import pandas as pd
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    value = lambda v: "null" if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    columns = sorted(frame.columns)
    return columns, sorted(tuple(value(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not DATA.exists(), reason="needs the sample tables")
def test_graph_queries_equal_duckdb(spark):
    import duckdb

    from pellucid.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert QUERIES.keys() == SQL.keys()
    for name, run in QUERIES.items():
        assert rows(run(spark, str(DATA)).toPandas()) == rows(con.sql(SQL[name]).df()), name


def test_run_comparison_compares_orders_of_all_ids(spark, tmp_path):
    from pellucid.queries import QUERIES, SQL

    day = lambda i: f"{1995 + i % 7}-06-01"
    spark.createDataFrame([(i, i % 11, day(i)) for i in range(0, 1_000_000, 997)], "o_orderkey long, o_custkey long, d string").selectExpr("o_orderkey", "o_custkey", "CAST(d AS timestamp_ntz) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["run_comparison"](spark, str(tmp_path)).toPandas()
    both = found[~found.change.isin(["added", "removed"])]
    years = [i % 7 for i in range(0, 1_000_000, 997)]
    assert len(found) == len(years) and len(both) == sum(0 < y < 6 for y in years)
    assert both.id.astype(int).max() > 990_000 and {"regression", "improvement", "same"} == set(both.change)

    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert rows(found) == rows(con.sql(SQL["run_comparison"]).df())


def test_pii_queries_look_at_whole_tables(spark, tmp_path):
    from pellucid.queries import QUERIES, SQL

    n = 12_000
    spark.range(n).selectExpr("id AS c_custkey", "concat('n', id) AS c_name").write.parquet(f"{tmp_path}/customer.parquet")

    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    for name in ("pii_value_match", "pii_value_findings", "pii_name_match", "pii_name_findings"):
        found = QUERIES[name](spark, str(tmp_path)).toPandas()
        assert rows(found) == rows(con.sql(SQL[name]).df()), name
    assert found.observed.min() >= n / 3 and len(found) == 3
    assert (QUERIES["pii_value_findings"](spark, str(tmp_path)).toPandas().observed > 100).sum() == 5


def test_entry_imports_without_the_llm_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['pellucid.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'completeness' in q and not any(k.startswith('op') for k in q); assert 'pipeline' not in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], timeout=120).returncode == 0
