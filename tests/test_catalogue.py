import duckdb
import pytest

from compare import rows_of
from paritylens.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    import os

    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, data, con, name):
    got = QUERIES[name](spark, data).toArrow()
    if name in SQL:
        assert rows_of(got) == rows_of(con.execute(SQL[name]).to_arrow_table())


def test_entry_has_a_row_for_every_user(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 15


def test_scans_read_only_what_they_need(spark, data):
    from paritylens.operators import log

    plan = log.usable(spark.read.parquet(f"{data}/samples.parquet")).select("recording_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNull(error)]" in plan and "output" not in plan.split("ReadSchema")[-1]
