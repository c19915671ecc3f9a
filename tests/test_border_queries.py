"""Queries of windows whose mean is just at the limit."""

import datetime
import random

import duckdb
import pytest

from framewise.plans import registry

from .conftest import rows_of


@pytest.mark.parametrize("name", ["corrupted_windows", "chunk_report", "corrupted_summary", "chunk_summary"])
def test_queries_equal_sql_with_exact_sums(spark, tmp_path, name):
    """Runs whose first twenty values add up to 1000.00, to a cent less or to more: the rows of the SQL, if it adds decimals instead of doubles."""
    rng, rows, start = random.Random(2), [], datetime.datetime(2024, 1, 1)
    for run in range(300):
        cents = [rng.randrange(5000, 9000) for _ in range(10)] + [rng.randrange(1000, 3000) for _ in range(9)]
        cents += [100_000 - sum(cents) - (100 <= run < 200) + 5_000 * (run >= 200)] + [rng.randrange(0, 12_000) for _ in range(15)]
        if 0 <= cents[19] < 50_000:
            rows += [(len(rows) + k, start + datetime.timedelta(seconds=k), run, c / 100) for k, c in enumerate(cents)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    con, exact = duckdb.connect(), registry.ORACLES[name].replace("avg(e.fd) AS m", "CAST(sum(CAST(e.fd AS DECIMAL(9, 2))) AS DOUBLE) / 20 AS m")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert "DECIMAL" in exact
    got = registry.QUERIES[name](spark, str(tmp_path)).toArrow().to_pandas()
    assert rows_of(got) == rows_of(con.execute(exact).fetch_df()[list(got.columns)])
