"""Every registered query of the reference operators against its DuckDB SQL."""

import pytest

from framewise.plans import registry

from .conftest import rows_of


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toArrow().to_pandas()
    want = duck.execute(registry.ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_one_exchange_for_selection(spark, sf_dir):
    """Both selections deal the series by run once for the series' order and never again."""
    for name in ("corrupted_windows", "safe_zone_chunks"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan


def test_scan_reads_only_what_is_asked(spark, sf_dir):
    plan = registry.QUERIES["corrupted_windows"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "event_type" not in plan
