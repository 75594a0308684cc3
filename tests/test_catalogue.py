"""Every query of the catalogue runs; those with SQL agree with it."""

import pytest

from marlspike.plans import catalogue, evaluation, networks, stores  # noqa: F401  they add to the catalogue
from tests.oracle import SF, rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_agrees_with_sql(spark, name):
    assert rows_of(catalogue.QUERIES[name](spark, SF)) == sql_rows(catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    catalogue.QUERIES[name](spark, SF).collect()


def test_best_paths_of_large_keys_and_nulls(spark, tmp_path):
    """A key smaller by over a million outweighs a score in the SQL; rows without a price or a key aren't chosen."""
    rows = [
        (1, 7992539, 107988.2), (1, 1129699, 107991.4), (1, 5, 107999.0), (2, 3000001, 10.4), (2, 2000002, 10.6), (2, 1, 15.0), (3, 4, None), (3, 9, 8.5), (4, 2, None), (5, None, 1.0), (5, 6, 2.0),
        (None, 8, 3.5), (None, 5000000, 3.0), (6, 9007199254740993, 1.5), (7, 3, float("nan")), (7, 4000000, 5.0), (8, None, 7.0), (9, -2500000, 4.0), (9, 1, 2.0),
    ]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_totalprice double").coalesce(1).write.parquet(f"file://{tmp_path}/written")
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "orders.parquet")
    got = rows_of(catalogue.QUERIES["best_paths"](spark, str(tmp_path)))
    assert got == sql_rows(catalogue.SQL["best_paths"], str(tmp_path))
    assert len(got[1]) == 10


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
