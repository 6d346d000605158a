"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from fieldlens.plans import registry

SQL = registry.oracle_sql()


def plain(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    clean = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) + 0.0 if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(clean(v.item() if hasattr(v, "item") else v) for v in row) for row in df[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in data.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, data, name):
    mine = registry.queries()[name](spark, str(data)).toPandas()
    other = duck.execute(SQL[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert plain(mine) == plain(other)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, data, name):
    assert registry.queries()[name](spark, str(data)).count() > 0


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
