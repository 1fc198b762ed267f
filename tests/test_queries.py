import pytest

from heristat import queries as Q
from tests.conftest import DATA, rows


@pytest.mark.parametrize("name", sorted(Q.FOUND))
def test_query(spark, duck, name):
    run, sql = Q.FOUND[name]
    got = run(spark, DATA).toPandas()
    if sql:
        assert rows(got) == rows(duck.sql(sql).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    got = entry.entry(spark).toPandas()
    assert got.sigma_g[0] == pytest.approx(-0.107787) and got.q0[0] == pytest.approx(3850.2653)
