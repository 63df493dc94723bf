"""Every registered query against its SQL, at the smallest scale."""

import pytest
from helpers import norm

from busframe.plans import log_queries  # noqa: F401
from busframe.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    out = QUERIES[name](spark, SF)
    rows = out.select(*sorted(out.columns)).collect()
    if name not in SQL:
        assert rows
        return
    other = duck.execute(SQL[name])
    names = [d[0] for d in other.description]
    assert sorted(names) == sorted(out.columns)
    order = [names.index(c) for c in sorted(names)]
    assert norm(rows) == norm([tuple(r[i] for i in order) for r in other.fetchall()])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
