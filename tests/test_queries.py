"""Every registered query against its SQL, at the smallest scale; those without SQL must run."""

from __future__ import annotations

import pytest
from compare import same

from factorloom.oracles import SQL
from factorloom.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        same(df, SQL[name], sf)
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
