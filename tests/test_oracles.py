"""Every registered query of the package's own operators against its SQL."""

import pytest
from compare import duck_rows, spark_rows

from marlstone.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert spark_rows(df) == duck_rows(duck, ORACLES[name])
    else:
        assert df.count() >= 0
