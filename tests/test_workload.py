import pytest

import tidemark.workload as w
from oracle import compare

QUERIES, SQL = w.queries(), w.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        assert compare(df, sf, SQL[name], w.TABLES) > 0
    else:
        assert df.count() > 0
