import pytest
from oracle import compare

from factloom.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    if name in ORACLE_SQL:
        compare(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0
