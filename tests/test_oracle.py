import pytest

from pairlens.plans.queries import ORACLE
from tests.conftest import SF_SMALL
from tools.check_oracle import compare, duck

QUERIES = sorted(ORACLE)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_oracle(spark, con, name):
    msg = compare(spark, con, name, SF_SMALL)
    assert msg.endswith(" OK"), msg


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 2 * 24  # 24 cells per explained split
    assert set(e.oracle_sql()) <= set(e.queries())
