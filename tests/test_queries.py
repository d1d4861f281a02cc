import oracle_check
import pytest

from umbra.plans import flow, flow_oracle, oracle, queries, scale, scale_oracle

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = queries.QUERIES | flow.QUERIES | scale.QUERIES, oracle.ORACLE | flow_oracle.ORACLE | scale_oracle.ORACLE


@pytest.fixture(scope="module")
def duck():
    return oracle_check.tables(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_agrees_with_sql(spark, duck, name):
    assert not oracle_check.differ(spark, duck, SF, QUERIES[name], ORACLE[name])
