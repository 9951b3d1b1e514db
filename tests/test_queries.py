import pytest

from compare import oracle, rows
from cytomesh import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got)
        return
    want = oracle(SF, registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
