import pytest

from tabloom.queries import registry
from tests.compare import compare

QUERIES, ORACLES = registry()

@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    if name in ORACLES:
        assert compare(spark, folder, name, QUERIES[name], ORACLES[name]) is None
    else:
        assert QUERIES[name](spark, folder).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
