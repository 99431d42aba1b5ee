"""Every registered core query against its SQL, or at least to its end."""

import pytest

from evidra.plans.catalogue import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, compare):
    if name in ORACLE:
        compare(QUERIES[name], ORACLE[name])
    else:
        assert QUERIES[name](spark, small).count() > 0


def test_names_agree():
    assert not set(ORACLE) - set(QUERIES)
