import pytest

from tests.oracle import assert_same
from vistaloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, catalogue.QUERIES[name], catalogue.ORACLE[name])


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)


def test_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["face_id", "match_idx", "similarity"]
