"""Every query of the linking engine against its SQL."""

import pytest
from comparing import same_rows

from termlink.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    same_rows(registry.QUERIES[name](spark, sf_dir), duck.sql(registry.ORACLES[name]))


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_all_categories_occur(spark):
    report = {r.category: r.n for r in registry.QUERIES["recovery_report"](spark, "/root/testdata/sf0.01").collect()}
    assert set(report) == {"exact", "more_specific", "more_general", "not_recovered"} and report["exact"] and report["not_recovered"]
