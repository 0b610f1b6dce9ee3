import pytest

from sieveline.plans import curation, evaluation, reports, retrieval

from .compare import same
from .conftest import SF

CATALOG = retrieval.CATALOG | evaluation.CATALOG | curation.CATALOG | reports.CATALOG


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if sql])
def test_query_equals_its_sql(spark, name):
    run, sql = CATALOG[name]
    same(run(spark, SF), sql, SF)


def test_entry_has_metrics(spark):
    import __spark_entry__

    assert {"query_id", "k", "recall", "ndcg"} <= set(__spark_entry__.entry(spark).columns)
