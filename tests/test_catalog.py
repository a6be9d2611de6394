import pytest

from tests.compare import differences
from tidewater.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    more, less, n = differences(spark, SF, catalog.queries()[name], catalog.oracle_sql()[name])
    assert not more and not less, (list(more.items())[:3], list(less.items())[:3])
    assert n or name in ("order_interval_join", "stream_order_join")
