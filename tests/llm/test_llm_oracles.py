import os

import pytest

from lectern.llm import queries as Q
from tests.oracle import connect, same

FOLDER = os.environ.get("LECTERN_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    frame = Q.queries()[name](spark, FOLDER)
    if name in Q.oracle_sql():
        same(frame, connect(FOLDER), Q.oracle_sql()[name])
    else:
        assert frame.count() == frame.distinct().count()
