"""The queries of the problems against their SQL."""

import pytest

from lodestrand.llm.queries import QUERIES
from lodestrand.llm.sql import SQL
from tests.oracle import same


@pytest.mark.parametrize("name", [n for n in SQL if n != "p1_term_report"])
def test_query_equals_its_sql(spark, data, name):
    same(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", ["p2_found", "p3_structure", "p5_groups", "p7_windows", "p8_alignments", "p9_found"])
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
