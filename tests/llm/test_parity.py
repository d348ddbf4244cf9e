from __future__ import annotations

import pytest

from fernwalk.llm import queries
from tests.parity import needs_data, same_rows

ORACLES = queries.oracle_sql()


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    same_rows(spark, queries.queries()[name], ORACLES[name])
