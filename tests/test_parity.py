from __future__ import annotations

import pytest

from fernwalk import queries
from tests.parity import needs_data, same_rows

ORACLES = queries.oracle_sql()


#: Beyond SQL; ``test_learned_words`` holds them against plain versions.
NO_SQL = {"sentence_split_learned", "segment_words"}


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(queries.queries()) - NO_SQL


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    same_rows(spark, queries.queries()[name], ORACLES[name])


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
