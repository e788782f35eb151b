from __future__ import annotations

import pytest
from oracle import check

from clipquarry.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, small, name):
    check(spark, small, QUERIES[name], ORACLE_SQL[name])


def test_all_ten_are_there():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
