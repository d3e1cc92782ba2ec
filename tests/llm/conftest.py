"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import pytest
from llm_rows import AWKWARD, table


@pytest.fixture(scope="session")
def awkward(spark):
    return table(spark, AWKWARD)


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])
