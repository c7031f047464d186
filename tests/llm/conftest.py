from __future__ import annotations

import pytest

from marketlens.llm.common import prepare


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)
