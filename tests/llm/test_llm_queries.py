"""The registered text queries on the smallest tables."""

from __future__ import annotations

import os

import pytest

from tarnwork.llm import MODULES
from tarnwork.queries import collect

DATA = "/root/testdata/sf0.001"
QUERIES, _ = collect("tarnwork.llm", MODULES)
COLUMNS = {"p8_found": {"doc_id", "item_id"}, "p10_found": {"doc_id", "sent_end"}, "p9_mix": {"doc_id", "source", "n_tokens", "repeats"}}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert set(df.columns) == COLUMNS.get(name, set(df.columns))
    rows = df.collect()
    assert rows and len(set(rows)) == len(rows)
