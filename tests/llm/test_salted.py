"""Operators give the same rows where tables of keys are too large to be broadcast."""

import pytest

from weblens.llm import common
from weblens.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["p2_found", "p2_cleaned", "p3_found", "p4_found", "p8_found", "p8_restored"])
def test_same_rows(spark, monkeypatch, name):
    rows = lambda: sorted(map(str, QUERIES[name](spark, DATA).collect()))
    few = rows()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    plain = QUERIES[name](spark, DATA)
    assert sorted(map(str, plain.collect())) == few and few
