"""Every registered query runs at the smallest scale and, where it has SQL, agrees with it."""

from __future__ import annotations

import re

import pytest

from hearthline.queries import load_registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
REGISTRY = load_registry()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, name, REGISTRY[name])
    assert ok, note


def test_names():
    assert not [n for n in REGISTRY if re.match(r"op\d+_", n)]


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[:2] == ["n", "accuracy"]
