"""Every registered query against its DuckDB counterpart, on the smallest tables."""

import math
from collections import Counter

import pytest

from corpusloom.plans import contexts, corpus, extraction, ledger, registry, scalars, search, streams, summary  # noqa: F401


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck, data):
    df = registry.QUERIES[name](spark, data)
    names = sorted(df.columns)
    rows = Counter(repr(tuple(norm(r[c]) for c in names)) for r in df.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert rows == Counter(repr(tuple(norm(r[i]) for i in at)) for r in rel.fetchall())
