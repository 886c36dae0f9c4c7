"""What simhash and its components broadcast."""

import pytest

from horizonkit.llm import components, simhash


def family(n):
    """Fingerprints a few bits apart, as rows ``(fp)``."""
    return [((i * 0x9E3779B97F4A7C15) & ((1 << 62) - 1)) ^ (1 << b) for i in range(1, n) for b in (0, 7, 40)]


@pytest.fixture
def plans(monkeypatch):
    """Plans of all tables that the modules write."""
    seen = []

    def kept(df, name, write=simhash.written):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(simhash, "written", kept)
    monkeypatch.setattr(components, "written", kept)
    return seen


def test_variants_and_edges_are_not_broadcast(spark, plans):
    """Spark takes the variants for as small as the fingerprints before the explode, and few bytes may hold many edges."""
    found = simhash.near_pairs(spark.createDataFrame([(f,) for f in family(60)], "fp long"))
    plans.append(("pairs", found._jdf.queryExecution().executedPlan().toString()))
    assert found.count() == 3 * 59
    roots = components.connected_components(found)
    assert roots.where("node <> root").count() == 2 * 59
    joined = [(n, p) for n, p in plans if "Join" in p]
    assert {n for n, _ in joined} >= {"variants", "pairs", "edges"}
    assert not [n for n, p in joined if "BroadcastHashJoin" in p or "ShuffledHashJoin" in p]
