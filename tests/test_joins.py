"""What grows with the input is never gathered in the driver for a join."""

import pytest

from factloom.dims import attribute_specs
from factloom.operators import copychain, vote
from factloom.plans import cut, registry
from factloom.plans import resolve as R


@pytest.fixture
def planned(monkeypatch):
    """Plans of all tables that the engine writes."""
    plans, write = [], vote.checkpoint

    def checkpoint(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    for module in (vote, copychain, R):
        monkeypatch.setattr(module, "checkpoint", checkpoint)
    return plans


def broadcast(plan):
    """Joins by broadcast, other than with the attributes of a category."""
    return [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "category" not in line]


@pytest.mark.parametrize("name", ["source_refs", "truth_discovery", "candidates", "crh_fixpoint", "gain", "holes_topk"])
def test_voting_joins_by_sorting(spark, sf_dir, planned, name):
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) >= 10 << 20
    out = registry.QUERIES[name](spark, sf_dir)
    planned.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(planned) > 4 and not [x for p in planned for x in broadcast(p)]


def test_resolving_joins_by_sorting(spark, sf_dir, planned):
    out = R.resolve(spark, *registry._part_web(spark, sf_dir), now="2026-01-01T00:00:00Z")
    planned += [out[name]._jdf.queryExecution().executedPlan().toString() for name in ("resolved", "documents", "ledger")]
    assert len(planned) > 30 and not [x for p in planned for x in broadcast(p)]


@pytest.mark.parametrize("name", ["source_refs", "truth_discovery", "crh_fixpoint"])
def test_claims_are_dealt_once(spark, sf_dir, planned, name):
    out = registry.QUERIES[name](spark, sf_dir)
    planned.append(out._jdf.queryExecution().executedPlan().toString())
    # The first table deals the claims by product; what is written after that meets without another shuffle.
    assert len(planned) > 4 and not [p for p in planned[1:] if "Exchange hashpartitioning" in p]


def test_tables_of_the_rounds_go(spark, sf_dir):
    had = len(cut._written.get(spark.sparkContext.applicationId, []))
    out = registry.QUERIES["source_refs"](spark, sf_dir)
    assert len(cut._written[spark.sparkContext.applicationId]) == had + 1  # the result's
    want = out.count()
    assert want > 0 and out.count() == want
