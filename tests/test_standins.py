"""The stand-ins are projections: nothing is shuffled or written before an operator starts."""

from pathlib import Path

import pytest

from workload import pricing, standins

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize(
    "build, table",
    [
        (standins.chain_logs, "lineitem"),
        (standins.lineitem_ins, "lineitem"),
        (standins.order_outs, "orders"),
        (pricing.trades, "lineitem"),
    ],
)
def test_rows_come_from_the_given_table(spark, build, table):
    rows = build(spark, SF)
    assert [Path(f).name for f in rows.inputFiles()] == [f"{table}.parquet"]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["links_strict", "next_events_after_arrival"])
def test_hashes_are_shuffled_as_bytes(spark, name):
    import workload

    assert "unhex(" in workload.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["links_by_chain", "trajectory_across", "updates_applied", "usd_updates", "price_asof"])
def test_no_shuffle_carries_a_hash_as_text(spark, name):
    import workload

    plan = workload.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex(sha2(" in plan and "[sha2(" not in plan and " sha2(" not in plan
