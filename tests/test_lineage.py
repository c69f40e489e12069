"""Lineages against plain loops."""

import pandas as pd
import pytest

from tessera.operators import graph
from tessera.plans.queries import QUERIES


def test_agent_lineage_is_whole(spark, tmp_path):
    events = pd.read_parquet("/root/testdata/sf0.001/events.parquet").sort_values(["user_id", "ts", "event_id"])
    few = {u: 1 + 4 * k for k, u in enumerate(events["user_id"].unique())}
    events = events[events.groupby("user_id").cumcount() < events["user_id"].map(few)]
    events.sample(frac=1, random_state=1).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    want = set()
    for ids in events.groupby("user_id")["event_id"].apply(list):
        want |= {(ids[-1], slot, step) for step, slot in enumerate(reversed(ids))}
    got = [tuple(r) for r in QUERIES["agent_lineage"](spark, str(tmp_path)).select("start", "slot_id", "step").collect()]
    assert len(got) == len(events) and set(got) == want


def test_walks_of_any_length(spark):
    """A walk of over 1,000 steps, branches, lone slots and a start twice, as a loop does it."""
    parent = {i: i - 1 for i in range(1, 1300)} | {5000: 700, 5001: 5000, 6000: None, 0: None, 7001: 7000}
    starts = [1299, 5001, 6000, 0, 1, 7001, 8000, 5001]
    want = []
    for s in starts:
        at, step = s, 0
        while at is not None:
            want.append((s, at, step))
            at, step = parent.get(at), step + 1
    slots = spark.createDataFrame(list(parent.items()), "slot_id long, parent_id long")
    got = graph.lineage(slots, spark.createDataFrame([(s,) for s in starts], "slot_id long")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_cycle_is_an_error(spark):
    slots = spark.createDataFrame([(0, None), (1, 0), (2, 4), (3, 2), (4, 3)], "slot_id long, parent_id long")
    with pytest.raises(ValueError, match="cycle"):
        graph.lineage(slots, spark.createDataFrame([(2,)], "slot_id long"))
    assert graph.lineage(slots.limit(0), spark.createDataFrame([], "slot_id long")).count() == 0
