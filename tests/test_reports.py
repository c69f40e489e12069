"""Reports of agents over events that arrive in any order."""

import duckdb
import numpy as np
import pandas as pd

from tessera.plans import policies


def test_means_are_of_sums_in_order_of_ticks(spark, tmp_path):
    n, users = 4000, 40
    ids = np.random.default_rng(5).permutation(n)
    events = pd.DataFrame({"event_id": ids, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(ids * 7919 % n, unit="s"), "user_id": ids % users, "event_type": "view", "value": 1.0})
    spark.createDataFrame(events).repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    events = events.sort_values(["user_id", "ts", "event_id"])
    con = duckdb.connect(config={"threads": 1})  # the SQL's own sums depend on its threads and on the order of rows
    con.register("events", events)
    cells = con.execute(policies.ORACLES["perception"]).fetchall()
    assert sorted(map(tuple, policies.perception(spark, str(tmp_path)).select("batch_id", "stress", "growth", "repair", "coordination", "label", "code").collect())) == sorted(cells)
    events["coverage"] = events["event_id"] * 29 % 11 / 10.0
    events["utility"] = events["event_id"] * 37 % 101 / 100.0
    want = {u: tuple(np.add.accumulate(g[c].to_numpy())[-1] / len(g) for c in ("utility", "coverage")) for u, g in events.groupby("user_id")}
    got = policies.reports(spark, str(tmp_path)).select("batch_id", "routing", "consensus").collect()
    assert {r.batch_id: (r.routing, r.consensus) for r in got} == want


def test_means_are_over_the_values_that_are_there(spark, tmp_path):
    n, users = 1200, 20
    ids = pd.array([None if i % 3 == 0 or i % users == 7 else i for i in range(n)], dtype="Int64")  # user 7 has none
    events = pd.DataFrame({"event_id": ids, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="s"), "user_id": np.arange(n) % users, "event_type": "view", "value": 1.0})
    events.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    want = con.execute(policies.ORACLES["perception"]).fetchall()
    got = policies.perception(spark, str(tmp_path)).select("batch_id", "stress", "growth", "repair", "coordination", "label", "code").collect()
    assert {r[0]: tuple(r) for r in got} == {r[0]: r for r in want}
