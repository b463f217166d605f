"""Rounds over few nodes must not shuffle their labels, however many partitions a shuffle has."""

import pytest

from stridemill.llm import components as module


@pytest.mark.parametrize("limit, sent", [(None, True), (0, False)])
def test_a_round_over_few_nodes_shuffles_no_labels(spark, monkeypatch, limit, sent):
    plans, stage = [], module.stage

    def seen(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stage(df, label)
    monkeypatch.setattr(module, "stage", seen)
    if limit is not None:
        monkeypatch.setattr(module, "SMALL_ROWS", limit)
    links = [(i, i + 1) for i in range(20)] + [(1000, 1000 + i) for i in range(1, 30)] + [(5000, 4000), (7, 7)]
    got = module.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == [
        *[(i, 0) for i in range(21)], *[(1000 + i, 1000) for i in range(30)], (4000, 4000), (5000, 4000)]
    rounds = [p for p in plans if "Join" in p]
    assert rounds and all(p.count("strategy=broadcast") == (p.count("Join ") if sent else 0) for p in rounds)
