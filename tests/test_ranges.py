"""Ranks, queues and hulls whose hot groups are cut: against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arterial.functions import geometry
from arterial.operators import demand, queues, ranges


@pytest.fixture
def many_parts(spark):
    """Range partitions as a large table has them."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_ranks_of_one_hot_key(spark, many_parts):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 9 + ["cold", None]), rng.randrange(50), i) for i in range(2000)]
    got = ranges.numbered(spark.createDataFrame(rows, "k string, t int, i int"), ["k"], "t", "i")
    want = {}
    for k in ("hot", "cold", None):
        want |= {r[2]: n for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]), 1)}
    assert {r["i"]: r["rank"] for r in got.collect()} == want
    assert ranges.placed(spark.createDataFrame(rows, "k string, t int, i int"), ["k"], "t", "i").groupBy("_part").count().agg(F.max("count")).first()[0] < 1000


@pytest.mark.parametrize("few", [1, 50])
def test_values_at_ranks_with_a_heavy_tail(spark, monkeypatch, few):
    monkeypatch.setattr(ranges, "FEW", few)
    rng = random.Random(2)
    values = [rng.paretovariate(0.3) for _ in range(600)] + [1e300, 5.0, 5.0, 5.0, -3.0, -1e-300, 0.0, float("inf")] + [7.5] * 200
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").coalesce(2).cache()
    order = sorted(values, reverse=True)
    for rank in (1, 2, 77, 300, len(values) - 1, len(values)):
        assert ranges.value_at(df, "v", rank) == order[rank - 1]
    assert ranges.value_at(df, "v", 0) is None and ranges.value_at(df, "v", len(values) + 1) is None


def test_bit_patterns_order_as_numbers_do():
    numbers = sorted([-1e300, -2.5, -1e-308, 0.0, 5e-324, 1.0, 1.0000000000000002, 3e200, float("inf")])
    assert [ranges._bits(x) for x in numbers] == sorted(ranges._bits(x) for x in numbers) and [ranges._number(ranges._bits(x)) for x in numbers] == numbers


def test_cutoff_without_values(spark):
    assert demand.cutoff_value(spark.createDataFrame([(0.0,), (None,)], "v double"), "v").count() == 0


def plain_queue(rows, headway):
    out, last = {}, {}
    for link, ready, agent in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        last[link] = max(ready, last.get(link, -1e18) + headway[link])
        out[agent] = last[link]
    return out


@pytest.mark.parametrize("window", [queues.WINDOW_ROWS, 10])
def test_queues_in_slices(spark, monkeypatch, many_parts, window):
    monkeypatch.setattr(queues, "WINDOW_ROWS", window)
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.9 else 2, rng.randrange(300) / 2, i) for i in range(1500)]
    headway = {1: 0.13, 2: 2.0}
    df = spark.createDataFrame([(*r, headway[r[0]]) for r in rows], "link int, ready double, agent int, h double")
    got = {r["agent"]: r["depart"] for r in queues.single_link(df, "link", "agent", "ready", "h").collect()}
    want = plain_queue(rows, headway)
    assert got.keys() == want.keys() and all(got[a] == pytest.approx(want[a], abs=1e-9) for a in want)


@pytest.mark.parametrize("window", [queues.WINDOW_ROWS, 10])
def test_queues_under_changing_capacity(spark, monkeypatch, window):
    monkeypatch.setattr(queues, "WINDOW_ROWS", window)
    rng = random.Random(4)
    capacity = {(link, m): rng.choice([0.0, 0.25, 1.0, 2.5]) for link in (1, 2) for m in range(20)} | {(1, 19): 0.5, (2, 19): 1.0}
    rows = [(rng.choice([1, 1, 1, 2]), rng.randrange(100) / 4, i) for i in range(60)] + [(3, 1.0, 99)]
    got = {r["agent"]: r["depart"] for r in queues.varying_link(spark.createDataFrame(rows, "link int, ready double, agent int"), spark.createDataFrame([(*k, c) for k, c in capacity.items()], "link int, minute int, capacity double"), "link", "agent", "ready").collect()}
    assert got.pop(99) is None

    def served(link, t):
        return sum(capacity[link, min(m, 19)] * max(0.0, min(t - m, 1.0)) for m in range(int(t) + 1))

    # each departure is the first time at which a unit has passed since the one before, and since arrival the queue was served
    for link in (1, 2):
        before = None
        order = sorted((r for r in rows if r[0] == link), key=lambda r: (served(link, r[1]), r[2]))
        for _, ready, agent in order:
            u = max(served(link, ready), -1e9 if before is None else before + 1)
            t = got[agent]
            assert served(link, t) == pytest.approx(u, abs=1e-6) and t >= ready - 1e-6 or (served(link, ready) == pytest.approx(u) and t == pytest.approx(ready, abs=20))
            before = u


def test_steps_are_drawn_alone_and_keep_the_mean(spark):
    links = spark.createDataFrame([(1, 1830.0, 1.0), (2, 900.0, 2.0)], "link_id int, lane_capacity double, lanes double")
    some = {(r["link_id"], r["step"]): r["capacity"] for r in queues.stochastic_capacity(links, 50).collect()}
    more = queues.stochastic_capacity(links, 4000)
    assert all(some[r["link_id"], r["step"]] == r["capacity"] for r in more.where("step < 50").collect())
    mean = {r["link_id"]: r["m"] * 3600 for r in more.groupBy("link_id").agg(F.avg("capacity").alias("m")).collect()}
    assert mean[1] == pytest.approx(1830, rel=0.06) and mean[2] == pytest.approx(1800, rel=0.06)


def test_hulls_of_shares_merge(spark, monkeypatch):
    monkeypatch.setattr(geometry, "HELD", 40)
    rng = np.random.default_rng(5)
    points = np.concatenate((rng.normal(size=(3000, 2)), [[9.0, 9.0], [-9.0, 9.0], [9.0, -9.0]])).round(3)
    rows = [(1, float(a), float(b)) for a, b in points] + [(2, float(i), float(i)) for i in range(5)] + [(3, 0.0, 0.0)] * 9 + [(None, 0.0, 0.0), (None, 2.0, 0.0), (None, 2.0, 2.0), (None, 0.0, 2.0), (4, None, 1.0)]
    got = {r["k"]: (r["n_vertices"], r["geometry"]) for r in geometry.hulls(spark.createDataFrame(rows, "k int, x double, y double").repartition(6), "k", "x", "y").collect()}
    corners = geometry.hull(points)
    assert got.keys() == {1, 2, None} and got[1][0] == len(corners) and got[1][1] == "POLYGON ((" + ", ".join(f"{a:.6f} {b:.6f}" for a, b in [*corners, corners[0]]) + "))"
    assert got[None][0] == 4 and got[2][0] == 2


def grid(n, seed, weights):
    rng = random.Random(seed)
    pairs = [(x * n + y, u * n + v) for x in range(n) for y in range(n) for u, v in ((x + 1, y), (x, y + 1), (x - 1, y), (x, y - 1)) if 0 <= u < n and 0 <= v < n]
    rng.shuffle(pairs)
    return [(i, a, b, rng.choice(weights)) for i, (a, b) in enumerate(pairs)]


@pytest.mark.parametrize("side", [4, 100])
def test_cells_give_the_labels_of_a_whole_search(spark, side):
    from arterial.operators import cells, paths

    n = 16
    rows = grid(n, side, [0.5, 1.0, 1.25, 3.0]) + [(9000, 999, 3, 1.0), (9001, 5, 5, 1.0)]
    links = spark.createDataFrame(rows, "link_id int, from_node_id int, to_node_id int, cost double")
    origins = spark.createDataFrame([(0,), (37,), (255,), (999,), (77777,)], "origin int")
    at = spark.createDataFrame([(i, (i // n // side) * 100 + i % n // side) for i in range(n * n)], "node_id int, cell int")
    got = {tuple(r) for r in cells.labels(links, origins, at).collect()}
    network = paths.Network(np.array(rows, dtype=float))
    want = set()
    for o in (0, 37, 255, 999, 77777):
        for node, cost, link, before in zip(*(c.tolist() for c in network.search(o))):
            want.add((o, node, cost, link if link >= 0 else None, before if link >= 0 else None))
    assert got == want


def test_rounds_follow_the_cells(spark, monkeypatch):
    from arterial.operators import cells

    n, rounds = 100, []
    plain = cells.settle
    monkeypatch.setattr(cells, "settle", lambda df: rounds.append(1) or plain(df))
    rows = grid(n, 1, [1.0, 2.0])
    links = spark.createDataFrame(rows, "link_id int, from_node_id int, to_node_id int, cost double")
    at = spark.createDataFrame([(i, (i // n // 20) * 5 + i % n // 20) for i in range(n * n)], "node_id int, cell int")
    got = cells.labels(links, spark.createDataFrame([(0,)], "origin int"), at)
    assert got.count() == n * n and len(rounds) < 60
    best = {r["node"]: r["cost"] for r in got.collect()}
    assert all(best[b] <= best[a] + w for _, a, b, w in rows) and best[0] == 0


def test_costs_of_nothing_make_no_cycle(spark):
    from arterial.operators import cells, paths

    rows = grid(8, 3, [0.0, 0.0, 1.0])
    links = spark.createDataFrame(rows, "link_id int, from_node_id int, to_node_id int, cost double")
    at = spark.createDataFrame([(i, i // 16) for i in range(64)], "node_id int, cell int")
    tree = cells.labels(links, spark.createDataFrame([(0,)], "origin int"), at)
    network = paths.Network(np.array(rows, dtype=float))
    node, cost, _, _ = network.search(0)
    assert {r["node"]: r["cost"] for r in tree.collect()} == dict(zip(node.tolist(), cost.tolist()))


def test_samples_in_order(spark, many_parts):
    rows = spark.createDataFrame([(i, i // 3, i % 2 == 0 if i % 5 else None) for i in range(100)], "id int, t int, gone boolean")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(queues.sampled(rows, ["t", "id"], 10)) == list(range(0, 100, 10))
    assert ids(queues.sampled(rows, ["t", "id"], 10, 3)) == [0, 10, 20]
    gone = [i for i in range(100) if i % 2 == 0 and i % 5]
    assert ids(queues.sampled(rows, ["t", "id"], 4, 5, F.col("gone"))) == gone[::4][:5]
    assert ids(queues.sampled(rows.limit(0), ["t"], 4)) == []
