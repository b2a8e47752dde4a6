"""Whole jobs of the catalogue where a part was left out before."""

from tidewell.operators import graph


def test_paths_and_cycles_beyond_64_edges(spark):
    chain = [(i, i + 1) for i in range(150)]
    got = graph.closure(spark.createDataFrame(chain, "src long, dst long"))
    assert got.count() == 150 * 151 // 2
    ring = spark.createDataFrame([*chain, (150, 0), (150, 200)], "src long, dst long")
    assert {r.node for r in graph.cycle_members(ring).collect()} == set(range(151))


def test_cycles_without_pairs(spark, monkeypatch):
    """Members by rounds and in one task, on graphs with several cycles, loops of one node, tails and null ends."""
    import random

    rng = random.Random(2)
    rows = [(rng.randrange(60), rng.randrange(60)) for _ in range(62)] + [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (104, 103), (104, 105), (106, 106), (None, 100), (100, None), (None, None)]
    after = {}
    for a, b in rows:
        after.setdefault(a, set()).add(b)
    want = set()
    for v in after:
        seen, todo = set(), [v]
        while todo:
            for w in after.get(todo.pop(), ()):
                if w is not None and w not in seen:
                    seen.add(w)
                    todo.append(w)
        if v is not None and v in seen:
            want.add(v)
    edges = spark.createDataFrame(rows, "src long, dst long")

    def no_pairs(*_):
        raise AssertionError("closure")

    monkeypatch.setattr(graph, "closure", no_pairs)
    assert {r.node for r in graph.cycle_members(edges).collect()} == want
    monkeypatch.setattr(graph, "SMALL", 0)
    got = [r.node for r in graph.cycle_members(edges.selectExpr("'n' || src as src", "'n' || dst as dst")).collect()]
    assert sorted(got) == sorted(f"n{v}" for v in want) and len(want) > 6
