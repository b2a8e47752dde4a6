"""Steps whose work grew faster than their input before."""

from tidewell.functions import calc
from tidewell.operators import graph, memo, packages


def test_closure_writes_a_pair_once(spark, monkeypatch):
    written, write = [], graph.table_of

    def table_of(df):
        out = write(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "table_of", table_of)
    rows = [(f"p{i}", f"s{(i + k) % 20}") for i in range(300) for k in range(8)] + [(f"s{i}", f"n{i % 4}") for i in range(20)] + [(f"n{i}", "r") for i in range(4)] + [("r", "r"), (None, "s2"), (None, "s1")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    got = [tuple(r) for r in graph.closure(edges).collect()]
    want = set(rows)
    while more := {(a, d) for a, b in want for c, d in want if b == c and b is not None} - want:
        want |= more
    assert len(got) == len(want) and set(got) == want
    assert sum(written) < 1.2 * len(want)
    # The same where nothing is small enough to be sent.
    monkeypatch.setattr(graph, "SENT", 0)
    again = [tuple(r) for r in graph.closure(edges).collect()]
    assert len(again) == len(want) and set(again) == want


def test_last_definitions_without_a_sort_of_all_lines(spark):
    rows = [("a", 1, "x", "a1"), ("a", 9, "x", "a9"), ("b", 2, "x", "b2"), ("b", None, "x", "b-"), ("a", 5, None, "n5"), ("b", 3, None, "n3"), ("b", None, "y", "y-"), ("root", None, "z", "z-"), ("root", 4, "z", "z4"), ("other", 99, "x", "o"), ("a", 7, "t", "t7"), ("a", 7, "t", "t7")]
    lines = spark.createDataFrame(rows, "path string, number long, name string, v string")
    includes = spark.createDataFrame([("root", 0, "b"), ("root", 1, "a"), ("a", 0, "b")], "path string, number long, target string")
    out = packages.last_wins(lines, packages.include_closure(includes, "root"))
    assert out.columns == lines.columns
    assert sorted((str(r.name), r.v) for r in out.collect()) == [("None", "n5"), ("t", "t7"), ("x", "a9"), ("y", "y-"), ("z", "z4")]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_cycles_are_looked_for_among_open_bindings(spark, monkeypatch):
    asked, members = [], calc.cycle_members

    def cycle_members(edges):
        asked.extend((r.src, r.dst) for r in edges.collect())
        return members(edges)

    monkeypatch.setattr(calc, "cycle_members", cycle_members)
    chain = [("v0", "1")] + [(f"v{i}", f"v{i - 1} + {i} - v0") for i in range(1, 8)]
    rows = [*chain, ("a", "b + 1"), ("b", "a + v7"), ("c", "a + missing"), ("d", "d"), ("e", "v3 + v3 - 2"), (None, "4"), ("empty", None)]
    got = {r.name: (r.value, r.problem) for r in calc.evaluate(spark.createDataFrame(rows, "name string, expression string")).collect()}
    want = {f"v{i}": (1 + i * (i + 1) // 2 - i, None) for i in range(8)}
    assert got == want | {"a": (None, "cycle"), "b": (None, "cycle"), "c": (None, "unresolved"), "d": (None, "cycle"), "e": (2 * want["v3"][0] - 2, None), None: (None, "unresolved"), "empty": (None, "unresolved")}
    assert set(asked) == {("a", "b"), ("b", "a"), ("c", "a"), ("c", "missing"), ("d", "d")}


def test_hashes_are_kept_and_summed_once(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "n"), (4, "d")], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (None, "m"), (4, "d"), (5, "e")], "k long, v string")
    o, n = memo.hashed(old), memo.hashed(new)
    assert o.columns == ["k", "v", *memo.HASHES[:2]]
    moved = memo.moved_keys(o, n, ["k"])
    assert {(r.k, r._moved) for r in moved.collect()} == {(1, True), (2, True), (None, True), (5, True)}
    assert moved._jdf.queryExecution().optimizedPlan().toString().count("bit_xor") == 1
    apart = memo.moved_keys(memo.hashed(old, [], ["k"]), memo.hashed(new, [], ["k"]), ["k"])  # only the key counts
    assert {(r.k, r._moved) for r in apart.collect()} == {(1, True), (2, False), (None, False), (5, True)}
