import random

import pytest
from pyspark.sql import functions as F

from tidewell.engine import Engine, Input, Query
from tidewell.errors import CheckpointIntegrityError, CycleError, InputKeyError, UntrackedReadError


def rows(spark, data):
    return spark.createDataFrame(data, "id long, k string, v long")


def build(spark, **options):
    e = Engine(spark, **options)
    src = e.declare(Input("src", ["id"]))
    e.declare(Query("sums", ["k"], ["src"], lambda t: t["src"].groupBy("k").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")), {"src": lambda r, t: r}))
    e.declare(Query("sizes", ["n"], ["sums"], lambda t: t["sums"].groupBy("n").agg(F.count(F.lit(1)).alias("groups")), {"sums": lambda r, t: r}))
    return e, src


def answer(df):
    return sorted(map(tuple, df.collect()))


def test_edits_equal_fresh_evaluation(spark):
    rng = random.Random(1)
    e, src = build(spark)
    data = [(i, rng.choice("abc"), i) for i in range(20)]
    for _ in range(3):
        e.set(src, rows(spark, data))
        fresh, other = build(spark)
        fresh.set(other, rows(spark, data))
        for q in ("sizes", "sums"):
            assert answer(e.get(q)) == answer(fresh.get(q))
        data = [(i, rng.choice("abcd") if rng.random() < 0.2 else k, v) for i, k, v in data if rng.random() > 0.1] + [(100 + rng.randrange(1000), "d", 1)]


def test_backdating_reuse_observers_and_graph(spark):
    e, src = build(spark)
    e.set(src, rows(spark, [(1, "a", 1), (2, "b", 2)]))
    seen = []
    stop = e.observe("sizes", lambda name, changes: seen.append(changes.count()))
    e.get("sizes")
    e.reset_statistics()
    e.set(src, rows(spark, [(1, "a", 5), (2, "b", 2)]))
    e.get("sizes")
    s = e.statistics()
    assert (s["query_executions"], s["query_backdates"]) == (1, 1)
    assert seen == [1]
    stop()
    assert not e.set(src, rows(spark, [(2, "b", 2), (1, "a", 5)]))
    assert e.statistics()["input_equal_ignores"] == 1
    assert ("sizes", ["sums"]) in e.dependency_graph()
    assert "query sums" in e.explain("sizes")
    assert e.query_profile()["sums"]["count"] == 2


def test_gone_keys(spark):
    e, src = build(spark)
    e.set(src, rows(spark, [(1, "a", 1), (2, "b", 2)]))
    e.get("sums")
    e.set(src, rows(spark, [(1, "a", 1)]))
    assert answer(e.get("sums")) == [("a", 1, 1)]
    assert e.statistics()["query_gone"] == 1


def test_checkpoint_round_trip(spark, tmp_path):
    e, src = build(spark)
    e.set(src, rows(spark, [(1, "a", 1)]))
    e.get("sizes")
    name = e.save_checkpoint(str(tmp_path))
    other, _ = build(spark)
    other.load_checkpoint(str(tmp_path), name)
    assert answer(other.get("sizes")) == [(1, 1)]
    assert other.statistics()["query_executions"] == 0
    bad = "ck" + "0" * 64
    (tmp_path / name).rename(tmp_path / bad)
    with pytest.raises(CheckpointIntegrityError):
        other.load_checkpoint(str(tmp_path), bad)


def test_eviction_and_errors(spark):
    e, src = build(spark, max_query_nodes=1)
    e.set(src, rows(spark, [(1, "a", 1)]))
    e.get("sizes")
    assert e.statistics()["evictions"] == 1
    with pytest.raises(InputKeyError):
        e.declare(Input("src", ["id"]))
    with pytest.raises(KeyError):
        e.get("nothing")
    e.declare(Query("x", ["k"], ["y"], lambda t: t["y"]))
    e.declare(Query("y", ["k"], ["x"], lambda t: t["x"]))
    with pytest.raises(CycleError):
        e.get("x")
    e.declare(Query("random", ["id"], ["src"], lambda t: t["src"].withColumn("r", F.rand())))
    with pytest.raises(UntrackedReadError):
        e.get("random")
    with pytest.raises(UntrackedReadError):
        e.declare(Query("reflective", ["id"], ["src"], lambda t: eval("t")))


def test_null_keys_and_repeated_rows(spark):
    """Every edit equals a fresh evaluation, with null keys of rows and of answers and rows that occur twice."""
    rng = random.Random(2)
    e, src = build(spark)
    data = [(None, None, 5), (1, "a", 5), (1, "a", 5), (2, None, 1), (3, "b", 2)]
    for turn in range(5):
        e.set(src, rows(spark, data))
        fresh, other = build(spark)
        fresh.set(other, rows(spark, data))
        for q in ("sizes", "sums"):
            assert sorted(map(repr, e.get(q).collect())) == sorted(map(repr, fresh.get(q).collect())), turn
        if turn == 0:
            data = [(None, None, 9), *data[1:]]
        elif turn == 1:
            data = [*data, data[1]]  # only how often a row occurs changes
        elif turn == 2:
            data = [r for r in data if r[1] is not None]
        else:
            data = [(i, k, v + rng.randrange(2)) for i, k, v in data] + [(None, "c", 1), (None, "c", 1)]
    assert not e.set(src, rows(spark, list(reversed(data[: len(data)])))) or turn


def test_captured_values_are_part_of_the_query(spark):
    def with_factor(factor):
        e = Engine(spark)
        src = e.declare(Input("src", ["id"]))
        e.declare(Query("scaled", ["id"], ["src"], lambda t: t["src"].select("id", (F.col("v") * factor[0]).alias("s"))))
        return e, src

    factor = [1]
    e, src = with_factor(factor)
    e.set(src, rows(spark, [(1, "a", 7)]))
    assert answer(e.get("scaled")) == [(1, 7)]
    factor[0] = 100
    assert answer(e.get("scaled")) == [(1, 700)]
    held = rows(spark, [(1, "a", 7)])
    with pytest.raises(UntrackedReadError):
        e.declare(Query("hidden", ["id"], [], lambda t: held))
    from tidewell.plans.lint import captures

    assert {(c.name, c.kind, c.accepted) for c in captures(lambda t: (held, factor, F))} >= {("held", "DataFrame", False), ("factor", "list", True), ("F", "module", True)}


def test_policies(spark):
    e = Engine(spark)
    near = e.declare(Input("near", ["id"], eq=lambda o, n: F.abs(o("v") - n("v")) < 10))
    some = e.declare(Input("some", ["id"], compare=["k"]))
    e.declare(Query("tens", ["id"], ["near"], lambda t: t["near"].select("id", "v", F.floor(F.col("v") / 10).alias("ten")), {"near": lambda r, t: r}, cutoff=["ten"]))
    e.declare(Query("top", ["ten"], ["tens"], lambda t: t["tens"].groupBy("ten").agg(F.count(F.lit(1)).alias("n")), {"tens": lambda r, t: r}))
    e.set(near, rows(spark, [(1, "a", 10), (2, "a", 50)]))
    e.get("top")
    assert not e.set(near, rows(spark, [(1, "a", 15), (2, "a", 50)]))  # equal by the policy, yet stored
    assert answer(e.read_input(near).select("id", "v")) == [(1, 15), (2, 50)]
    assert e.set(near, rows(spark, [(1, "a", 15), (2, "a", 90)]))
    e.reset_statistics()
    assert answer(e.get("top")) == [(1, 1), (9, 1)]
    assert e.statistics()["query_gone"] == 1
    assert e.set(some, rows(spark, [(1, "a", 1)])) and not e.set(some, rows(spark, [(1, "a", 2)])) and e.set(some, rows(spark, [(1, "b", 2)]))
    with pytest.raises(ValueError):
        Input("both", ["id"], compare=["k"], eq=lambda o, n: F.lit(True))


def test_observers_are_isolated(spark):
    e, src = build(spark)
    e.set(src, rows(spark, [(1, "a", 1)]))
    seen = []

    def bad(name, changes):
        raise ValueError("mine")

    e.observe("sums", bad)
    e.observe("sums", lambda name, changes: seen.append(answer(changes)))
    assert answer(e.get("sums")) == [("a", 1, 1)]
    assert seen == [[("a", "executed")]] and [str(x) for _, x in e.errors] == ["mine"]
    assert (e.statistics()["observer_events"], e.statistics()["observer_errors"]) == (2, 1)


def test_untracked_queries_run_in_every_request(spark):
    e, src = build(spark)
    world = {"n": 1}
    e.set(src, rows(spark, [(1, "a", 1)]))

    def outside(t):
        e.report_untracked_read("the world")
        return t["src"].withColumn("n", F.lit(len(e.counters)))

    e.queries["outside"] = Query("outside", ["id"], ["src"], outside)
    import tidewell.engine as module

    code, module.fingerprint = module.fingerprint, lambda *a: "same"
    try:
        e.get("outside")
        e.get("outside")
        e.reset_statistics()
        e.counters["more"] = 0  # the world moves
        e.get("outside")
        assert e.statistics()["query_executions"] == 1 and e.inspect("outside")["untracked"] == "the world"
        e.get("outside")
        assert e.statistics()["query_backdates"] == 1
    finally:
        module.fingerprint = code
    with pytest.raises(RuntimeError):
        e.report_untracked_read("not in a query")
    assert world


def test_requests(spark):
    e, src = build(spark)
    e.set(src, rows(spark, [(1, "a", 1), (2, "b", 1)]))
    with e.request_span():
        assert e.once_per_request("sums", lambda df: df.count()) == 2
        before = e.statistics()["query_reuses"]
        e.get("sums")
        e.get("sizes")
        assert e.statistics()["query_reuses"] == before and len(e._cache) == 1
    assert e.maybe_changed_after("sums", 0) and not e.maybe_changed_after("sums", e.revision)
    e.get("sums")
    assert e.statistics()["query_reuses"] == before + 2 * 3


def test_steps_upserts_and_vacuum(spark):
    e, src = build(spark)
    data = {i: (i, "abc"[i % 3], i) for i in range(30)}
    e.set(src, rows(spark, list(data.values())))
    e.get("sizes")
    for turn in range(10):
        data[turn] = (turn, "z", turn)
        data.pop(20 + turn, None)
        e.upsert(src, rows(spark, [data[turn]]), rows(spark, [(20 + turn, "", 0)]))
        e.get("sizes")
    fresh, other = build(spark)
    fresh.set(other, rows(spark, list(data.values())))
    assert answer(e.get("sums")) == answer(fresh.get("sums")) and answer(e.get("sizes")) == answer(fresh.get("sizes"))
    assert not e.upsert(src, rows(spark, [data[3]]))
    assert e.vacuum() > 10
    assert answer(e.get("sums")) == answer(fresh.get("sums")) and e.read_input(src).count() == len(data)


def test_checkpoint_meets_live_inputs(spark, tmp_path):
    e, src = build(spark)
    e.set(src, rows(spark, [(i, "ab"[i % 2], i) for i in range(20)]))
    e.get("sizes")
    name = e.save_checkpoint(str(tmp_path))
    other, live = build(spark)
    other.set(live, rows(spark, [(i, "ab"[i % 2], i + (i == 3)) for i in range(20)]))
    other.load_checkpoint(str(tmp_path), name)
    other.reset_statistics()
    assert answer(other.get("sums")) == [("a", 90, 10), ("b", 101, 10)]
    assert (other.statistics()["query_executions"], other.statistics()["query_reuses"]) == (1, 1)


def test_manifests_are_validated():
    from tidewell.engine import FORMAT, _validate
    from tidewell.errors import CheckpointManifestError, CheckpointModeError, CheckpointVersionError

    node = {"kind": "input", "version": 1, "seen": {}, "code": "", "count": 0, "digest": "0" * 64}
    good = {"format": FORMAT, "mode": "strict", "revision": 1, "nodes": {"a": node, "q": node | {"kind": "query", "seen": {"a": 1}}}}
    _validate(good, "strict")
    for bad, error in [({"format": 0}, CheckpointVersionError), ({"mode": "fast"}, CheckpointModeError), ({"revision": -1}, CheckpointManifestError), ({"nodes": {"a": node | {"digest": "x"}}}, CheckpointManifestError), ({"nodes": {"q": node | {"seen": {"a": 2}}}}, CheckpointManifestError), ({"nodes": {"a": {}}}, CheckpointManifestError), ({"more": 1}, CheckpointManifestError)]:
        with pytest.raises(error):
            _validate(good | bad, "strict")


def test_unchanged_files_need_no_job(spark, tmp_path):
    rows(spark, [(1, "a", 1)]).write.parquet(f"{tmp_path}/t")
    e, src = build(spark)
    read = lambda: spark.read.parquet(f"{tmp_path}/t").where("v > 0")
    e.set(src, read())
    tables = len(e.nodes["src"].steps)
    seen = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert not e.set(src, read())
    assert len(e.nodes["src"].steps) == tables and len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(seen) <= 1  # reading the schema
    rows(spark, [(1, "a", 2)]).write.mode("overwrite").parquet(f"{tmp_path}/t")
    assert e.set(src, read())
