import pytest
from pyspark.sql import functions as F

from tidewell.engine import Engine, Input, Query
from tidewell.errors import ActionLockTimeoutError, ActionManifestError
from tidewell.operators.reconcile import Action, Output, desired, path_conflicts
from tidewell.streaming.watch import Poller, changes_to, debounced_stream, stream_into, tumbling


def test_stream_upserts_and_tells(spark, tmp_path):
    e = Engine(spark)
    src = e.declare(Input("src", ["id"]))
    e.declare(Query("sums", ["k"], ["src"], lambda t: t["src"].groupBy("k").agg(F.sum("v").alias("s")), {"src": lambda r, t: r}))
    put = lambda rows: spark.createDataFrame(rows, "id long, k string, v long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: stream_into(spark, f"{tmp_path}/in", "id long, k string, v long", e, src, ["id"], f"{tmp_path}/ck").awaitTermination(120)
    put([(1, "a", 1), (2, "b", 2)])
    run()
    told = []
    stop = changes_to(e, "sums", lambda changes, revision: told.append(sorted(r.k for r in changes.collect())))
    assert {tuple(r) for r in e.get("sums").collect()} == {("a", 1), ("b", 2)}
    put([(2, "b", 5), (3, "b", 1), (3, "b", 0)])
    run()
    assert {tuple(r) for r in e.get("sums").collect()} == {("a", 1), ("b", 6)}
    assert told == [["a", "b"], ["b"]]
    stop()
    revision = e.revision
    e.upsert(src, spark.createDataFrame([(3, "b", 1)], "id long, k string, v long"))  # a batch that comes again
    assert e.revision == revision


def test_windows(spark):
    rows = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", "x") for m in (1, 9, 11, 31)], "t string, k string").select(F.to_timestamp("t").alias("at"), "k")
    assert sorted(r.n for r in tumbling(rows, "at", "10 minutes", ["k"]).collect()) == [1, 1, 2]
    assert sum(r.n for r in tumbling(rows, "at", "10 minutes", ["k"], slide="5 minutes").collect()) == 8
    assert sorted(r.n for r in debounced_stream(rows, "k", "at", "5 minutes", "1 hour").collect()) == [1, 1, 2]


def test_poller_waits_and_asks_again(spark):
    state, got = {"a": 1}, []
    fail = [True]

    def consume(changes):
        if fail.pop() if fail else False:
            raise OSError
        got.append(changes)

    p = Poller(lambda: spark.createDataFrame([(k, v) for k, v in state.items()], "key string, probe long"), consume)
    assert not p.poll()
    state["a"] = 2
    assert not p.poll()
    state["b"] = 1
    assert not p.poll()  # still moving
    with pytest.raises(OSError):
        p.poll()
    assert p.poll() and got == [{"a", "b"}]


def test_action_ledger(spark, tmp_path):
    root = tmp_path / "out"
    a = Action(spark, "tool", str(root), timeout=0.2)
    assert a.reconcile(desired(spark, [Output.text("x/y", "1"), Output("z", b"2")])) == {"created": ["x/y", "z"]}
    manifest = root / ".tool-ledger" / "manifest.json"
    before = manifest.read_bytes()
    a.reconcile(desired(spark, [Output.text("x/y", "1"), Output("z", b"2")]))
    assert manifest.read_bytes() == before
    (root / "z.tmp").write_text("mine")  # not ours, and not in the way
    assert a.reconcile(desired(spark, [Output("z", b"3")])) == {"updated": ["z"], "deleted": ["x/y"]}
    assert (root / "z.tmp").read_text() == "mine" and not (root / "x").exists()
    (root / ".tool-ledger" / "lock").write_text("")
    with pytest.raises(ActionLockTimeoutError):
        a.reconcile(desired(spark, [Output("z", b"3")]))
    (root / ".tool-ledger" / "lock").unlink()
    manifest.write_text("{")
    with pytest.raises(ActionManifestError):
        a.reconcile(desired(spark, [Output("z", b"3")]))


def test_paths_that_other_systems_take_for_one(spark):
    got = {(r.path, r.conflict) for r in path_conflicts(spark.createDataFrame([("é",), ("é",), ("Straße",), ("a/b",), ("a",), ("c-d",), ("cd",)], "path string")).collect()}
    assert got == {("é", "collision"), ("é", "collision"), ("a", "folder")}
