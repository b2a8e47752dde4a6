import pytest

from tidewell.errors import ActionPathError
from tidewell.operators.reconcile import Action
from tidewell.queries import SQL, Q
from tidewell.sources.files import text_files

D = "/root/testdata/sf0.001"


def test_action_converges(spark, tmp_path):
    root = str(tmp_path / "out")
    a = Action(spark, "tool", root)
    want = lambda **files: spark.createDataFrame([(k.replace("__", "/"), v.encode()) for k, v in files.items()], "path string, content binary")
    assert a.reconcile(want(x="1", y__z="2")) == {"created": ["x", "y/z"]}
    assert a.reconcile(want(x="1", y__z="2")) == {"unchanged": ["x", "y/z"]}
    (tmp_path / "out" / "x").write_text("tampered")
    assert a.reconcile(want(x="1")) == {"repaired": ["x"], "deleted": ["y/z"]}
    assert (tmp_path / "out" / "x").read_text() == "1" and not (tmp_path / "out" / "y").exists()
    with pytest.raises(ActionPathError):
        a.reconcile(want(a="1", A="2"))


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok")
    (tmp_path / "b.txt").write_bytes(b"\xff")
    got = {r.path: (r.text, r.decode_error) for r in text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("ok", None), "b.txt": ("", "b.txt: utf-8 error")}


@pytest.mark.parametrize("name", sorted(n for n in Q if not n.startswith("incremental")) + ["incremental_join_batch"])
def test_query_equals_sql(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(D + "/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    mine, sql = Q[name](spark, D).toPandas(), con.sql(SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(sql.columns)
    text = lambda x: sorted(map(tuple, x[columns].astype(str).values.tolist()))
    assert text(mine) == text(sql)
