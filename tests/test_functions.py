import math
from dataclasses import dataclass

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.errors import UnsupportedValueError
from tidewell.functions import canon
from tidewell.functions.documents import ANALYZERS
from tidewell.functions.versions import marker_holds, specifier_holds

values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text() | st.binary(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12)


@given(values)
@settings(max_examples=200)
def test_canonical_round_trip(v):
    assert canon.encode(canon.decode(canon.encode(v))) == canon.encode(v)


def test_canonical_equality():
    @dataclass
    class P:
        x: int

    assert canon.canonical_equal(math.nan, math.nan)
    for a, b in ((1, 1.0), (1, True), (0.0, -0.0), ("a", b"a"), ([1], (1,)), ({1}, frozenset({1})), (P(1), {"x": 1})):
        assert not canon.canonical_equal(a, b)
    assert canon.canonical_equal({"a": 1, "b": 2}, {"b": 2, "a": 1})
    with pytest.raises(UnsupportedValueError):
        canon.encode(iter([]))
    with pytest.raises(UnsupportedValueError):
        canon.decode(b"i2:07")


@pytest.mark.parametrize(
    ("specifier", "version", "holds"),
    [(">=1.0,<2", "1.5", True), ("~=1.4.2", "1.4.9", True), ("~=1.4.2", "1.5", False), ("==1.*", "1.9.post1", True), ("!=1.*", "1.9", False), (">1.0", "1.0.post1", False), ("<2", "2.0rc1", False), (">=1.0", "2.0a1", False), (">=1.0a1", "2.0a1", True),
     ("==1.0", "1.0+local", True), ("==1.0+x", "1.0", False), ("===1.0", "1.0", True), ("==1.0", "1.0.0", True), (">=1!1.0", "2.0", False), ("<=1.0", "1.0+local", True)],
)
def test_specifiers(specifier, version, holds):
    assert specifier_holds(specifier, version) is holds


def test_markers():
    env = {"python_version": "3.13", "sys_platform": "linux", "os_name": "posix", "extra": ""}
    assert marker_holds("python_version >= '3.9' and sys_platform == 'linux'", env) == (True, [])
    assert marker_holds("(os_name == 'nt' or 'lin' in sys_platform) and python_version < '4'", env)[0]
    assert not marker_holds("sys_platform < 'z'", env)[0]
    assert marker_holds("what == 'x'", env)[1]
    assert not marker_holds("python_version >=", env)[0]


CASES = {
    "csv": "id,qty\n1,2\n3\n",
    "json": '{"t":{"u":[1,null]},"v":true}',
    "toml": 'a = 1\n[t]\nd = 2024-01-01\n',
    "xml": '<r><i k="1">a</i><i k="2"/></r>',
    "env": 'export A="x y" # n\nbad line\n',
    "requirements": "alpha>=1.2,<2 ; python_version >= \"3.9\"  # why\n-r other.txt\n",
    "python": "import a, b.c\nfrom .x import y as z\ntry:\n    import q\nexcept ImportError:\n    q = None\n__all__ = ['z']\n",
    "notebook": '{"cells":[{"cell_type":"markdown","source":["# Title\\n"]}]}',
}


def run(kind, text):
    return list(ANALYZERS[kind][0]("p", text))


def test_analyzers():
    assert ("p", "inconsistent-columns", 2, "row 2: expected 2 columns, got 1") in run("csv", "1,2\n3\n")
    assert ("p", "t", "u", "array", "[1, None]") in run("json", CASES["json"])
    assert run("json", '{"a":1,"a":2}')[0][3] == "diagnostic"
    assert run("json", "[" * 300)[0][4] == "json-depth"
    assert ("p", "t", "d", "datetime", "2024-01-01") in run("toml", CASES["toml"])
    assert run("xml", CASES["xml"])[2] == ("p", 2, "r.i", "", "k=2", "")
    assert run("xml", "<!DOCTYPE r><r/>")[0][3].startswith("xml-parse-error")
    assert run("env", CASES["env"]) == [("p", 0, "A", "x y", True), ("p", 1, None, "invalid-line", False)]
    assert run("requirements", CASES["requirements"])[0] == ("p", "requirement", "alpha", "", ">=1.2,<2", 'python_version >= "3.9"')
    kinds = [r[1] for r in run("python", CASES["python"])]
    assert kinds.count("import") == 3 and kinds.count("wildcard-export") == 1
    assert run("notebook", CASES["notebook"])[0][3] == "Title"


@pytest.mark.parametrize("kind", sorted(ANALYZERS))
def test_analyzers_never_raise(kind):
    for text in [*CASES.values(), "", "\x00", "[" * 5000, "{" * 5000, "é" * 100]:
        for cut in (len(text), len(text) // 2, 3):
            run(kind, text[:cut])
