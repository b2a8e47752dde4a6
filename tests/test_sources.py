"""Facts of Python sources, schemas, and the analyses over them."""

import random

import pytest

from tidewell.errors import SchemaGenerationError
from tidewell.functions import calc, python_source, schema
from tidewell.operators import joins, packages, workspace

TEXT = '''import os, a.b as ab
from .x import y as z
__all__ = ["C"]
T: int = 3
class C(ab.Base):
    k = 1
    def m(self, q: int = T) -> str:
        self.v = [i for i in q if (w := i)]
        return os.path.join(str(k), z(q, n=1))
def f():
    global T
    T = 4
    def g():
        nonlocal u
        u = 2
    u = 1
    try:
        pass
    except E as err:
        match u:
            case {"a": b, **rest}: pass
    return lambda p: p + u
'''


def facts(text, relation):
    return [dict(zip(python_source._NAMES, r)) for r in python_source.source_facts("p.py", text) if r[1] == relation]


def test_scopes_and_bindings():
    scopes = {r["scope"]: (r["name"], r["kind"], r["parent"]) for r in facts(TEXT, "scope")}
    assert [(n, k) for n, k, _ in scopes.values()] == [("<module>", "module"), ("C", "class"), ("m", "function"), ("f", "function"), ("<comprehension>", "comprehension"), ("g", "function"), ("<lambda>", "lambda")]
    bound = {(scopes[r["scope"]][0], r["name"]): r["kind"] for r in facts(TEXT, "binding")}
    assert bound["m", "w"] == "variable" and bound["<comprehension>", "i"] == "loop_target" and bound["f", "u"] == "variable" and ("g", "u") not in bound and ("f", "T") not in bound
    assert bound["f", "err"] == "exception_target" and bound["f", "b"] == bound["f", "rest"] == "pattern_target" and bound["<lambda>", "p"] == "parameter" and bound["<module>", "ab"] == "import_alias"
    used = [(r["name"], r["kind"], scopes.get(r["scope"], ("?",))[0], r["line"]) for r in facts(TEXT, "occurrence")]
    assert ("k", "load", "?", 8) in used  # a class body isn't seen from its methods
    assert ("u", "load", "f", 21) in used and ("u", "store", "f", 14) in used and ("T", "store", "<module>", 11) in used
    assert ("T", "load", "<module>", 6) in used


def test_symbols_members_calls_and_exports():
    assert {(r["name"], r["kind"]) for r in facts(TEXT, "symbol")} >= {("C", "class"), ("C.m", "method"), ("C.k", "class_variable"), ("f", "function"), ("f.g", "function"), ("z", "from_import_alias"), ("os", "import_alias"), ("T", "variable")}
    assert {(r["ref"], r["kind"]) for r in facts(TEXT, "member")} == {("m", "method"), ("k", "class_variable"), ("v", "instance_variable")}
    assert [(r["name"], r["ref"], r["number"]) for r in facts(TEXT, "call")] == [("os.path.join", "C.m", 2), ("str", "C.m", 1), ("z", "C.m", 2)]
    assert [(r["name"], r["ref"]) for r in facts(TEXT, "base")] == [("C", "ab.Base")]
    assert [r["name"] for r in facts(TEXT, "wildcard-export")] == ["C"] and [r["name"] for r in facts("from a import *\n__all__ = f()", "impure")] == ["wildcard re-export", "dynamic __all__"]
    assert facts("def", "syntax-error") and not facts("def", "scope")
    for text in ("x = 1 if", "\0", "(" * 500):
        assert [r[1] for r in python_source.source_facts("p", text)] == ["syntax-error"]


def test_ranges_are_code_points():
    r = sorted(facts("é = 'ü'; ñandú = é\n", "occurrence"), key=lambda x: x["char"])
    assert [(x["name"], x["char"], x["end_char"]) for x in r] == [("é", 0, 1), ("ñandú", 9, 14), ("é", 17, 18)]
    line = "a😀é"
    assert [python_source.convert_offset(line, n, "utf-8", "utf-16") for n in (0, 1, 3, 5, 7, 99)] == [0, 1, 1, 3, 4, 4]
    assert python_source.convert_offset(line, 3, "utf-16", "utf-32") == 2


def test_fuzzed_sources_never_raise():
    rng = random.Random(3)
    for _ in range(150):
        t = list(TEXT)
        for _ in range(rng.randrange(1, 6)):
            t[rng.randrange(len(t))] = rng.choice(TEXT + "\x00é(")
        assert isinstance(python_source.source_facts("p", "".join(t)[: rng.randrange(len(t))]), list)


SCHEMA = '{"$defs":{"Issue":{"type":"object","description":"An issue","properties":{"id":{"type":"integer"},"labels":{"$ref":"#/$defs/Labels"},"state":{"enum":["open","closed"]},"owner":{"anyOf":[{"$ref":"#/$defs/UserName"},{"type":"null"}]}},"required":["id"]},"Labels":{"type":"array","items":{"type":"string"}},"UserName":{"type":"object","properties":{"name":{"type":["string","null"]}}}}}'


def codes(text):
    return sorted(r[4] for r in schema.schema_rows("s", text) if r[3] == "diagnostic")


@pytest.mark.parametrize("text, want", [
    ("nonsense", ["invalid-json"]), ('{"a":1,"a":2}', ["invalid-json"]), ("[1]", ["invalid-schema-root"]), ('{"type":"object"}', ["unsupported-root-schema"]), ('{"$defs":3}', ["invalid-definitions"]),
    ('{"$defs":{"A":{"type":"x"}}}', ["unsupported-type"]), ('{"$defs":{"A":{"$ref":"#/$defs/B"}}}', ["unknown-ref"]), ('{"$defs":{"A":{"$ref":"http://x"}}}', ["unsupported-ref"]), ('{"$defs":{"a-b":{"type":"string"}}}', ["unsupported-definition-name"]),
    ('{"$defs":{"A":{"enum":[]}}}', ["empty-enum"]), ('{"$defs":{"A":{"enum":[1,1]}}}', ["duplicate-enum-value"]), ('{"$defs":{"A":{"enum":["a"],"type":"integer"}}}', ["enum-type-mismatch"]), ('{"$defs":{"A":{"const":1.5}}}', ["unsupported-const-value"]),
    ('{"$defs":{"A":{"oneOf":[]}}}', ["unsupported-construct"]), ('{"$defs":{"A":true}}', ["unsupported-boolean-schema"]), ('{"$defs":{"A":{"type":["string","integer"]}}}', ["unsupported-union"]), ('{"$defs":{"A":{"type":"object","properties":{},"required":["x"]}}}', ["unsupported-required-property"]),
    ('{"$defs":{"A":{"type":"string","minLength":-1}}}', ["invalid-constraint"]), ('{"$defs":{"A":{"type":"string","minLength":1}}}', ["ignored-constraint"]), ('{"$defs":{"AB":{"type":"string"},"Ab":{"type":"string"}}}', ["module-name-collision"] * 2), (SCHEMA, []),
])
def test_schema_codes(text, want):
    assert codes(text) == want


def test_names_and_pointers():
    assert [schema.snake(n) for n in ("UserIDName", "HTTPServer2Go", "plain", "A")] == ["user_id_name", "http_server2_go", "plain", "a"]
    assert schema.pointer("$defs", "a/b~c") == "/$defs/a~1b~0c" and schema.percent_decode("a%20%C3%A9") == "a é" and schema.percent_decode("%zz") is None


def test_schema_package(spark, tmp_path):
    from tidewell.operators.reconcile import Action

    docs = lambda t: spark.createDataFrame([("s.json", t)], "path string, text string")
    root = str(tmp_path / "models")
    done = schema.generate(docs(SCHEMA), Action(spark, "schema", root))
    assert done == {"created": ["__init__.py", "docs/issue.md", "docs/labels.md", "docs/user_name.md", "issue.py", "labels.py", "user_name.py"]}
    import sys

    sys.path.insert(0, str(tmp_path))
    import models

    assert models.Issue(id=1).state is None and models.Issue.__dataclass_params__.frozen
    assert "| id | `int` | yes |" in (tmp_path / "models" / "docs" / "issue.md").read_text()
    assert schema.generate(docs(SCHEMA), Action(spark, "schema", root)).keys() == {"unchanged"}
    with pytest.raises(SchemaGenerationError):
        schema.generate(docs(SCHEMA.replace('"integer"', '"nothing"')), Action(spark, "schema", root))
    loop = schema.compile_schemas(docs('{"$defs":{"A":{"$ref":"#/$defs/B"},"B":{"allOf":[{"$ref":"#/$defs/A"}]},"S":{"$ref":"#/$defs/S"},"Z":{"$ref":"#/$defs/A"}}}'))
    assert {(r.name, r.code) for r in schema.alias_cycles(loop).collect()} == {("A", "alias-cycle"), ("B", "alias-cycle"), ("S", "self-referential-alias")}
    structure = lambda t: {r.name: r.structure for r in schema.structures(schema.compile_schemas(docs(t))).collect()}
    assert structure(SCHEMA) == structure(SCHEMA.replace("An issue", "Another text"))
    assert {r.pointer for r in schema.definitions(schema.compile_schemas(docs(SCHEMA))).collect()} == {"/$defs/Issue", "/$defs/Labels", "/$defs/UserName"}


def test_calc(spark):
    files = spark.createDataFrame([("root", 'include "c"\nlet a = b + 2 - c # note\nlet b = 5\nemit a\nemit r\nnonsense here\n'), ("c", "let c = 3\nlet b = 100\nlet r = s\nlet s = r + 1\nlet q = nothing")], "path string, text string")
    parsed = calc.lines(files)
    assert parsed.where("kind = 'invalid'").count() == 1
    got = {r.name: (r.value, r.problem) for r in calc.evaluate(calc.bindings(parsed, "root")).collect()}
    assert got == {"a": (4, None), "b": (5, None), "c": (3, None), "r": (None, "cycle"), "s": (None, "cycle"), "q": (None, "unresolved")}
    assert [(r.path, bytes(r.content)) for r in calc.emitted(parsed, "root").collect()] == [("a.txt", b"4\n")]


SOURCES = [
    ("pkg/__init__.py", "from .core import run, Shape as S\nfrom .wild import *\n"),
    ("pkg/core.py", "import os, requests, nowhere\nfrom . import helper\nfrom .helper import used, unused\n\n\nclass Shape:\n    sides = 0\n    def area(self, scale):\n        return used(scale)\n\n\nclass Square(Shape):\n    sides = 4\n\n\ndef run(path, times=1):\n    return Square().area(times) + used(path)\n"),
    ("pkg/helper.py", "def used(x):\n    return x\n\n\ndef unused(x):\n    return x\n"),
    ("pkg/wild.py", "def free():\n    pass\n"),
    ("main.py", "from pkg import run, S, free\nimport pkg.core\nrun(1, 2)\nx: S = S()\nfree()\n"),
    ("broken.py", "def f(:\n"),
    ("a.py", "from b import one\n"),
    ("b.py", "from a import one\n"),
]


@pytest.fixture(scope="module")
def space(spark):
    from tidewell.operators.graph import table_of

    files = spark.createDataFrame(SOURCES, "path string, text string")
    f, index = table_of(python_source.facts(files)), workspace.modules(files)
    std, installed = spark.createDataFrame([("os",)], "module string"), spark.createDataFrame([("requests", "requests")], "top_level string, distribution string")
    resolved = table_of(workspace.resolve(f, index, std, installed))
    symbols = workspace.symbol_index(f, index)
    followed = table_of(workspace.follow_symbols(symbols.select("module", "name"), symbols, index, std, installed))
    return f, index, resolved, symbols, followed, std, installed


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_imports_and_surfaces(space):
    f, index, resolved, *_ = space
    got = rows(resolved, "path", "resolved_module", "resolution")
    assert {("pkg/core.py", "os", "stdlib"), ("pkg/core.py", "requests", "installed"), ("pkg/core.py", "nowhere", "missing"), ("pkg/core.py", "pkg.helper", "workspace"), ("main.py", "pkg.core", "workspace"), ("pkg/__init__.py", "pkg.core", "workspace")} <= got
    surface = {r.module: r.exports for r in workspace.export_surface(f, index, True).collect()}
    assert surface["pkg.helper"] == ["unused", "used"] and surface["broken"] == []
    analysis = {r.module: r for r in workspace.module_analysis(f, index, resolved).collect()}
    assert analysis["main"].dependencies == ["pkg", "pkg.core"] and analysis["pkg.core"].imports == 6
    assert rows(workspace.import_cycles(resolved, index), "module") == {("a",), ("b",)}


def test_symbols_and_references(space):
    f, index, resolved, symbols, followed, *_ = space
    got = {(r.module, r.name): (r.outcome, r.target_module, r.target_name) for r in followed.collect()}
    assert got["main", "run"] == ("workspace", "pkg.core", "run") and got["main", "S"] == ("workspace", "pkg.core", "Shape") and got["main", "free"] == ("workspace", "pkg.wild", "free")
    assert got["a", "one"][0] == "ambiguous" and got["pkg.core", "os"][0] == "stdlib"
    refs = workspace.references(f, index, followed)
    assert {(r.path, r.line) for r in refs.where("target_name = 'run'").collect()} == {("pkg/core.py", 15), ("pkg/__init__.py", 0), ("main.py", 0), ("main.py", 2)}
    assert rows(workspace.rename(refs, "pkg.core", "run", "go"), "path", "line", "new_text") == {("pkg/core.py", 15, "go"), ("pkg/__init__.py", 0, "go"), ("main.py", 0, "go"), ("main.py", 2, "go")}
    assert {(r.module, r.name): r.references for r in workspace.code_lenses(f, index, followed).collect()}["pkg.helper", "unused"] == 1
    assert rows(workspace.call_edges(f, index, followed), "caller", "callee") >= {("run", "used"), ("Shape.area", "used"), ("run", "Square"), ("<module>", "run")}
    assert rows(workspace.type_edges(f, index, followed), "class", "base_module", "base") == {("Square", "pkg.core", "Shape")}
    assert rows(workspace.class_models(f, index, followed), "class", "member", "definer") == {("Shape", "sides", "pkg.core:Shape"), ("Shape", "area", "pkg.core:Shape"), ("Square", "sides", "pkg.core:Square"), ("Square", "area", "pkg.core:Shape")}
    assert rows(workspace.inlay_hints(f, index, followed), "path", "line", "parameter") >= {("main.py", 2, "path"), ("main.py", 2, "times")}
    assert ("main.py", "(path, times=1)") in rows(workspace.signature_help(f, index, followed), "path", "signature")
    assert ("main.py", "x", "Shape") in rows(workspace.type_definitions(f, index, followed), "path", "name", "target_name")


def test_places(spark, space):
    f, index, resolved, *_ = space
    at = spark.createDataFrame([("main.py", 2, 1), ("pkg/core.py", 8, 20)], "path string, line long, char long")
    assert rows(workspace.symbol_at(f, at), "path", "name") == {("main.py", "run"), ("pkg/core.py", "scale")} or rows(workspace.symbol_at(f, at), "path", "name") == {("main.py", "run"), ("pkg/core.py", "used")}
    assert rows(workspace.highlights(f, at.where("path = 'main.py'")), "line", "write") == {(0, True), (2, False)}
    chain = workspace.selection_chain(f, at.where("path = 'pkg/core.py'")).orderBy("depth").collect()
    assert [r.depth for r in chain] == list(range(len(chain))) and len(chain) >= 4
    names, more = workspace.completions(f, "pkg/core.py", "u", 1)
    assert [r.name for r in names.collect()] == ["unused"] and more.first().incomplete
    tokens = workspace.semantic_tokens(f).where("path = 'main.py'").collect()
    assert sum(r.delta_line for r in tokens) == 4 and tokens[0].length == 3
    assert ("main.py", "pkg/core.py") in rows(workspace.document_links(resolved), "path", "target")
    moves = spark.createDataFrame([("pkg.helper", "pkg.util")], "old_module string, new_module string")
    assert rows(workspace.moved_imports(resolved, moves), "path", "new_module") == {("pkg/core.py", "pkg.util")}
    assert workspace.declarations(f).where("name = 'Square'").count() == 1


def test_diagnostics(spark, space):
    f, index, resolved, *_ = space
    found = workspace.analyze_workspace(f, index, resolved)
    got = rows(found, "path", "code", "severity")
    assert {("broken.py", "syntax-error", "error"), ("pkg/core.py", "missing-import", "error"), ("pkg/core.py", "unused-import", "hint"), ("pkg/__init__.py", "dynamic-exports", "information")} <= got
    assert [r.message for r in found.where("code = 'unused-import' and path = 'pkg/core.py'").orderBy("message").collect()] == ["unused import: helper", "unused import: unused"]
    assert workspace.gate(found, "error") and not workspace.gate(found.where("severity = 'hint'"), "warning") and workspace.gate(found, "hint") and not workspace.gate(found.limit(0), "hint")
    ordered = workspace.in_order(found).collect()
    assert [r.path for r in ordered] == sorted(r.path for r in ordered)
    spans = spark.createDataFrame([("pkg/core.py", 0, 2)], "path string, from_line long, to_line long")
    assert rows(workspace.code_actions(found, spans), "action") == {("Remove the import",), ("Declare the dependency",)}
    status = spark.createDataFrame([("x", ">=2", "1.0", "version_mismatch"), ("y", "", None, "satisfied")], "name string, specifier string, version string, status string")
    assert rows(workspace.dependency_diagnostics(status, "req.txt"), "code", "message") == {("dependency-version-mismatch", "x >=2 is version mismatch")}


def test_workspace_files(spark):
    files = spark.createDataFrame([("a.py",), ("x/b.py",), ("x/__pycache__/c.py",), ("d.txt",)], "path string")
    assert rows(workspace.collect_files(files), "path") == {("a.py",), ("x/b.py",)}
    with pytest.raises(ValueError):
        workspace.collect_files(files, most=1)


def test_packages(spark):
    meta = lambda n, v: f"Metadata-Version: 2.1\nName: {n}\nVersion: {v}\nSummary: s\nRequires-Dist: dep>=1\n\nbody"
    files = spark.createDataFrame([
        ("My_Pkg-1.0.dist-info/METADATA", meta("My.Pkg", "1.0")), ("My_Pkg-1.0.dist-info/top_level.txt", "mine\n"), ("two-2.dist-info/METADATA", meta("two", "2")), ("two-2.dist-info/RECORD", "two/__init__.py,sha,1\nsolo.py,,\ntwo-2.dist-info/METADATA,,\n../bin/x,,\n"),
        ("pth-3.dist-info/METADATA", meta("pth", "3")), ("pth-3.dist-info/RECORD", "pth.pth,,\n"), ("bad-1.dist-info/METADATA", "nothing"),
    ], "path string, text string")
    found = packages.installed(files)
    assert {(r.distribution, r.version, tuple(r.top_levels), r.problem) for r in found.collect()} == {("my_pkg", "1.0", ("mine",), None), ("two", "2", ("solo", "two"), None), ("pth", "3", ("pth",), None), ("bad", None, ("bad",), "metadata-parse-failed")}
    std = spark.createDataFrame([("os",)], "module string")
    names = spark.createDataFrame([("os.path",), ("solo",), ("none",)], "name string")
    assert rows(packages.import_origin(names, std, packages.environment_index(found)), "name", "origin", "version") == {("os.path", "stdlib", None), ("solo", "installed", "2"), ("none", "unknown", None)}
    asked = spark.createDataFrame([("two", ">=1", ""), ("two", ">=3", ""), ("pth", "", "os_name == 'x'"), ("zz", "", "os_name == 'y'"), ("my_pkg", "@ http://x", "")], "name string, specifier string, markers string")
    got = packages.applicable(asked, packages.distributions(found), {"os_name": "y"})
    assert rows(got, "name", "specifier", "status") == {("two", ">=1", "satisfied"), ("two", ">=3", "version_mismatch"), ("pth", "", "not_applicable"), ("zz", "", "missing"), ("my_pkg", "@ http://x", "satisfied")}
    assert packages.marker_environment(spark).count() == 11 and packages.site_packages(spark).count() >= 1


def test_module_location(spark):
    paths = spark.createDataFrame([(0, "/one"), (1, "/two")], "number int, path string")
    files = spark.createDataFrame([(p,) for p in ("/one/a/__init__.py", "/one/a/b.py", "/one/a.py", "/one/n/x.py", "/two/n/y.py", "/two/a/c.py", "/two/m.py", "/one/m/z.py")], "path string")
    asked = spark.createDataFrame([(m,) for m in ("a", "a.b", "a.c", "n", "n.x", "n.y", "m", "m.z", "none")], "module string")
    got = {r.module: (r.kind, r.file) for r in packages.locate(asked, paths, files).collect()}
    assert got == {"a": ("package", "/one/a/__init__.py"), "a.b": ("module", "/one/a/b.py"), "a.c": ("missing", None), "n": ("namespace", None), "n.x": ("module", "/one/n/x.py"), "n.y": ("module", "/two/n/y.py"), "m": ("module", "/two/m.py"), "m.z": ("missing", None), "none": ("missing", None)}
    pth = spark.createDataFrame([("/one", "z.pth", 0, "/extra"), ("/one", "a.pth", 1, "sub"), ("/two", "a.pth", 0, "/extra")], "folder string, file string, line int, value string")
    assert [r.path for r in packages.search_paths(paths, pth).orderBy("number").collect()] == ["/one", "/one/sub", "/extra", "/two"]


def test_requirement_includes(spark):
    includes = spark.createDataFrame([("r", 0, "a"), ("r", 5, "b"), ("a", 0, "b"), ("b", 9, "a")], "path string, number long, target string")
    lines = spark.createDataFrame([("r", 3, "x", "root"), ("a", 1, "x", "a"), ("b", 1, "x", "b"), ("b", 2, "y", "b"), ("a", 1, "y", "a")], "path string, number long, name string, v string")
    tree = packages.include_closure(includes, "r")
    assert tree.where("state = 'cycle'").count() == 2
    assert {r.name: r.v for r in packages.last_wins(lines, tree).collect()} == {"x": "root", "y": "b"}


def test_joins_against_brute_force(spark):
    rng = random.Random(4)
    points = [(i % 3, rng.randrange(200), i) for i in range(60)]
    spans = [(i % 3, s, s + rng.randrange(0, 60), i) for i in range(40) for s in [rng.randrange(200)]]
    p, s = spark.createDataFrame(points, "k int, at int, p int"), spark.createDataFrame(spans, "k int, s int, e int, i int")
    got = rows(joins.range_join(p, s, "at", "s", "e", ["k"], 16), "p", "i")
    assert got == {(n, i) for k, at, n in points for k2, a, b, i in spans if k == k2 and a <= at < b}
    r = spark.createDataFrame([(k, a, i) for k, a, _, i in spans], "k int, since int, i int")
    filled = rows(joins.as_of(p, r, ["k"], "at", "since", ["since"]), "p", "since")
    assert filled == {(n, max((a for k2, a, _, _ in spans if k2 == k and a <= at), default=None)) for k, at, n in points}
    f = spark.createDataFrame(python_source.source_facts("p.py", TEXT), python_source.FACTS)
    uses = f.where("relation = 'occurrence' and kind = 'load' and name in ('u', 'q', 'k', 'z', 'E')").select("path", "name", f["parent"].alias("scope"), "line")
    found = joins.nearest_enclosing(uses, f.where("relation = 'binding'").select("path", "name", "scope"), f.where("relation = 'scope'").select("path", "scope", "parent", "kind"))
    assert rows(found, "name", "line", "found") == {("q", 7, 2), ("k", 8, None), ("z", 8, 0), ("q", 8, 2), ("E", 18, None), ("u", 19, 3), ("u", 21, 3)}
