"""Analyzers of text formats: each turns one document (path, text) into rows, and runs over a corpus in Arrow batches."""

from __future__ import annotations

import ast
import csv
import io
import json
import re
import tomllib
import xml.parsers.expat
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

MAX_DEPTH = 200
_IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def csv_shape(path: str, text: str):
    """(path, kind, number, name): columns, rows and ragged rows of delimited text."""
    body = text.strip().replace("\r\n", "\n").replace("\r", "\n")
    if not body:
        yield path, "rows", 0, ","
        return
    sample = body[:8192]
    try:
        dialect = csv.Sniffer().sniff(sample)
        delimiter, header = dialect.delimiter, csv.Sniffer().has_header(sample)
    except csv.Error:
        delimiter, header = ",", False
    if delimiter in '\n"':
        yield path, "csv-dialect-error", 0, delimiter
        delimiter = ","
    try:
        rows = [r for r in csv.reader(io.StringIO(body), delimiter=delimiter) if r]
    except csv.Error as e:
        yield path, "csv-decode-error", 0, str(e)
        return
    names = rows[0] if header else [f"column_{i}" for i in range(len(rows[0]))]
    for i, n in enumerate(names):
        yield path, "column", i, n
    for i, r in enumerate(rows[1:] if header else rows, 2 if header else 1):
        if len(r) != len(names):
            yield path, "inconsistent-columns", i, f"row {i}: expected {len(names)} columns, got {len(r)}"
    yield path, "rows", len(rows) - header, delimiter


def _depth(text: str) -> int:
    deep = most = 0
    for c in re.sub(r'"(?:[^"\\]|\\.)*"', "", text):
        deep += (c in "[{") - (c in "]}")
        most = max(most, deep)
    return most


def _kind(v, toml: bool) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return ("integer" if isinstance(v, int) else "float") if toml else "number"
    if isinstance(v, str):
        return "string"
    if isinstance(v, list):
        return "array"
    if isinstance(v, dict):
        return "table" if toml else "object"
    return "datetime"


def _sections(path: str, value: dict, toml: bool, name: str = ""):
    for k in sorted(value):
        v = value[k]
        if not isinstance(v, dict):
            yield path, name or "<root>", k, _kind(v, toml), v.isoformat() if hasattr(v, "isoformat") else repr(v)
    for k in sorted(value):
        if isinstance(value[k], dict):
            yield path, f"{name}.{k}" if name else k, "", _kind(value[k], toml), ""
            yield from _sections(path, value[k], toml, f"{name}.{k}" if name else k)


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("duplicate key")
    return out


def _refuse(c):
    raise ValueError(f"{c} isn't JSON")


def json_sections(path: str, text: str):
    """(path, section, key, type, value): keys of every object in sorted pre-order; a section's own row has no key."""
    if not text.strip():
        return
    if _depth(text) > MAX_DEPTH:
        yield path, "", "", "diagnostic", "json-depth"
        return
    try:
        v = json.loads(text, object_pairs_hook=_unique, parse_constant=_refuse)
    except (ValueError, RecursionError) as e:
        yield path, "", "", "diagnostic", f"json-decode-error: {e}"
        return
    if isinstance(v, dict):
        yield from _sections(path, v, False)
    else:
        yield path, "", "", "diagnostic", "json-root"


def toml_sections(path: str, text: str):
    """As json_sections, for TOML."""
    try:
        v = tomllib.loads(text)
        yield from list(_sections(path, v, True))
    except (tomllib.TOMLDecodeError, RecursionError) as e:
        yield path, "", "", "diagnostic", f"toml-decode-error: {e}"


def toml_dependencies(path: str, text: str):
    """(path, group, requirement): project dependencies (group empty), optional ones, and tool names (group `tool`)."""
    try:
        v = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError):
        return
    project = v.get("project") if isinstance(v.get("project"), dict) else {}
    for d in project.get("dependencies") if isinstance(project.get("dependencies"), list) else []:
        yield path, "", str(d)
    groups = project.get("optional-dependencies")
    for g in sorted(groups) if isinstance(groups, dict) else []:
        for d in groups[g] if isinstance(groups[g], list) else []:
            yield path, g, str(d)
    for t in sorted(v["tool"]) if isinstance(v.get("tool"), dict) else []:
        yield path, "tool", t


def xml_elements(path: str, text: str):
    """(path, number, element path, text, attributes as sorted k=v lines, child tags) in document order; document types are refused."""
    if not text.strip():
        return
    rows, stack = [], []
    parser = xml.parsers.expat.ParserCreate(namespace_separator=" ")

    def start(name, attrs):
        tag = name.rsplit(" ", 1)[-1]
        if stack:
            rows[stack[-1]][5].append(tag)
        if len(stack) >= 256:
            raise ValueError("nested deeper than 256")
        rows.append([path, len(rows), ".".join([*(rows[i][2].rsplit(".", 1)[-1] for i in stack), tag]), [], "\n".join(f"{k.rsplit(' ', 1)[-1]}={v}" for k, v in sorted(attrs.items())), []])
        stack.append(len(rows) - 1)

    def data(x):
        if stack:
            rows[stack[-1]][3].append(x)

    def doctype(*_):
        raise ValueError("document types are refused")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, lambda _: stack.pop(), data, doctype
    try:
        parser.Parse(text.encode(), True)
    except (xml.parsers.expat.ExpatError, ValueError) as e:
        yield path, -1, "", f"xml-parse-error: {e}", "", ""
        return
    for r in rows:
        yield r[0], r[1], r[2], "".join(r[3]).strip(), r[4], ",".join(r[5])


def env_entries(path: str, text: str):
    """(path, line, key, value, quoted): a line that isn't KEY=VALUE has key null and `invalid-line` as value."""
    for n, raw in enumerate(text.splitlines()):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        m = re.fullmatch(rf"(?:export\s+)?({_IDENTIFIER})\s*=\s*(.*)", line)
        if not m:
            yield path, n, None, "invalid-line", False
            continue
        value, quoted = m[2], False
        if value[:1] in ("'", '"'):
            end = value.find(value[0], 1)
            value, quoted = (value[1:end], True) if end > 0 else (value[1:], True)
        else:
            value = re.split(r"\s#", value, maxsplit=1)[0].strip()
        yield path, n, m[1], value, quoted


def requirements(path: str, text: str):
    """(path, kind, name, extras, specifier, markers): kind is requirement, editable, include, constraint, index or unparseable."""
    for raw in re.sub(r"\\\r?\n", "", text).splitlines():
        line = re.split(r"(?:^|\s)#", raw, maxsplit=1)[0].strip()
        if not line:
            continue
        m = re.fullmatch(r"(-r|--requirement|-c|--constraint|-i|--index-url|--extra-index-url|-f|--find-links|-e|--editable)[=\s]\s*(\S.*)", line)
        if m:
            kind = {"-r": "include", "--requirement": "include", "-c": "constraint", "--constraint": "constraint", "-e": "editable", "--editable": "editable"}.get(m[1], "index")
            yield path, kind, m[2], "", "", ""
            continue
        if line.startswith("-"):
            continue
        line = re.split(r"\s-", line, maxsplit=1)[0]
        body, _, markers = line.partition(";")
        m = re.fullmatch(r"([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[([^\]]*)\])?\s*(@\s*\S+|\(?\s*(?:[=<>!~]=?=?[^()]*)?\)?)", body.strip())
        if not m:
            yield path, "unparseable", raw, "", "", ""
            continue
        yield path, "requirement", re.sub(r"[-_.]+", "_", m[1]).lower(), ",".join(sorted(x.strip() for x in (m[2] or "").split(",") if x.strip())), re.sub(r"\s+", "", m[3]).strip("()"), markers.strip()


def _caught(t: ast.Try) -> bool:
    names = [n.id for h in t.handlers for n in ast.walk(h.type) if isinstance(n, ast.Name)] if all(h.type for h in t.handlers) else ["ImportError"]
    return bool({"ImportError", "ModuleNotFoundError"} & set(names))


def _statements(body):
    for s in body:
        yield s
        if isinstance(s, ast.If) and "TYPE_CHECKING" in ast.unparse(s.test):
            yield from _statements(s.body)
        elif isinstance(s, ast.Try) and _caught(s):
            yield from _statements(s.body)


def python_rows(path: str, text: str):
    """(path, kind, name, module, level, line): imports, definitions, exports and syntax errors of a source file."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        yield path, "syntax-error", str(getattr(e, "msg", e)), "", 0, int(getattr(e, "lineno", 0) or 0)
        return
    bound: dict[str, int] = {}
    explicit = None
    for s in _statements(tree.body):
        if isinstance(s, ast.Import):
            for a in s.names:
                yield path, "import", a.asname or a.name, a.name, 0, s.lineno
                bound[(a.asname or a.name).split(".")[0]] = s.lineno
        elif isinstance(s, ast.ImportFrom):
            for a in s.names:
                yield path, "from", a.name, s.module or "", s.level, s.lineno
                bound[a.asname or a.name] = s.lineno
        elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            yield path, "class" if isinstance(s, ast.ClassDef) else "function", s.name, "", 0, s.lineno
            bound[s.name] = s.lineno
        elif isinstance(s, (ast.Assign, ast.AnnAssign)):
            for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                for n in ast.walk(t):
                    if isinstance(n, ast.Name):
                        bound[n.id] = s.lineno
                        if n.id == "__all__" and isinstance(s.value, (ast.List, ast.Tuple)) and all(isinstance(e, ast.Constant) for e in s.value.elts):
                            explicit = [str(e.value) for e in s.value.elts]
    bound.pop("*", None)
    for n in sorted(bound):
        yield path, "export", n, "", 0, bound[n]
    for n in explicit if explicit is not None else sorted(n for n in bound if not n.startswith("_")):
        yield path, "wildcard-export", n, "", 0, bound.get(n, 0)


def notebook_cells(path: str, text: str):
    """(path, number, kind, heading, source): cells; an unreadable file is one row of kind diagnostic."""
    try:
        cells = json.loads(text)["cells"] if text.strip() else []
        for i, c in enumerate(cells):
            source = c.get("source", "")
            source = "".join(source) if isinstance(source, list) else str(source)
            heading = re.search(r"^#{1,6}\s+(.+?)\s*$", source, re.M) if c.get("cell_type") == "markdown" else None
            yield path, i, str(c.get("cell_type")), heading[1] if heading else "", source
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        yield path, -1, "diagnostic", "", f"notebook-decode-error: {e}"


def pth_directives(path: str, text: str):
    """(path, kind, value): search paths, and lines that are executed."""
    for line in text.splitlines():
        s = line.strip()
        if s and not s.startswith("#"):
            yield path, "exec" if s.startswith(("import ", "import\t")) else "path", s


def package_metadata(path: str, text: str):
    """(path, name, version, summary, requires): of a METADATA file; missing parts are null."""
    head = text.split("\n\n", 1)[0]
    get = lambda k: next((m[1].strip() for m in re.finditer(rf"^{k}:\s*(.*)$", head, re.M | re.I)), None) or None
    yield path, get("Name"), get("Version"), get("Summary"), "\n".join(m[1].strip() for m in re.finditer(r"^Requires-Dist:\s*(.*)$", head, re.M | re.I))


ANALYZERS: dict[str, tuple[Callable, str]] = {
    "csv": (csv_shape, "path string, kind string, number long, name string"),
    "json": (json_sections, "path string, section string, key string, type string, value string"),
    "toml": (toml_sections, "path string, section string, key string, type string, value string"),
    "toml_dependencies": (toml_dependencies, "path string, group string, requirement string"),
    "xml": (xml_elements, "path string, number long, element string, text string, attributes string, children string"),
    "env": (env_entries, "path string, line long, key string, value string, quoted boolean"),
    "requirements": (requirements, "path string, kind string, name string, extras string, specifier string, markers string"),
    "python": (python_rows, "path string, kind string, name string, module string, level int, line long"),
    "notebook": (notebook_cells, "path string, number long, kind string, heading string, source string"),
    "pth": (pth_directives, "path string, kind string, value string"),
    "metadata": (package_metadata, "path string, name string, version string, summary string, requires string"),
}


def analyze(documents: DataFrame, kind: str) -> DataFrame:
    """Rows of an analyzer over (path, text); documents are independent, so nothing is exchanged."""
    fn, schema = ANALYZERS[kind]
    ship(documents.sparkSession)
    names = [p.strip().split(" ")[0] for p in schema.split(",")]

    def run(frames):
        for f in frames:
            rows = [r for p, t in zip(f["path"], f["text"]) for r in fn(p, t or "")]
            yield pd.DataFrame(rows, columns=names)

    return documents.select("path", F.col("text").cast("string")).mapInPandas(run, schema)


def module_names(files: DataFrame) -> DataFrame:
    """path, module of .py files: folders as dots, packages by their __init__."""
    m = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".")
    return files.where(F.col("path").endswith(".py")).select("path", F.regexp_replace(m, r"(^|\.)__init__$", "").alias("module"))


def resolve_imports(imports: DataFrame, modules: DataFrame, stdlib: DataFrame, packages: DataFrame) -> DataFrame:
    """imports (path, module) with resolution: workspace, ambiguous, stdlib, installed or missing.

    modules (module, path), stdlib (module), packages (top_level, distribution).
    """
    top = F.substring_index("module", ".", 1)
    index = modules.groupBy("module").agg(F.count(F.lit(1)).alias("_files"))
    tops = modules.select(F.substring_index("module", ".", 1).alias("_top")).distinct().withColumn("_own", F.lit(True))
    known = stdlib.select(F.col("module").alias("_top"), F.lit(True).alias("_std")).distinct()
    dist = packages.groupBy(F.col("top_level").alias("_top")).agg(F.countDistinct("distribution").alias("_dists"))
    j = imports.withColumn("_top", top).join(index, "module", "left").join(tops, "_top", "left").join(known, "_top", "left").join(dist, "_top", "left")
    resolution = F.when(F.col("_files") == 1, "workspace").when(F.col("_files") > 1, "ambiguous").when(F.col("_own"), "missing").when(F.col("_std"), "stdlib").when(F.col("_dists") == 1, "installed").when(F.col("_dists") > 1, "ambiguous").otherwise("missing")
    return j.select(*imports.columns, resolution.alias("resolution"))


def dependency_status(declared: DataFrame, installed: DataFrame) -> DataFrame:
    """declared (name, specifier) against installed (name, version): satisfied, version_mismatch, missing or ambiguous."""
    from .versions import specifier_holds

    ship(declared.sparkSession)
    holds = F.pandas_udf(lambda s, v: pd.Series([bool(y is not None and specifier_holds(x or "", y, True)) for x, y in zip(s, v)]), "boolean")
    versions = installed.groupBy("name").agg(F.countDistinct("version").alias("_n"), F.max("version").alias("version"))
    j = declared.join(versions, "name", "left")
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").when((F.col("specifier") == "") | holds("specifier", "version"), "satisfied").otherwise("version_mismatch")
    return j.select("name", "specifier", "version", status.alias("status"))


def undeclared(imports: DataFrame, packages: DataFrame, declared: DataFrame) -> DataFrame:
    """distribution, first_path: installed distributions that are imported (path, module) but not declared (name)."""
    j = imports.join(packages, F.substring_index("module", ".", 1) == F.col("top_level"))
    return j.join(declared, F.col("distribution") == F.col("name"), "left_anti").groupBy("distribution").agg(F.min("path").alias("first_path"))
