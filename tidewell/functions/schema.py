"""JSON Schema documents as relations of definitions, and the Python models and docs that follow from them.

A node's shape is chosen in the order $ref, combinator, enum, const, type.  Whatever has no faithful type is a diagnostic;
an error keeps all outputs back.
"""

from __future__ import annotations

import json
import keyword
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaGenerationError
from ..operators.graph import cycle_members
from ..shipping import ship
from .documents import MAX_DEPTH, _depth, _refuse, _unique

_TYPES = {"string": "str", "integer": "int", "number": "float", "boolean": "bool", "null": "None", "array": "list", "object": "dict[str, object]"}
_SECTIONS = ("$defs", "definitions")
_NOTES = {"title", "$comment", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"}
_CHECKS = {"minLength", "maxLength", "pattern", "format", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minItems", "maxItems", "uniqueItems", "minProperties", "maxProperties", "contentEncoding", "contentMediaType"}
_RESERVED = {"annotations", "dataclass", "Literal", "TypeAlias", "TYPE_CHECKING"}
ROWS = "path string, section string, name string, kind string, field string, type string, required boolean, detail string, severity string"
_COLUMNS = [c.strip().split(" ")[0] for c in ROWS.split(",")]


def snake(name: str) -> str:
    """UserID2Name as user_id2_name."""
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", unicodedata.normalize("NFKC", name))
    return re.sub(r"\W+", "_", s).strip("_").lower()


def snake_column(c: Column) -> Column:
    """As snake, in the JVM, for names of ASCII letters."""
    s = F.regexp_replace(F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_"), r"\W+", "_")
    return F.lower(F.regexp_replace(s, "^_+|_+$", ""))


def pointer(*parts: str) -> str:
    """JSON pointer of the parts; ~ and / are escaped."""
    return "".join("/" + p.replace("~", "~0").replace("/", "~1") for p in parts)


def pointer_column(*parts: Column) -> Column:
    return F.concat(*[x for p in parts for x in (F.lit("/"), F.replace(F.replace(p, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))])


def percent_decode(text: str) -> str | None:
    """%XX sequences as UTF-8; None where they are malformed."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        return None
    try:
        return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode()).decode()
    except UnicodeDecodeError:
        return None


class _Document:
    def __init__(self, path: str, text: str):
        self.path, self.rows = path, []
        try:
            if _depth(text) > MAX_DEPTH:
                raise ValueError("nested too deep")
            root = json.loads(text, object_pairs_hook=_unique, parse_constant=_refuse)
        except (ValueError, RecursionError) as e:
            self.say("invalid-json", str(e))
            return
        if not isinstance(root, dict):
            self.say("invalid-schema-root", "the document isn't an object")
            return
        for k in root:
            if k not in (*_SECTIONS, "$schema", "$id", "title", "$comment", "description"):
                self.say("unsupported-root-schema", k)
        self.names = {s: root.get(s, {}) for s in _SECTIONS if s in root}
        for s, defs in list(self.names.items()):
            if not isinstance(defs, dict):
                self.say("invalid-definitions", s)
                self.names[s] = {}
        twice = set.intersection(*map(set, self.names.values())) if len(self.names) == 2 else set()
        stems: dict[str, list[str]] = {}
        for s in self.names:
            for name, node in self.names[s].items():
                stems.setdefault(snake(name).casefold(), []).append(name)
                if name in twice:
                    self.say("duplicate-definition", name, s, name)
                self.definition(s, name, node)
        for stem, names in stems.items():
            if len(set(names)) > 1:
                for n in set(names):
                    self.say("module-name-collision", f"{stem}.py", name=n)

    def add(self, kind, section="", name="", field="", type_="", required=None, detail="", severity=""):
        self.rows.append((self.path, section, name, kind, field, type_, required, detail, severity))

    def say(self, code, detail, section="", name="", severity="error"):
        self.add("diagnostic", section, name, code, detail=detail, severity=severity)

    def definition(self, section, name, node):
        self.at = section, name
        self.add("definition", section, name, detail=json.dumps(node, sort_keys=True, ensure_ascii=False))
        if not name.isidentifier() or keyword.iskeyword(name):
            self.say("unsupported-definition-name", name, section, name)
        elif name in _RESERVED:
            self.say("reserved-definition-name", name, section, name)
        stem = snake(name)
        if not stem.isidentifier() or keyword.iskeyword(stem):
            self.say("invalid-module-name", stem, section, name)
        if isinstance(node, bool):
            return self.say("unsupported-boolean-schema", str(node).lower(), section, name)
        if not isinstance(node, dict):
            return self.say("invalid-definition", type(node).__name__, section, name)
        if self.shape(node) == "type" and node.get("type") == "object" and "additionalProperties" not in node:
            self.notes(node)
            self.add("model", section, name, detail=node.get("description", "") if isinstance(node.get("description"), str) else "")
            return self.model(node)
        alias = self.render(node)
        self.add("alias", section, name, type_=alias, detail=node.get("description", "") if isinstance(node.get("description"), str) else "")
        target = self.alias_target(node)
        if target:
            self.add("alias-ref", section, name, detail=target)

    def notes(self, node):
        for k in ("title", "$comment", "description"):
            if k in node and not isinstance(node[k], str):
                self.say("invalid-description" if k == "description" else "invalid-annotation", k, *self.at)
        for k in sorted(set(node) & _CHECKS):
            v = node[k]
            number = isinstance(v, (int, float)) and not isinstance(v, bool)
            good = isinstance(v, str) if k in ("pattern", "format", "contentEncoding", "contentMediaType") else isinstance(v, bool) if k == "uniqueItems" else number and v > 0 if k == "multipleOf" else number and (k[:3] not in ("min", "max") or k in ("minimum", "maximum") or (v >= 0 and v == int(v)))
            self.say("ignored-constraint" if good else "invalid-constraint", k, *self.at, severity="warning" if good else "error")

    def shape(self, node) -> str | None:
        return next((s for s, keys in (("$ref", ["$ref"]), ("combinator", ["allOf", "anyOf", "oneOf", "not", "if", "then", "else"]), ("enum", ["enum"]), ("const", ["const"]), ("type", ["type"])) if any(k in node for k in keys)), None)

    def model(self, node):
        section, name = self.at
        properties, required = node.get("properties"), node.get("required", [])
        if properties is None:
            self.say("unconstrained-object-model", name, section, name, "warning")
            properties = {}
        if not isinstance(properties, dict):
            self.say("invalid-properties", type(properties).__name__, section, name)
            properties = {}
        if not isinstance(required, list) or not all(isinstance(r, str) for r in required):
            self.say("invalid-required", json.dumps(required), section, name)
            required = []
        for r in sorted(set(required)):
            if required.count(r) > 1:
                self.say("duplicate-required-name", r, section, name)
            if r not in properties:
                self.say("unsupported-required-property", r, section, name)
        folded = [unicodedata.normalize("NFKC", p) for p in properties]
        for p, node in properties.items():
            if not p.isidentifier() or keyword.iskeyword(p):
                self.say("unsupported-field-name", p, section, name)
            elif p in _RESERVED - {"annotations"}:
                self.say("reserved-field-name", p, section, name)
            if folded.count(unicodedata.normalize("NFKC", p)) > 1:
                self.say("field-name-collision", p, section, name)
            type_ = self.render(node)
            self.add("field", section, name, p, type_, p in required, node.get("description", "") if isinstance(node, dict) and isinstance(node.get("description"), str) else "")

    def alias_target(self, node) -> str | None:
        """The definition that an alias names without a container between."""
        if not isinstance(node, dict):
            return None
        if isinstance(node.get("$ref"), str):
            m = re.fullmatch(r"#/(\$defs|definitions)/([^/]+)", node["$ref"])
            return m and (percent_decode(m[2]) or "").replace("~1", "/").replace("~0", "~")
        for k in ("allOf", "anyOf"):
            parts = [p for p in node.get(k, []) if p != {"type": "null"}] if isinstance(node.get(k), list) else []
            if len(parts) == 1:
                return self.alias_target(parts[0])
        return None

    def render(self, node) -> str:
        if isinstance(node, bool):
            self.say("unsupported-boolean-schema", str(node).lower(), *self.at)
            return "object"
        if not isinstance(node, dict):
            self.say("invalid-schema-node", type(node).__name__, *self.at)
            return "object"
        self.notes(node)
        shape = self.shape(node)
        beside = set(node) - _NOTES - _CHECKS
        if shape == "$ref":
            if beside != {"$ref"}:
                self.say("ambiguous-schema-combination", ", ".join(sorted(beside)), *self.at)
            return self.reference(node["$ref"])
        if shape == "combinator":
            if len(beside) > 1:
                self.say("ambiguous-schema-combination", ", ".join(sorted(beside)), *self.at)
            k, parts = next((k, node[k]) for k in ("allOf", "anyOf", "oneOf", "not", "if", "then", "else") if k in node)
            if k == "allOf" and isinstance(parts, list) and len(parts) == 1:
                return self.render(parts[0])
            if k == "anyOf" and isinstance(parts, list) and len(parts) == 2 and {"type": "null"} in parts:
                return f"{self.render(next(p for p in parts if p != {'type': 'null'}))} | None"
            self.say("unsupported-construct", k, *self.at)
            return "object"
        if shape in ("enum", "const"):
            return self.literal(node, shape)
        if shape is None:
            if beside:
                self.say("unsupported-construct", ", ".join(sorted(beside)), *self.at)
            else:
                self.say("unconstrained-schema", "any value", *self.at, severity="warning")
            return "object"
        kind = node["type"]
        if isinstance(kind, list):
            if len(kind) == 2 and "null" in kind and kind[0] != kind[1] and all(isinstance(k, str) for k in kind):
                return f"{self.render({k: v for k, v in node.items() if k not in _CHECKS | _NOTES} | {'type': next(k for k in kind if k != 'null')})} | None"
            self.say("unsupported-union", json.dumps(kind), *self.at)
            return "object"
        if not isinstance(kind, str):
            self.say("invalid-type", json.dumps(kind), *self.at)
            return "object"
        if kind not in _TYPES:
            self.say("unsupported-type", kind, *self.at)
            return "object"
        if kind == "array":
            if isinstance(node.get("items"), list):
                self.say("unsupported-tuple-items", "items", *self.at)
                return "list[object]"
            if "items" not in node:
                self.say("unconstrained-array-items", "items", *self.at, severity="warning")
                return "list[object]"
            return f"list[{self.render(node['items'])}]"
        if kind == "object":
            more = node.get("additionalProperties")
            if "properties" in node:
                self.say("unsupported-construct", "an inline object with properties", *self.at)
            return f"dict[str, {self.render(more)}]" if isinstance(more, dict) else "dict[str, object]"
        return _TYPES[kind]

    def reference(self, ref) -> str:
        if not isinstance(ref, str):
            self.say("invalid-ref", json.dumps(ref), *self.at)
            return "object"
        m = re.fullmatch(r"#/(\$defs|definitions)/([^/]+)", ref)
        name = percent_decode(m[2]) if m else None
        if name is None:
            self.say("unsupported-ref", ref, *self.at)
            return "object"
        name = name.replace("~1", "/").replace("~0", "~")
        if name not in self.names.get(m[1], {}):
            self.say("unknown-ref", ref, *self.at)
        if not name.isidentifier():
            self.say("unsupported-ref-name", name, *self.at)
            return "object"
        self.add("ref", *self.at, detail=name)
        return name

    def literal(self, node, shape) -> str:
        members = node["enum"] if shape == "enum" else [node["const"]]
        if not isinstance(members, list):
            self.say("invalid-enum", type(members).__name__, *self.at)
            return "object"
        if not members:
            self.say("empty-enum", "no members", *self.at)
            return "Never"
        if any(not (v is None or isinstance(v, (str, bool, int))) for v in members):
            self.say(f"unsupported-{shape}-value", json.dumps(members), *self.at)
            return "object"
        if len({(type(v), v) for v in members}) != len(members):
            self.say("duplicate-enum-value", json.dumps(members), *self.at)
        kinds = {"string": str, "integer": int, "boolean": bool, "null": type(None), "number": int}
        said = node.get("type")
        wanted = said if isinstance(said, list) else [said] if said is not None else []
        for v in members:
            if wanted and not any(type(v) is kinds.get(k) for k in wanted):
                self.say(f"{shape}-type-mismatch", json.dumps(v), *self.at)
        return f"Literal[{', '.join(map(repr, members))}]"


def schema_rows(path: str, text: str) -> list[tuple]:
    """ROWS of one document: definition (detail: its JSON), model, field, alias, ref, alias-ref, diagnostic (field: code)."""
    return _Document(path, text).rows


def compile_schemas(documents: DataFrame) -> DataFrame:
    """ROWS of all (path, text)."""
    ship(documents.sparkSession)

    def run(frames):
        for f in frames:
            yield pd.DataFrame([r for p, t in zip(f["path"], f["text"]) for r in schema_rows(p, t or "")], columns=_COLUMNS)

    return documents.select("path", F.col("text").cast("string").alias("text")).mapInPandas(run, ROWS)


def definitions(rows: DataFrame) -> DataFrame:
    """path, section, name, pointer, raw: the per-definition text that edits are cut off by."""
    return rows.where("kind = 'definition'").select("path", "section", "name", pointer_column(F.col("section"), F.col("name")).alias("pointer"), F.col("detail").alias("raw"))


def structures(rows: DataFrame) -> DataFrame:
    """path, name, structure: digest of fields and types without their docs."""
    part = F.concat_ws(":", "kind", "field", "type", F.col("required").cast("string"))
    return rows.where("kind in ('model', 'field', 'alias')").groupBy("path", "name").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), ";"), 256).alias("structure"))


def alias_cycles(rows: DataFrame) -> DataFrame:
    """path, name, code of aliases that name themselves, alone or in a loop."""
    sep = "\x00"
    key = lambda c: F.concat_ws(sep, "path", c)
    edges = rows.where("kind = 'alias-ref'").select(key("name").alias("src"), key("detail").alias("dst"))
    own = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    loops = cycle_members(edges.where("src <> dst"))
    split = lambda t, code: t.select(F.split("node", sep).getItem(0).alias("path"), F.split("node", sep).getItem(1).alias("name"), F.lit(code).alias("code"))
    return split(own, "self-referential-alias").unionByName(split(loops.join(own, "node", "left_anti"), "alias-cycle"))


def diagnostics(rows: DataFrame) -> DataFrame:
    """path, name, code, detail, severity."""
    found = rows.where("kind = 'diagnostic'").select("path", "name", F.col("field").alias("code"), "detail", "severity")
    return found.unionByName(alias_cycles(rows).select("path", "name", "code", F.lit("").alias("detail"), F.lit("error").alias("severity")))


def outputs(rows: DataFrame) -> DataFrame:
    """path, content of the generated package of one document: a module and a doc a definition, and __init__; refuses while there are errors."""
    errors = diagnostics(rows).where("severity = 'error'").limit(5).collect()
    if errors:
        raise SchemaGenerationError("; ".join(f"{r.name}: {r.code} {r.detail}" for r in errors))
    stem = snake_column(F.col("name"))
    fields = rows.where("kind = 'field'").groupBy("name").agg(F.array_sort(F.collect_list(F.struct((~F.col("required")).alias("o"), "field", "type", F.col("detail").alias("doc")))).alias("fields"))
    refs = rows.where("kind = 'ref' and name <> detail").groupBy("name").agg(F.array_sort(F.collect_set("detail")).alias("refs"))
    heads = rows.where("kind in ('model', 'alias')").select("name", "kind", "type", F.col("detail").alias("doc")).join(fields, "name", "left").join(refs, "name", "left")
    none = F.array().cast("array<string>")
    imports = F.array_join(F.transform(F.coalesce("refs", none), lambda r: F.concat(F.lit("    from ."), snake_column(r), F.lit(" import "), r)), "\n")
    guard = F.when(F.size(F.coalesce("refs", none)) > 0, F.concat(F.lit("\nif TYPE_CHECKING:\n"), imports, F.lit("\n"))).otherwise("")
    line = lambda f: F.concat(F.lit("    "), f["field"], F.lit(": "), f["type"], F.when(f["o"], F.when(f["type"].endswith("| None"), " = None").otherwise(" | None = None")).otherwise(""))
    body = F.when(F.size("fields") > 0, F.array_join(F.transform("fields", line), "\n")).otherwise(F.lit("    pass"))
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    model = F.concat(F.lit("\n\n@dataclass(frozen=True)\nclass "), F.col("name"), F.lit(":\n"), body, F.lit("\n"))
    alias = F.concat(F.lit("\n"), F.col("name"), F.lit(": TypeAlias = "), F.when(F.col("type").startswith("Literal["), F.col("type")).otherwise(quote(F.col("type"))), F.lit("\n"))
    source = F.concat(F.lit("from __future__ import annotations\n\nfrom dataclasses import dataclass\nfrom typing import TYPE_CHECKING, Literal, TypeAlias\n"), guard, F.when(F.col("kind") == "model", model).otherwise(alias))
    row = lambda f: F.concat(F.lit("| "), f["field"], F.lit(" | `"), F.replace(f["type"], F.lit("|"), F.lit("\\|")), F.lit("` | "), F.when(f["o"], "no").otherwise("yes"), F.lit(" | "), f["doc"], F.lit(" |"))
    table = F.when(F.size("fields") > 0, F.concat(F.lit("\n| field | type | required | description |\n|-|-|-|-|\n"), F.array_join(F.transform("fields", row), "\n"), F.lit("\n"))).otherwise(F.when(F.col("kind") == "alias", F.concat(F.lit("\n`"), F.col("type"), F.lit("`\n"))).otherwise(""))
    doc = F.concat(F.lit("# "), F.col("name"), F.lit("\n"), F.when(F.col("doc") != "", F.concat(F.lit("\n"), F.col("doc"), F.lit("\n"))).otherwise(""), table)
    py = heads.select(F.concat(stem, F.lit(".py")).alias("path"), source.alias("text"))
    md = heads.select(F.concat(F.lit("docs/"), stem, F.lit(".md")).alias("path"), doc.alias("text"))
    each = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("from ."), stem, F.lit(" import "), F.col("name"), F.lit(" as "), F.col("name")))), "\n")
    init = heads.agg(each.alias("text")).select(F.lit("__init__.py").alias("path"), F.concat("text", F.lit("\n")).alias("text"))
    return py.unionByName(md).unionByName(init).select("path", F.encode("text", "UTF-8").alias("content"))


def generate(documents: DataFrame, action) -> dict[str, list[str]]:
    """Compile one document and converge the action's folder to its package."""
    return action.reconcile(outputs(compile_schemas(documents).persist()))
