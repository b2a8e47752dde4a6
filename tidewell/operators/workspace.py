"""Analyses of a whole workspace of Python sources as relations over facts (functions.python_source): modules, import resolution,
export surfaces, symbols followed through re-exports, references, classes, calls, and edits that follow from renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import module_names
from .graph import cycle_members, table_of
from .joins import first_wins, innermost, range_join

HOPS = 8
POSITION = ["line", "char", "end_line", "end_char"]


def of(facts: DataFrame, relation: str) -> DataFrame:
    return facts.where(F.col("relation") == relation)


def collect_files(files: DataFrame, include: list[str] = ("*.py",), ignore: list[str] = (".git", "__pycache__", "node_modules", ".venv"), most: int = 1_000) -> DataFrame:
    """Files (path) that match a pattern and lie in no ignored folder; more than `most` is an error, as a workspace then isn't what it seems."""
    glob = lambda g: "^(.*/)?" + g.replace(".", r"\.").replace("**/", "\x00").replace("*", "[^/]*").replace("\x00", "(.*/)?").replace("?", "[^/]") + "$"
    keep, skip = F.lit(False), F.lit(False)
    for g in include:
        keep = keep | F.col("path").rlike(glob(g))
    for folder in ignore:
        skip = skip | F.array_contains(F.split("path", "/"), folder)
    found = files.where(keep & ~skip)
    if found.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} files")
    return found


def modules(files: DataFrame) -> DataFrame:
    """module, path, package (whether it is an __init__) of files (path)."""
    return module_names(files).withColumn("package", F.col("path").rlike(r"(^|/)__init__\.py$"))


def absolute(imports: DataFrame, index: DataFrame) -> DataFrame:
    """imports (path, ref, number = level) with `base`: the absolute module; level 1 is the file's own package.  Null where the level leads out."""
    own = index.select("path", F.col("module").alias("_own"), "package")
    parts = F.split("_own", r"\.")
    keep = F.size(parts) - F.col("number") + F.col("package").cast("int")
    lead = F.when(keep > 0, F.array_join(F.slice(parts, 1, keep), "."))
    joined = F.when(F.col("ref") == "", lead).otherwise(F.concat_ws(".", lead, F.col("ref")))
    # At the top of the workspace a package has no name of its own.
    base = F.when(F.col("number") == 0, F.col("ref")).when(keep > 0, joined).when(keep == 0, F.nullif(F.col("ref"), F.lit("")))
    return imports.join(own, "path").withColumn("base", base).drop("_own", "package")


def resolve(facts: DataFrame, index: DataFrame, stdlib: DataFrame, packages: DataFrame) -> DataFrame:
    """Imports (path, name, ref, number, base, position) with resolved_module, resolution and distribution.

    The candidates of `from b import n` are b.n, then b.  Distinct candidates are resolved once, rows meet the result.  A
    candidate is ambiguous if it or a proper prefix has several files, or if it has one below a prefix that isn't a package;
    workspace if it has one otherwise.
    Else by its top name: in the workspace, missing; else stdlib, installed or missing; a relative import stays inside.
    """
    rows = absolute(of(facts, "import"), index).select("path", "name", "kind", "ref", "number", "base", "detail", *POSITION)
    rows = rows.withColumn("_one", F.when((F.col("kind") == "from") & (F.col("name") != "*"), F.concat_ws(".", "base", "name"))).withColumn("_two", F.col("base"))
    asked = rows.select(F.explode(F.array("_one", "_two")).alias("module")).where("module is not null").distinct()
    files = index.groupBy("module").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("file"), F.min("package").alias("package"))
    prefix = asked.select("module", F.explode(F.expr("transform(sequence(1, size(split(module, '\\\\.'))), i -> array_join(slice(split(module, '\\\\.'), 1, i), '.'))")).alias("_p"))
    met = prefix.join(files.withColumnRenamed("module", "_p"), "_p", "left")
    own = F.col("_p") == F.col("module")
    state = met.groupBy("module").agg(
        F.max(F.when(own, F.col("files"))).alias("files"), F.max(F.coalesce(F.col("files") > 1, F.lit(False))).alias("unclear"), F.max(~own & F.coalesce(~F.col("package"), F.lit(False))).alias("blocked"), F.max(F.when(own, F.col("file"))).alias("file")
    )
    state = state.select("module", F.when(F.col("unclear") | ((F.col("files") == 1) & F.col("blocked")), "ambiguous").when(F.col("files") == 1, "workspace").alias("state"), "file")
    tops = index.select(F.substring_index("module", ".", 1).alias("_top")).distinct().withColumn("_own", F.lit(True))
    known = stdlib.select(F.col("module").alias("_top"), F.lit(True).alias("_std")).distinct()
    dist = packages.groupBy(F.col("top_level").alias("_top")).agg(F.min("distribution").alias("distribution"), F.countDistinct("distribution").alias("_n"))
    at = lambda side: state.select(F.col("module").alias(side), F.col("state").alias(side + "s"), F.col("file").alias(side + "f"))
    j = rows.join(at("_one"), "_one", "left").join(at("_two"), "_two", "left").withColumn("_top", F.substring_index("base", ".", 1))
    j = j.join(tops, "_top", "left").join(known, "_top", "left").join(dist, "_top", "left")
    inside = F.coalesce("_ones", "_twos")
    resolution = F.when(F.col("base").isNull(), "missing").when(inside.isNotNull(), inside).when(F.col("_own") | (F.col("number") > 0), "missing").when(F.col("_std"), "stdlib").when(F.col("_n") == 1, "installed").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    module = F.when(F.col("_ones").isNotNull(), F.col("_one")).otherwise(F.col("base"))
    return j.withColumn("resolution", resolution).select("path", "name", "kind", "ref", "number", "base", "detail", *POSITION, module.alias("resolved_module"), F.when(F.col("resolution") == "workspace", F.coalesce("_onef", "_twof")).alias("resolved_path"), "resolution", F.when(F.col("resolution") == "installed", F.col("distribution")).alias("distribution"))


def export_surface(facts: DataFrame, index: DataFrame, wildcard: bool = False) -> DataFrame:
    """module, path, exports (sorted): what importers can see, so an edit that leaves it alone stops there."""
    names = of(facts, "wildcard-export" if wildcard else "export").groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("exports"))
    return index.select("module", "path").join(names, "path", "left").withColumn("exports", F.coalesce("exports", F.array().cast("array<string>")))


def module_analysis(facts: DataFrame, index: DataFrame, resolved: DataFrame) -> DataFrame:
    """module, path, imports, exports, dependencies and the digest of their surfaces."""
    surfaces = export_surface(facts, index)
    seen = resolved.where("resolution = 'workspace'").select("path", F.col("resolved_path").alias("_d")).distinct().join(surfaces.select(F.col("path").alias("_d"), F.col("module").alias("_m"), F.col("exports").alias("_e")), "_d")
    deps = seen.groupBy("path").agg(F.array_sort(F.collect_list("_m")).alias("dependencies"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "_m", F.array_join("_e", ",")))), ";"), 256).alias("dependency_digest"))
    count = resolved.groupBy("path").agg(F.count(F.lit(1)).alias("imports"))
    return surfaces.join(count, "path", "left").join(deps, "path", "left").select("module", "path", F.coalesce("imports", F.lit(0)).cast("long").alias("imports"), "exports", F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies"), "dependency_digest")


def symbol_index(facts: DataFrame, index: DataFrame) -> DataFrame:
    """module, path, name (qualified), kind, ref (import source), detail, position of all symbols."""
    return of(facts, "symbol").join(index.select("path", "module", "package"), "path").select("module", "package", "path", "name", "kind", "ref", "detail", *POSITION)


def follow_symbols(asked: DataFrame, symbols: DataFrame, index: DataFrame, stdlib: DataFrame, packages: DataFrame, hops: int = HOPS) -> DataFrame:
    """asked (module, name) with outcome, target_module, target_name and trail: aliases are followed through re-exports, HOPS at most.

    A name that comes back, or a longer chain, is ambiguous; a name that a module lacks is looked for behind its wildcard imports:
    one provider is a hop, several are ambiguous.  One join a hop, over the names that are still on their way.
    """
    top = symbols.where(~F.col("name").contains("."))
    own = index.select(F.col("path").alias("_p"), F.col("module").alias("_m"), "package")
    source, level = F.split("ref", ":").getItem(0), F.length(F.regexp_extract("ref", r"^(\.*)", 1))
    bare = F.regexp_replace(source, r"^\.+", "")
    parts = F.split("_m", r"\.")
    keep = F.size(parts) - level + F.col("package").cast("int")
    # `import a.b` names a module; `from m import n` names n in m.
    to = F.when(level == 0, source).when(keep > 0, F.concat_ws(".", F.array_join(F.slice(parts, 1, keep), "."), F.nullif(bare, F.lit("")))).otherwise(bare)
    defs = top.drop("package").join(own, F.col("path") == F.col("_p")).select("module", "name", "kind", to.alias("to_module"), F.when(F.col("ref").contains(":"), F.split("ref", ":").getItem(1)).alias("to_name"))
    defs = first_wins(defs, ["module", "name", "to_module"], ["kind"])
    direct = defs.where("name <> '*'").select(F.col("module").alias("_dm"), F.col("name").alias("_dn"), F.col("kind").alias("_k"), "to_module", "to_name")
    direct = table_of(direct)
    wild = defs.where("name = '*'").select(F.col("module").alias("_dm"), F.col("to_module").alias("_w")).distinct()
    provided = wild.join(direct.select(F.col("_dm").alias("_w"), F.col("_dn")), "_w").groupBy("_dm", "_dn").agg(F.count(F.lit(1)).alias("_n"), F.min("_w").alias("_w")).withColumnsRenamed({"_dm": "_wm", "_dn": "_wn"})
    mods = index.groupBy("module").agg(F.count(F.lit(1)).alias("_files")).withColumnRenamed("module", "_mm")
    std = stdlib.select(F.col("module").alias("_t")).distinct().withColumn("_std", F.lit(True))
    dist = packages.select(F.col("top_level").alias("_t")).distinct().withColumn("_inst", F.lit(True))
    at = asked.select("module", "name").distinct().withColumns({"target_module": F.col("module"), "target_name": F.col("name"), "outcome": F.lit(None).cast("string"), "trail": F.array().cast("array<string>")})
    done = None
    for hop in range(hops + 1):
        j = at.join(direct, (F.col("target_module") == F.col("_dm")) & (F.col("target_name") == F.col("_dn")), "left")
        j = j.join(provided, (F.col("target_module") == F.col("_wm")) & (F.col("target_name") == F.col("_wn")) & F.col("_k").isNull(), "left")
        j = j.join(mods, F.col("target_module") == F.col("_mm"), "left").withColumn("_t", F.substring_index("target_module", ".", 1)).join(std, "_t", "left").join(dist, "_t", "left")
        here = F.concat_ws(":", "target_module", "target_name")
        again = F.array_contains("trail", here)
        alias = F.col("_k").isin("from_import_alias", "import_alias")
        outcome = F.when(again, "ambiguous").when(F.col("target_name").isNull() & F.col("_mm").isNotNull(), "workspace").when(F.col("_mm").isNull() & F.col("_std"), "stdlib").when(F.col("_mm").isNull() & F.col("_inst"), "installed").when(F.col("_mm").isNull(), "missing")
        outcome = outcome.when(F.col("_files") > 1, "ambiguous").when(F.col("_k").isNotNull() & ~alias, "workspace").when(F.col("_n") > 1, "ambiguous").when(F.col("_k").isNull() & F.col("_w").isNull(), "missing").when(F.lit(hop >= hops), "ambiguous")
        j = j.withColumn("outcome", outcome).withColumn("trail", F.when(again, F.col("trail")).otherwise(F.array_append("trail", here)))
        # A table a hop, so that plans don't grow with the length of chains.
        j = table_of(j.select("module", "name", "outcome", "target_module", "target_name", "trail", "to_module", "to_name", "_w", "_k"))
        ended = j.where("outcome is not null").select("module", "name", "outcome", "target_module", "target_name", "trail")
        done = ended if done is None else done.unionByName(ended)
        at = j.where("outcome is null").select("module", "name", F.coalesce("to_module", "_w").alias("target_module"), F.when(F.col("_k").isNull(), F.col("target_name")).otherwise(F.col("to_name")).alias("target_name"), F.lit(None).cast("string").alias("outcome"), "trail")
        if hop < hops and at.isEmpty():
            break
    return done


def references(facts: DataFrame, index: DataFrame, followed: DataFrame) -> DataFrame:
    """target_module, target_name, path, position of every occurrence that means a workspace symbol: by its own name in its module, or by
    the local alias of an import that leads to it; distinct, in order of path and place."""
    used = of(facts, "occurrence").where("scope = 0").join(index.select("path", "module"), "path").select("path", "module", "name", "flag", *POSITION)
    goal = followed.where("outcome = 'workspace' and target_name is not null").select("module", "name", "target_module", "target_name")
    return used.join(goal, ["module", "name"]).select("target_module", "target_name", "path", *POSITION, "flag").distinct()


def symbol_at(facts: DataFrame, places: DataFrame) -> DataFrame:
    """places (path, line, char) with the innermost occurrence or attribute that holds them: name, kind, scope."""
    spans = facts.where(F.col("relation").isin("occurrence", "attribute") & (F.col("line") == F.col("end_line"))).select("path", F.col("line").alias("_l"), F.col("char").alias("_s"), (F.col("end_char") + 1).alias("_e"), "name", F.col("kind").alias("how"), "scope")
    found = range_join(places.select("path", F.col("line").alias("_l"), F.col("char").alias("_at")), spans, "_at", "_s", "_e", ["path", "_l"], 16)
    return innermost(found, ["path", "_l", "_at"], "_s", "_e").select("path", F.col("_l").alias("line"), F.col("_at").alias("char"), "name", "how", "scope", F.col("_s").alias("start"), (F.col("_e") - 1).alias("end"))


def highlights(facts: DataFrame, places: DataFrame) -> DataFrame:
    """All occurrences in the same file of the binding at each place, with whether they write; also the ranges to edit together."""
    at = symbol_at(facts, places).where("how in ('load', 'store', 'delete')").select("path", F.col("line").alias("at_line"), F.col("char").alias("at_char"), "name", "scope")
    every = of(facts, "occurrence").select("path", "name", "scope", F.col("kind").alias("how"), *POSITION)
    return at.join(every, ["path", "name", "scope"]).withColumn("write", F.col("how") == "store")


def selection_chain(facts: DataFrame, places: DataFrame) -> DataFrame:
    """Ranges that hold a place, from the innermost outward, numbered."""
    from pyspark.sql import Window

    spans = facts.where(F.col("relation").isin("occurrence", "attribute", "call", "argument", "fold", "scope") & F.col("line").isNotNull()).select("path", *POSITION).distinct()
    p = places.select("path", F.col("line").alias("at_line"), F.col("char").alias("at_char"))
    after = (F.col("line") < F.col("at_line")) | ((F.col("line") == F.col("at_line")) & (F.col("char") <= F.col("at_char")))
    before = (F.col("end_line") > F.col("at_line")) | ((F.col("end_line") == F.col("at_line")) & (F.col("end_char") >= F.col("at_char")))
    held = p.join(spans, "path").where(after & before)
    size = [F.col("end_line") - F.col("line"), F.col("end_char") - F.col("char")]
    return held.withColumn("depth", F.row_number().over(Window.partitionBy("path", "at_line", "at_char").orderBy(*size)) - 1)


def code_lenses(facts: DataFrame, index: DataFrame, followed: DataFrame) -> DataFrame:
    """module, name, references: how often each top-level function and class occurs beyond its declaration, imports included."""
    own = of(facts, "symbol").where("kind in ('function', 'class')").join(index.select("path", "module"), "path").where(~F.col("name").contains(".")).select("module", "name", "path", *POSITION)
    n = references(facts, index, followed).groupBy(F.col("target_module").alias("module"), F.col("target_name").alias("name")).agg((F.count(F.lit(1)) - 1).alias("references"))
    return own.join(n, ["module", "name"], "left").withColumn("references", F.coalesce("references", F.lit(0)).cast("long"))


def call_edges(facts: DataFrame, index: DataFrame, followed: DataFrame) -> DataFrame:
    """caller_module, caller, callee_module, callee, path, position: calls whose callee is a workspace symbol; incoming and outgoing calls are its two sides."""
    calls = of(facts, "call").join(index.select("path", "module"), "path").select("path", "module", F.col("ref").alias("caller"), "name", *POSITION)
    goal = followed.where("outcome = 'workspace'").select("module", "name", F.col("target_module").alias("callee_module"), F.col("target_name").alias("callee"))
    return calls.join(goal, ["module", "name"]).select(F.col("module").alias("caller_module"), "caller", "callee_module", "callee", "path", *POSITION)


def type_edges(facts: DataFrame, index: DataFrame, followed: DataFrame) -> DataFrame:
    """module, class, base_module, base, pos: supertypes one hop up; subtypes are the same edges read the other way.  base_module is null where it can't be resolved."""
    bases = of(facts, "base").join(index.select("path", "module"), "path").select("module", F.col("name").alias("class"), F.col("ref").alias("name"), F.col("number").alias("pos"))
    goal = followed.where("outcome = 'workspace'").select("module", "name", F.col("target_module").alias("base_module"), F.col("target_name").alias("_base"))
    return bases.join(goal, ["module", "name"], "left").select("module", "class", "base_module", F.coalesce("_base", "name").alias("base"), "pos")


def class_models(facts: DataFrame, index: DataFrame, followed: DataFrame, depth: int = HOPS) -> DataFrame:
    """module, class, member, kind, definer: own and inherited members; the shallowest definer wins, then the first from left to right."""
    from .graph import flatten_classes

    name = lambda m, c: F.concat_ws(":", m, c)
    bases = type_edges(facts, index, followed).where("base_module is not null").select(name("module", "class").alias("class"), name("base_module", "base").alias("base"), F.col("pos").cast("int").alias("pos"))
    own = first_wins(of(facts, "member").join(index.select("path", "module"), "path").select(name("module", "name").alias("class"), F.col("ref").alias("member"), "kind", "line", "char"), ["class", "member"], ["line", "char"])
    own = table_of(own)
    flat = flatten_classes(table_of(bases), own.select("class", "member"), depth)
    return flat.join(own.select(F.col("class").alias("definer"), "member", "kind"), ["definer", "member"]).select(F.substring_index("class", ":", 1).alias("module"), F.substring_index("class", ":", -1).alias("class"), "member", "kind", "definer", "depth")


def rename(refs: DataFrame, module: str, name: str, new: str) -> DataFrame:
    """path, position, new_text: the edits that rename a symbol everywhere; aliases keep their own name."""
    hit = refs.where((F.col("target_module") == module) & (F.col("target_name") == name) & (F.col("line") == F.col("end_line")) & (F.col("end_char") - F.col("char") == len(name)))
    return hit.select("path", *POSITION, F.lit(new).alias("new_text")).distinct()


def moved_imports(resolved: DataFrame, moves: DataFrame) -> DataFrame:
    """path, position, old_module, new_module: imports of modules that moves (old_module, new_module) rename; new is null for deletions."""
    return resolved.join(moves, F.col("base") == F.col("old_module")).select("path", *POSITION, "old_module", "new_module")


def document_links(resolved: DataFrame) -> DataFrame:
    """path, position, target: imports that lead to a workspace file."""
    return resolved.where("resolved_path is not null").select("path", *POSITION, F.col("resolved_path").alias("target"))


def parameters(facts: DataFrame, index: DataFrame) -> DataFrame:
    return of(facts, "parameter").join(index.select("path", "module"), "path").select(F.col("module").alias("callee_module"), F.col("name").alias("callee"), F.col("ref").alias("parameter"), F.col("number").alias("pos"), F.col("detail").alias("annotation"))


def inlay_hints(facts: DataFrame, index: DataFrame, followed: DataFrame) -> DataFrame:
    """path, position, parameter: the names of parameters beside positional arguments of calls to workspace functions."""
    arguments = of(facts, "argument").where("number >= 0 and not flag").join(index.select("path", "module"), "path").select("path", "module", "name", F.col("number").alias("pos"), *POSITION)
    goal = followed.where("outcome = 'workspace'").select("module", "name", F.col("target_module").alias("callee_module"), F.col("target_name").alias("callee"))
    return arguments.join(goal, ["module", "name"]).join(parameters(facts, index), ["callee_module", "callee", "pos"]).select("path", *POSITION, "parameter")


def signature_help(facts: DataFrame, index: DataFrame, followed: DataFrame) -> DataFrame:
    """path, position of a call, callee, signature."""
    signatures = of(facts, "symbol").where("kind in ('function', 'method')").join(index.select("path", "module"), "path").select(F.col("module").alias("callee_module"), F.col("name").alias("callee"), F.col("detail").alias("signature"))
    return call_edges(facts, index, followed).join(signatures, ["callee_module", "callee"]).select("path", *POSITION, "callee_module", "callee", "signature")


def completions(facts: DataFrame, path: str, prefix: str, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """(names of a file with a prefix, in order, at most `limit`; whether there are more, as one row)."""
    names = of(facts, "binding").where((F.col("path") == path) & F.col("name").startswith(prefix)).groupBy("name").agg(F.min("kind").alias("kind"))
    return names.orderBy("name").limit(limit), names.limit(limit + 1).agg((F.count(F.lit(1)) > limit).alias("incomplete"))


def semantic_tokens(facts: DataFrame) -> DataFrame:
    """path, delta_line, delta_char, length, kind: occurrences in order, each place relative to the one before."""
    from pyspark.sql import Window

    kind = F.when(F.col("ref").isin("function", "class", "parameter"), F.col("ref")).when(F.col("ref").isin("import_alias", "from_import_alias"), "namespace").when(F.col("ref") == "type_parameter", "typeParameter").otherwise("variable")
    at = of(facts, "occurrence").where("line = end_line").groupBy("path", "line", "char", "end_char").agg(F.min(kind).alias("kind"))
    w = Window.partitionBy("path").orderBy("line", "char")
    step = F.col("line") - F.coalesce(F.lag("line").over(w), F.lit(0))
    return at.select("path", "line", "char", step.alias("delta_line"), F.when(step == 0, F.col("char") - F.coalesce(F.lag("char").over(w), F.lit(0))).otherwise(F.col("char")).alias("delta_char"), (F.col("end_char") - F.col("char")).alias("length"), "kind")


def type_definitions(facts: DataFrame, index: DataFrame, followed: DataFrame) -> DataFrame:
    """path, position, name, target_module, target_name: annotated bindings and the workspace class that their annotation names."""
    annotated = of(facts, "binding").where("detail is not null and kind in ('variable', 'parameter')").join(index.select("path", "module"), "path").select("path", "module", F.col("name").alias("binding"), F.regexp_extract("detail", r"^['\"]?([\w.]+)", 1).alias("name"), *POSITION)
    goal = followed.where("outcome = 'workspace'").select("module", "name", "target_module", "target_name")
    return annotated.join(goal, ["module", "name"]).select("path", *POSITION, F.col("binding").alias("name"), "target_module", "target_name")


def declarations(facts: DataFrame) -> DataFrame:
    """path, name, scope, position of each binding's first declaration."""
    return of(facts, "binding").select("path", "name", "scope", "kind", *POSITION)


# Diagnostics

SEVERITY = {"error": 3, "warning": 2, "information": 1, "hint": 0}
DIAGNOSTIC = ["path", "code", "message", "severity", *POSITION]


def _diagnostic(rows: DataFrame, code: str, severity: str, message: Column) -> DataFrame:
    return rows.select("path", F.lit(code).alias("code"), message.alias("message"), F.lit(severity).alias("severity"), *POSITION)


def unused_imports(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """`from` imports of workspace modules that their file neither uses nor exports: not in __init__ files, files with errors, `x as x` or star imports."""
    local = F.coalesce("detail", "name")
    asked = resolved.where("kind = 'from' and resolution = 'workspace' and name <> '*'").where(~F.col("path").rlike(r"(^|/)__init__\.py$") & ~F.coalesce(F.col("detail") == F.col("name"), F.lit(False))).withColumn("local", local)
    used = of(facts, "occurrence").where("kind <> 'store' and scope = 0").select("path", F.col("name").alias("local")).distinct()
    broken = of(facts, "syntax-error").select("path").distinct()
    explicit = of(facts, "wildcard-export").join(of(facts, "export").where("name = '__all__'").select("path").distinct(), "path").select("path", F.col("name").alias("local")).distinct()
    elsewhere = resolved.where("kind = 'from' and resolved_path is not null").select(F.col("resolved_path").alias("path"), F.col("name").alias("local")).distinct()
    left = asked.join(used, ["path", "local"], "left_anti").join(broken, "path", "left_anti").join(explicit, ["path", "local"], "left_anti").join(elsewhere, ["path", "local"], "left_anti")
    return _diagnostic(left, "unused-import", "hint", F.concat(F.lit("unused import: "), F.col("local")))


def module_diagnostics(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Syntax errors, imports that are missing or ambiguous, exports that aren't static."""
    errors = _diagnostic(of(facts, "syntax-error"), "syntax-error", "error", F.col("name"))
    shown = F.concat(F.lit("import "), F.coalesce("resolved_module", "ref"))
    missing = _diagnostic(resolved.where("resolution = 'missing'"), "missing-import", "error", F.concat(shown, F.lit(" isn't found")))
    unclear = _diagnostic(resolved.where("resolution = 'ambiguous'"), "ambiguous-import", "warning", F.concat(shown, F.lit(" is ambiguous")))
    impure = _diagnostic(of(facts, "impure"), "dynamic-exports", "information", F.col("name"))
    return errors.unionByName(missing).unionByName(unclear).unionByName(impure)


def dependency_diagnostics(status: DataFrame, path: str) -> DataFrame:
    """Of dependency statuses (name, specifier, version, status) that aren't satisfied."""
    bad = status.where("status <> 'satisfied'").withColumns({"path": F.lit(path), **{c: F.lit(None).cast("long") for c in POSITION}})
    message = F.concat_ws(" ", F.col("name"), F.nullif(F.col("specifier"), F.lit("")), F.lit("is"), F.regexp_replace("status", "_", " "))
    return bad.select("path", F.concat(F.lit("dependency-"), F.regexp_replace("status", "_", "-")).alias("code"), message.alias("message"), F.lit("warning").alias("severity"), *POSITION)


def dedupe(diagnostics: DataFrame) -> DataFrame:
    """Each diagnostic once, by path, code, message, severity and place."""
    return diagnostics.dropDuplicates(DIAGNOSTIC)


def in_order(diagnostics: DataFrame) -> DataFrame:
    """By path, place (those without one first), code and message."""
    at = lambda c: F.coalesce(F.col(c), F.lit(-1))
    return diagnostics.orderBy("path", at("line"), at("char"), "code", "message")


def gate(diagnostics: DataFrame, fail_on: str) -> bool:
    """Whether any diagnostic is at least as severe as fail_on."""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    worst = diagnostics.agg(F.max(rank[F.col("severity")])).first()[0]
    return worst is not None and worst >= SEVERITY[fail_on]


def analyze_workspace(facts: DataFrame, index: DataFrame, resolved: DataFrame, more: list[DataFrame] = ()) -> DataFrame:
    """All diagnostics of a workspace, deduplicated."""
    out = module_diagnostics(facts, resolved).unionByName(unused_imports(facts, resolved))
    for d in more:
        out = out.unionByName(d.select(*DIAGNOSTIC))
    return dedupe(out)


def code_actions(diagnostics: DataFrame, spans: DataFrame) -> DataFrame:
    """Diagnostics whose lines overlap the asked spans (path, from_line, to_line), with what to do about them."""
    title = F.when(F.col("code") == "unused-import", "Remove the import").when(F.col("code") == "missing-import", "Declare the dependency")
    return diagnostics.join(spans, "path").where((F.col("line") <= F.col("to_line")) & (F.col("end_line") >= F.col("from_line"))).withColumn("action", title).where("action is not null")


def reexports(facts: DataFrame, index: DataFrame, resolved: DataFrame) -> DataFrame:
    """module, importers: for each module, the modules that import from it and export the name again."""
    again = resolved.where("kind = 'from' and resolved_path is not null").select("path", F.coalesce("detail", "name").alias("name"), "base").join(of(facts, "wildcard-export").select("path", "name").distinct(), ["path", "name"])
    return again.join(index.select("path", "module"), "path").groupBy(F.col("base").alias("of")).agg(F.array_sort(F.collect_set("module")).alias("importers")).withColumnRenamed("of", "module")


def import_cycles(resolved: DataFrame, index: DataFrame) -> DataFrame:
    """Modules that import themselves by way of others."""
    edges = resolved.where("resolved_path is not null").join(index.select("path", "module"), "path").join(index.select(F.col("path").alias("resolved_path"), F.col("module").alias("dst")), "resolved_path").select(F.col("module").alias("src"), "dst").distinct()
    return cycle_members(edges).withColumnRenamed("node", "module")
