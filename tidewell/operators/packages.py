"""Installed packages, search paths and requirements as relations over the files of an environment."""

from __future__ import annotations

import os
import platform
import sys
import sysconfig

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import analyze
from ..functions.versions import normalize_name
from ..shipping import ship
from .graph import table_of
from .joins import first_wins

DIST_INFO = r"^([^/]+)-([^/-]+)\.dist-info/"


def site_packages(spark: SparkSession) -> DataFrame:
    """number, path of the running interpreter's package folders."""
    found = list(dict.fromkeys(sysconfig.get_paths()[k] for k in ("purelib", "platlib")))
    return spark.createDataFrame(list(enumerate(found)), "number int, path string")


def marker_environment(spark: SparkSession) -> DataFrame:
    """name, value of the eleven marker variables of the running interpreter."""
    i = sys.implementation
    version = "{}.{}.{}".format(*i.version[:3]) + ("" if i.version.releaselevel == "final" else i.version.releaselevel[0] + str(i.version.serial))
    values = {
        "os_name": os.name, "sys_platform": sys.platform, "platform_machine": platform.machine(), "platform_python_implementation": platform.python_implementation(), "platform_release": platform.release(), "platform_system": platform.system(),
        "platform_version": platform.version(), "python_version": ".".join(platform.python_version_tuple()[:2]), "python_full_version": platform.python_version(), "implementation_name": i.name, "implementation_version": version,
    }
    return spark.createDataFrame(sorted(values.items()), "name string, value string")


def record_names(record: Column) -> Column:
    """Top-level names of a RECORD text: the first part of each listed path that belongs to an importable file."""
    paths = F.transform(F.split(record, "\n"), lambda line: F.regexp_extract(line, r'^"?([^",]+)', 1))
    name = lambda p: F.when(p.contains("/"), F.substring_index(p, "/", 1)).otherwise(F.regexp_extract(p, r"^([^.]+)(\.py|\.[^/]*\.so|\.so|\.pyd)$", 1))
    code = F.filter(paths, lambda p: p.rlike(r"\.(py|pyi|so|pyd)$") & ~p.rlike(r"^(\.\.|/|[^/]*\.(dist-info|data)/)|__pycache__"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(code, name), lambda n: n.rlike(r"^[A-Za-z_]\w*$"))))


def installed(files: DataFrame) -> DataFrame:
    """distribution (normalized), name, version, top_levels, requires, summary, problem from (path, text) of dist-info files relative to a package folder.

    Top levels are those of top_level.txt, else of RECORD, with the distribution's own name where none or a .pth file is listed.
    METADATA without a name or version is a problem.
    """
    f = files.withColumn("dist", F.regexp_extract("path", DIST_INFO, 0)).where("dist <> ''")
    part = lambda n: f.where(F.col("path") == F.concat("dist", F.lit(n)))
    meta = analyze(part("METADATA"), "metadata").withColumn("dist", F.regexp_extract("path", DIST_INFO, 0)).drop("path")
    dists = f.select("dist").distinct()
    tops = part("top_level.txt").select("dist", F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "").alias("listed"))
    record = part("RECORD").select("dist", record_names(F.col("text")).alias("recorded"), F.col("text").rlike(r"(?m)^[^/,]+\.pth,").alias("pth"))
    j = dists.join(meta, "dist", "left").join(tops, "dist", "left").join(record, "dist", "left")
    own = normalize_name(F.coalesce("name", F.regexp_extract("dist", DIST_INFO, 1)))
    fallback = F.when((F.size(F.coalesce("recorded", F.array().cast("array<string>"))) == 0) | F.col("pth"), F.array_sort(F.array_union(F.coalesce("recorded", F.array().cast("array<string>")), F.array(own)))).otherwise(F.col("recorded"))
    levels = F.when(F.size(F.coalesce("listed", F.array().cast("array<string>"))) > 0, F.array_sort("listed")).otherwise(fallback)
    requires = F.filter(F.split(F.coalesce("requires", F.lit("")), "\n"), lambda x: x != "")
    return j.select(own.alias("distribution"), "name", "version", levels.alias("top_levels"), requires.alias("requires"), "summary", F.when(F.col("name").isNull() | F.col("version").isNull(), "metadata-parse-failed").alias("problem"))


def environment_index(packages: DataFrame) -> DataFrame:
    """top_level, distribution, version."""
    return packages.where("problem is null").select(F.explode("top_levels").alias("top_level"), "distribution", "version")


def distributions(packages: DataFrame) -> DataFrame:
    return packages.where("problem is null").select("distribution", "version").distinct()


def import_origin(names: DataFrame, stdlib: DataFrame, index: DataFrame) -> DataFrame:
    """name, origin (stdlib, installed or unknown), distribution, version of importable names."""
    top = F.substring_index("name", ".", 1)
    std = stdlib.select(F.col("module").alias("_t")).distinct().withColumn("_std", F.lit(True))
    dist = first_wins(index, ["top_level"], ["distribution"]).withColumnRenamed("top_level", "_t")
    j = names.withColumn("_t", top).join(std, "_t", "left").join(dist, "_t", "left")
    return j.select("name", F.when(F.col("_std"), "stdlib").when(F.col("distribution").isNotNull(), "installed").otherwise("unknown").alias("origin"), F.when(F.col("_std").isNull(), F.col("distribution")).alias("distribution"), F.when(F.col("_std").isNull(), F.col("version")).alias("version"))


# Search paths and module location


def sys_path(spark: SparkSession) -> DataFrame:
    """number, path as the interpreter has it now; untracked: a query that uses it must say so."""
    return spark.createDataFrame(list(enumerate(p or os.getcwd() for p in sys.path)), "number int, path string")


def search_paths(base: DataFrame, pth: DataFrame) -> DataFrame:
    """number, path: base paths (number, path), each followed by the path lines of its .pth files (folder, file, line, value) in order; first place wins."""
    extra = pth.join(base.select(F.col("path").alias("folder"), "number"), "folder").select("number", "file", "line", F.when(F.col("value").startswith("/"), F.col("value")).otherwise(F.concat("folder", F.lit("/"), "value")).alias("path"))
    every = base.select("number", F.lit("").alias("file"), F.lit(-1).alias("line"), "path").unionByName(extra)
    ranked = first_wins(every, ["path"], ["number", "file", "line"])
    from pyspark.sql import Window

    return ranked.select((F.row_number().over(Window.orderBy("number", "file", "line")) - 1).alias("number"), "path")


def locate(asked: DataFrame, paths: DataFrame, files: DataFrame, depth: int = 16) -> DataFrame:
    """module, kind (package, module, namespace or missing), file: where an import would find each module, component by component.

    Folders are scanned in order; in a folder a package goes before a module, a module before a plain folder.  The first package
    or module wins; plain folders only count where there is neither, and then all of them are searched further.
    files (path) are the files below the search paths, absolute.
    """
    init = files.where(F.col("path").rlike(r"/__init__\.py$")).select(F.regexp_replace("path", r"/__init__\.py$", "").alias("_at"), F.lit(0).alias("_rank"), F.col("path").alias("file"))
    plain = files.where(F.col("path").endswith(".py")).select(F.regexp_replace("path", r"\.py$", "").alias("_at"), F.lit(1).alias("_rank"), F.col("path").alias("file"))
    parents = files.select(F.explode(F.expr("transform(sequence(2, greatest(2, size(split(path, '/')) - 1)), i -> array_join(slice(split(path, '/'), 1, i), '/'))")).alias("_at")).distinct().select("_at", F.lit(2).alias("_rank"), F.lit(None).cast("string").alias("file"))
    entries = init.unionByName(plain).unionByName(parents)
    # Entries right below a search path meet the first components; no module meets a path that lacks it.
    roots = paths.select("number", F.col("path").alias("_dir"))
    first = entries.withColumns({"_dir": F.regexp_replace("_at", r"/[^/]*$", ""), "_name": F.substring_index("_at", "/", -1)}).join(roots, "_dir")
    asked_parts = asked.select("module").distinct().withColumn("_parts", F.split("module", r"\."))
    done, level = None, 0
    while level < depth:
        if level == 0:
            here = asked_parts.withColumn("_name", F.element_at("_parts", 1)).join(first, "_name")
        else:
            here = at.withColumn("_at", F.concat("_dir", F.lit("/"), F.element_at("_parts", level + 1))).join(entries, "_at")
        best = here.groupBy("module").agg(F.min(F.struct((F.col("_rank") == 2).alias("plain"), "number", "_rank")).alias("_best")).withColumnRenamed("module", "_bm")
        kept = here.join(best, F.col("module") == F.col("_bm")).where(F.when(F.col("_best.plain"), F.col("_rank") == 2).otherwise((F.col("number") == F.col("_best.number")) & (F.col("_rank") == F.col("_best._rank"))))
        last = kept.where(F.size("_parts") == level + 1).groupBy("module").agg(F.min("_rank").alias("_rank"), F.min("file").alias("file")).select("module", F.element_at(F.array(F.lit("package"), F.lit("module"), F.lit("namespace")), F.col("_rank") + 1).alias("kind"), "file")
        done = last if done is None else done.unionByName(last)
        at = kept.where((F.size("_parts") > level + 1) & (F.col("_rank") != 1)).select("module", "_parts", "number", F.col("_at").alias("_dir"))
        level += 1
        if at.isEmpty():
            break
    rest = asked.select("module").distinct().join(done.select("module"), "module", "left_anti").select("module", F.lit("missing").alias("kind"), F.lit(None).cast("string").alias("file"))
    return done.unionByName(rest)


def namespace_packages(files: DataFrame) -> DataFrame:
    """name of top-level folders that hold Python files but no __init__ in any search path; files (root, path relative to it)."""
    tops = files.where(F.col("path").contains("/")).select(F.substring_index("path", "/", 1).alias("name"), F.col("path").endswith(".py").alias("py"), F.col("path").rlike(r"^[^/]+/__init__\.py$").alias("init"))
    return tops.groupBy("name").agg(F.max("py").alias("py"), F.max("init").alias("init")).where("py and not init").select("name")


# Requirements


def include_closure(includes: DataFrame, root: str, depth: int = 64) -> DataFrame:
    """path, order, state of the files that `root` includes by (path, number, target), in reading order: what a file includes comes
    before it.  state is ok, or cycle where a file is on its own chain (not read again).

    order is the chain of line numbers from the root, ended by a mark that sorts behind every line, so includes come first.
    """
    spark = includes.sparkSession
    at = spark.createDataFrame([(root, [], [root], "ok")], "path string, chain array<long>, trail array<string>, state string")
    every = at
    for _ in range(depth):
        at = at.where("state = 'ok'").join(includes.select("path", "number", "target"), "path").select(F.col("target").alias("path"), F.array_append("chain", F.col("number").cast("long")).alias("chain"), F.array_append("trail", F.col("target")).alias("trail"), F.when(F.array_contains("trail", F.col("target")), "cycle").otherwise("ok").alias("state"))
        if at.isEmpty():
            break
        every = every.unionByName(at)
    return every.select("path", F.array_append("chain", F.lit(2**62)).alias("order"), "state")


def last_wins(requirements: DataFrame, closure: DataFrame) -> DataFrame:
    """One row a name: of all definitions (path, number, name, ...) in reading order, the last.

    The last number of a name in each file is a hash aggregate, so a task holds names and files, not their lines; the place in
    reading order is looked up for these only, and the winners are joined back to their rows.
    """
    read = closure.where("state = 'ok'").groupBy("path").agg(F.max("order").alias("order"))
    lines = requirements.select("path", "number", "name").groupBy("path", "name").agg(F.max("number").alias("number"))
    last = lines.join(read, "path").groupBy("name").agg(F.max(F.struct("order", "number", "path")).alias("_l"))
    won = table_of(last.select(F.col("name").alias("_n"), F.col("_l.path").alias("_p"), F.col("_l.number").alias("_i")))
    on = (F.col("path") == F.col("_p")) & F.col("name").eqNullSafe(F.col("_n")) & F.col("number").eqNullSafe(F.col("_i"))
    return requirements.join(won, on).drop("_n", "_p", "_i").dropDuplicates(["name"])


def applicable(requirements: DataFrame, installed_versions: DataFrame, environment: dict[str, str]) -> DataFrame:
    """requirements (name, specifier, markers) with status: not_applicable, satisfied, missing, version_mismatch or ambiguous.

    Markers and specifiers are evaluated once a distinct text, then joined back.
    """
    import pandas as pd

    from ..functions.versions import marker_holds, specifier_holds

    ship(requirements.sparkSession)
    holds = F.pandas_udf(lambda s: pd.Series([marker_holds(x, environment)[0] for x in s]), "boolean")
    fits = F.pandas_udf(lambda s, v: pd.Series([bool(specifier_holds(x, y, True)) for x, y in zip(s, v)]), "boolean")
    known = requirements.select("markers").where("markers <> ''").distinct().select("markers", holds("markers").alias("_holds"))
    versions = installed_versions.groupBy(F.col("distribution").alias("name")).agg(F.countDistinct("version").alias("_n"), F.max("version").alias("version"))
    j = requirements.join(known, "markers", "left").join(versions, "name", "left")
    url = F.col("specifier").startswith("@")
    asked = j.where((F.col("specifier") != "") & ~url & F.col("version").isNotNull()).select("specifier", "version").distinct()
    j = j.join(asked.select("specifier", "version", fits("specifier", "version").alias("_fits")), ["specifier", "version"], "left")
    status = F.when(F.col("_holds") == F.lit(False), "not_applicable").when(F.col("_n").isNull(), "missing").when(url | (F.col("specifier") == ""), "satisfied").when(F.col("_n") > 1, "ambiguous").when(F.col("_fits"), "satisfied").otherwise("version_mismatch")
    return j.withColumn("status", status).select(*requirements.columns, "version", "status")


def declared(toml_dependencies: DataFrame, requirements: DataFrame) -> DataFrame:
    """name (normalized), specifier: project dependencies, all optional groups and named requirements, each name once."""
    from_toml = toml_dependencies.where("group <> 'tool'").select(normalize_name(F.regexp_extract("requirement", r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)).alias("name"), F.regexp_replace(F.regexp_extract("requirement", r"^[^;\[]*?(?:\[[^\]]*\])?\s*([=<>!~][^;]*)", 1), r"\s+", "").alias("specifier"))
    named = requirements.where("kind = 'requirement'").select("name", "specifier")
    return first_wins(from_toml.withColumn("_o", F.lit(0)).unionByName(named.withColumn("_o", F.lit(1))), ["name"], ["_o", "specifier"]).drop("_o")


def undeclared_imports(resolved: DataFrame, declared_names: DataFrame) -> DataFrame:
    """distribution, path, line: the first import of each installed distribution that isn't declared, in order of distributions."""
    used = resolved.where("resolution = 'installed'").join(declared_names.select(F.col("name").alias("distribution")), "distribution", "left_anti")
    return used.groupBy("distribution").agg(F.min(F.struct("path", "line")).alias("_f")).select("distribution", "_f.path", "_f.line").orderBy("distribution")
