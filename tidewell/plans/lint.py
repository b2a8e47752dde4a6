"""Checks of query functions and plans before they run, and fingerprints of their code and captures."""

from __future__ import annotations

import dis
import hashlib
import re
import sys
import types
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..errors import UnsupportedValueError, UntrackedReadError
from ..functions import canon

REFLECTIVE = {"globals", "locals", "vars", "eval", "exec", "compile", "__import__"}
_UNSTABLE = re.compile(r"\b(rand|randn|uuid|current_timestamp|now|current_date|monotonically_increasing_id|input_file_name|shuffle)\(", re.I)


def reject_reflection(fn) -> None:
    """Refuse functions that read names dynamically or import in their body."""
    for i in dis.get_instructions(fn):
        if i.opname in ("LOAD_GLOBAL", "LOAD_NAME") and i.argval in REFLECTIVE:
            raise UntrackedReadError(f"{fn.__qualname__} uses {i.argval}")
        if i.opname == "IMPORT_NAME" and i.argval.split(".")[0] not in sys.stdlib_module_names:
            raise UntrackedReadError(f"{fn.__qualname__} imports in its body")


@dataclass
class Capture:
    """A value that a function takes from outside: closure, default or global."""

    name: str
    where: str
    kind: str
    accepted: bool


def _outside(fn) -> list[tuple[str, str, object]]:
    """(name, where, value) of what a function takes from outside, its nested functions included."""
    names: set[str] = set()

    def walk(code):
        names.update(code.co_names)
        for c in code.co_consts:
            if isinstance(c, types.CodeType):
                walk(c)

    walk(fn.__code__)
    out = []
    for name, cell in zip(fn.__code__.co_freevars, fn.__closure__ or ()):
        try:
            out.append((name, "closure", cell.cell_contents))
        except ValueError:
            out.append((name, "closure", None))  # not bound yet: a recursive function
    out += [(f"default {i}", "default", v) for i, v in enumerate(fn.__defaults__ or ())]
    out += [(k, "default", v) for k, v in (fn.__kwdefaults__ or {}).items()]
    return out + [(n, "global", fn.__globals__[n]) for n in sorted(names) if n in fn.__globals__]


def _code(code: types.CodeType) -> list:
    return [code.co_code, list(code.co_names), list(code.co_varnames), [_code(c) if isinstance(c, types.CodeType) else repr(c) for c in code.co_consts]]


def _digestible(value, seen: set[int]):
    """A plain value that stands for a captured one; refuses what has none."""
    if isinstance(value, types.ModuleType):
        return ["module", value.__name__, str(getattr(value, "__version__", ""))]
    if isinstance(value, types.FunctionType):
        return ["function", *_function(value, seen)]
    if isinstance(value, types.MethodType):
        return ["method", *_function(value.__func__, seen), _digestible(value.__self__, seen)]
    if isinstance(value, (type, types.BuiltinFunctionType)):
        return ["class", value.__module__ or "", value.__qualname__, [_function(f, seen) for _, f in sorted(vars(value).items()) if isinstance(f, types.FunctionType)] if isinstance(value, type) and value.__module__ not in sys.builtin_module_names and not value.__module__.startswith("pyspark") else []]
    if isinstance(value, DataFrame):
        raise UntrackedReadError("a captured DataFrame is a source that isn't declared")
    if isinstance(value, Column):
        return ["column", str(value)]
    try:
        return ["value", canon.encode(value)]
    except UnsupportedValueError as e:
        raise UntrackedReadError(f"a captured {type(value).__name__} has no digest") from e


def _function(fn, seen: set[int]) -> list:
    if id(fn) in seen:
        return [fn.__qualname__]
    seen.add(id(fn))
    if (fn.__module__ or "").split(".")[0] in sys.stdlib_module_names or (fn.__module__ or "").startswith("pyspark"):
        return [fn.__module__, fn.__qualname__]
    return [_code(fn.__code__), [[n, where, _digestible(v, seen)] for n, where, v in _outside(fn)]]


def fingerprint(fn, extra: list) -> str:
    """Digest of a function's code, of all it takes from outside (helpers with theirs), and of policies."""
    if not isinstance(fn, types.FunctionType):
        raise UntrackedReadError(f"{fn!r} isn't a plain function")
    seen: set[int] = set()
    return hashlib.sha256(canon.encode([list(sys.version_info[:2]), _function(fn, seen), [_function(x, seen) if isinstance(x, types.FunctionType) else x for x in extra]])).hexdigest()


def captures(fn) -> list[Capture]:
    """What a function takes from outside, and whether each can be part of a fingerprint."""
    out = []
    for name, where, value in _outside(fn):
        try:
            _digestible(value, set())
            ok = True
        except UntrackedReadError:
            ok = False
        out.append(Capture(name, where, type(value).__name__, ok))
    return out


def check_reads(df: DataFrame, allowed: list[str], refuse_unstable: bool = True) -> None:
    """Refuse a plan that reads files outside the declared sources, or that isn't a function of them."""
    plain = lambda p: re.sub("/+", "/", p.removeprefix("file:")).rstrip("/")
    roots = [plain(a) for a in allowed]
    plan = df._jdf.queryExecution().analyzed()
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            found = leaf.relation().location().rootPaths()
            for k in range(found.size()):
                p = plain(found.apply(k).toString())
                if not any(p == r or p.startswith(r + "/") for r in roots):
                    raise UntrackedReadError(p)
    found = _UNSTABLE.search(plan.toString()) if refuse_unstable else None
    if found:
        raise UntrackedReadError(f"{found[1]} isn't a function of the inputs")
