"""The queries of this subpackage, by the names the driver registers."""

from __future__ import annotations

from . import bpe, classifier, exact, hosts, html, lines, mixing, neardup, quality, substrings

MODULES = [quality, lines, html, bpe, substrings, classifier, mixing, hosts, neardup, exact]


def queries() -> dict:
    found = {}
    for m in MODULES:
        found.update({name: f for name, f in vars(m).items() if name.startswith("op") and name[2:3].isdigit() and callable(f)})
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
