"""The incremental engine: versioned inputs, keyed queries, red/green reuse with backdating.

The driver holds names, versions and counters; rows, differences and answers stay in tables.  A keyed query answers for
many keys in one plan.  After an edit only the keys that the edit can influence are recomputed, and of those only the ones
whose answer moved count as changed for what is built on top.  The answer always equals a fresh evaluation.

A table is a base and steps: a step holds the keys that changed and their rows, so an edit writes what it changes.  Keys
are compared null-safe, rows of a key as a multiset, by 128 bits of hash sums.  A table that is set again from the same plan
over the same files is known to be unchanged without a job.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import tempfile
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import CheckpointIntegrityError, CheckpointManifestError, CheckpointModeError, CheckpointVersionError, CompositionError, CycleError, InputKeyError
from .functions import canon
from .operators.memo import HASHES, hashed, moved_keys, null_safe, plan_probe
from .plans.lint import check_reads, fingerprint, reject_reflection

FORMAT = 2
MODES = ("strict", "checked", "fast")
#: Steps that a table has before it is written anew.
STEPS = 6


@dataclass
class Input:
    """A named versioned relation; `key` identifies its rows (several rows may share one).  At most one policy: `compare` names
    the columns whose change counts (default: all); eq(old, new) -> Column says when a key's two rows count as equal, where
    old and new give the columns of either side by name."""

    name: str
    key: list[str]
    compare: list[str] | None = None
    eq: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None

    def __post_init__(self):
        if type(self.name) is not str or not self.name:
            raise InputKeyError("an input needs a name")
        if self.compare is not None and self.eq is not None:
            raise ValueError("at most one of compare and eq")


@dataclass
class Query:
    """fn(tables) -> DataFrame with the key columns.  keys_of maps a dependency to fn(rows, tables) -> rows with the key
    columns, i.e. the keys that a row can influence; without it every key is dirty when that dependency moves.  cutoff names
    the columns whose change counts; eq as for inputs.  An untracked query runs again in every request."""

    name: str
    key: list[str]
    deps: list[str]
    fn: Callable[[dict[str, DataFrame]], DataFrame]
    keys_of: dict[str, Callable[[DataFrame, dict[str, DataFrame]], DataFrame]] = field(default_factory=dict)
    cutoff: list[str] | None = None
    untracked: str | None = None
    eq: Callable | None = None

    def __post_init__(self):
        if self.cutoff is not None and self.eq is not None:
            raise ValueError("at most one of cutoff and eq")


@dataclass
class _Step:
    """One change of a table: either a whole new base, or keys with `_moved` (whether the change counts) and their rows."""

    keys: str | None = None
    rows: str | None = None
    base: str | None = None


@dataclass
class _Node:
    kind: str
    version: int = 0
    changed_at: int = 0
    verified_at: int = 0
    steps: list[_Step] = field(default_factory=list)
    at: dict[int, int] = field(default_factory=dict)  # version: number of its last step
    count: int = 0
    probe: object = None
    seen: dict[str, int] = field(default_factory=dict)
    code: str = ""
    decision: str = "pending"
    untracked: str | None = None
    last_used: int = 0
    elapsed: list[int] = field(default_factory=list)
    log: DataFrame | None = None


class Engine:
    def __init__(self, spark: SparkSession, mode: str = "strict", max_query_nodes: int | None = None, store_dir: str | None = None, on_error: Callable[[str, Exception], None] | None = None):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.spark, self.mode, self.cap, self.on_error = spark, mode, max_query_nodes, on_error
        self.dir = f"{(store_dir or _shared(spark)).rstrip('/')}/engine-{uuid.uuid4().hex}"
        self.revision = 0
        self.inputs: dict[str, Input] = {}
        self.queries: dict[str, Query] = {}
        self.nodes: dict[str, _Node] = {}
        self.counters = dict.fromkeys(("input_sets", "input_equal_ignores", "query_executions", "query_backdates", "query_reuses", "query_gone", "query_failures", "evictions", "observer_events", "observer_errors", "total_requests"), 0)
        self.observers: dict[int, tuple[str, Callable]] = {}
        self.errors: list[tuple[str, Exception]] = []
        self._lock = threading.RLock()
        self._stack: list[str] = []
        self._events: list[tuple[list[Callable], str, DataFrame]] = []
        self._request = self._span = self._clock = self._tokens = 0
        self._checked: set[str] = set()
        self._cache: dict[tuple[int, str, str], object] = {}
        self._schemas: dict[str, object] = {}  # of own tables, so that reading one needs no look at its files

    # Declarations

    def declare(self, what: Input | Query) -> Input | Query:
        if what.name in self.inputs or what.name in self.queries:
            raise InputKeyError(f"{what.name} is declared already")
        if isinstance(what, Input):
            self.inputs[what.name] = what
        else:
            reject_reflection(what.fn)
            fingerprint(what.fn, [])  # refuses captures without a digest
            self.queries[what.name] = what
        return what

    def query(self, key: list[str], deps: list[str], name: str | None = None, **options):
        """Decorator: declare a function as a query."""

        def wrap(fn):
            if inspect.iscoroutinefunction(fn) or inspect.isgeneratorfunction(fn):
                raise TypeError("a query is a plain function")
            return self.declare(Query(name or f"{fn.__module__}:{fn.__qualname__}", key, deps, fn, **options))

        return wrap

    # Inputs

    def set(self, inp: Input, rows: DataFrame) -> bool:
        """Store a new version unless it equals the current one; whether the revision moved."""
        return self.set_many([(inp, rows)])

    def set_many(self, pairs: list[tuple[Input, DataFrame]]) -> bool:
        """One batch, one revision; no input changes if any write fails."""
        self._outside("set_many")
        if len({i.name for i, _ in pairs}) != len(pairs):
            raise InputKeyError("an input occurs twice in a batch")
        with self._lock:
            staged = []
            for inp, rows in pairs:
                if self.inputs.get(inp.name) is not inp:
                    raise InputKeyError(f"{inp.name} isn't declared")
                probe = plan_probe(rows)
                staged.append((inp.name, probe, *self._stage(inp.name, rows, inp.key, inp.compare, inp.eq, probe=probe)))
            moved = any(m for *_, m, _ in staged)
            if moved:
                self.revision += 1
            for name, probe, step, did, _ in staged:
                node = self.nodes.setdefault(name, _Node("input"))
                self.counters["input_sets"] += 1
                self.counters["input_equal_ignores"] += not did
                self._commit(node, step, did)
                node.probe, node.verified_at = probe, self.revision
            if moved:
                self.request_inputs_changed()
            return moved

    def read_input(self, inp: Input) -> DataFrame:
        if inp.name not in self.nodes:
            raise KeyError(inp.name)
        return self._table(inp.name)

    def upsert(self, inp: Input, rows: DataFrame, deleted: DataFrame | None = None) -> bool:
        """Replace the rows of the keys in rows, and drop the keys in deleted; what isn't named stays.  Whether the revision moved."""
        self._outside("upsert")
        with self._lock:
            if inp.name not in self.nodes:
                return self.set(inp, rows)
            node = self.nodes[inp.name]
            keys = rows.select(*inp.key) if deleted is None else rows.select(*inp.key).unionByName(deleted.select(*inp.key))
            step, did, _ = self._stage(inp.name, rows, inp.key, inp.compare, inp.eq, dirty=self._cut(keys.distinct(), f"{inp.name}-named"))
            self.counters["input_sets"] += 1
            self.counters["input_equal_ignores"] += not did
            self.revision += bool(did)
            self._commit(node, step, did)
            node.probe, node.verified_at = None, self.revision
            if did:
                self.request_inputs_changed()
            return bool(did)

    def _stage(self, name, rows, key, compare, eq, dirty: DataFrame | None = None, probe=None) -> tuple[_Step | None, bool, int]:
        """(the step that makes a table equal rows, whether it counts, changed keys).  With dirty, only these keys are compared."""
        node = self.nodes.get(name)
        fresh = hashed(rows, compare)
        if node is None or not node.steps:
            return _Step(base=self._write(fresh, name)), True, -1
        if dirty is None and probe is not None and node.probe == probe:
            return None, False, 0
        old = self._raw(name)
        if old.columns != fresh.columns:
            return _Step(base=self._write(fresh, name)), True, -1
        if dirty is not None:
            old = null_safe(old, dirty, key, "left_semi")
        keys = self._cut(moved_keys(old, fresh, key, eq), f"{name}-keys")
        n, m = keys.agg(F.count(F.lit(1)), F.sum(F.col("_moved").cast("long"))).first()
        if not n:
            return None, False, 0
        return _Step(keys=keys._tw_path, rows=self._write(null_safe(fresh, keys, key, "left_semi"), name)), bool(m), n

    def _commit(self, node: _Node, step: _Step | None, counts: bool) -> None:
        if step is not None:
            node.steps.append(step)
        if counts:
            node.version += 1
            node.changed_at = self.revision
        if step is not None or counts:
            node.at[node.version] = len(node.steps)

    # Demand

    def get(self, name: str) -> DataFrame:
        """The query's current answer."""
        self._outside("get")
        with self.request_span():
            self._ensure(name)
            return self._table(name)

    @contextmanager
    def request_span(self):
        """Calls inside share one request: every query is verified once.  The thread that opened it owns it; others wait."""
        with self._lock:
            if self._span == 0:
                self._request += 1
                self.counters["total_requests"] += 1
                self._checked, self._cache = set(), {}
            self._span += 1
            try:
                yield self
            finally:
                self._span -= 1
                if self._span == 0:
                    self._evict()
                    self._dispatch()

    def once_per_request(self, name: str, fn: Callable[[DataFrame], object]):
        """fn(answer of name), computed once in a request and version."""
        with self.request_span():
            self._ensure(name)
            key = (self.nodes[name].version, name, fingerprint(fn, []))
            if key not in self._cache:
                self._cache[key] = fn(self._table(name))
            return self._cache[key]

    def request_inputs_changed(self) -> None:
        """What this request has verified must be verified again."""
        self._checked, self._cache = set(), {}

    def report_untracked_read(self, reason: str) -> None:
        """Called in a query: its answer depends on something undeclared, so it runs again in every request."""
        if not self._stack:
            raise RuntimeError("report_untracked_read outside of a query")
        self._reported = reason

    def _outside(self, what: str) -> None:
        if self._stack:
            raise CompositionError(f"{what} inside a query")

    def _ensure(self, name: str) -> None:
        if name in self.inputs:
            if name not in self.nodes:
                raise KeyError(name)
            return
        if name in self._stack:
            raise CycleError(" -> ".join([*self._stack[self._stack.index(name) :], name]))
        if name not in self.queries:
            raise KeyError(name)
        q = self.queries[name]
        if name in self._checked and name in self.nodes:
            self.nodes[name].last_used = self._tick()
            return
        self._stack.append(name)
        try:
            for d in q.deps:
                self._ensure(d)
            began = time.perf_counter_ns()
            self._reported = None
            try:
                self._verify(q)
            except Exception:
                self.counters["query_failures"] += 1
                if name in self.nodes:
                    self.nodes[name].decision = "failed"
                raise
            node = self.nodes[name]
            node.untracked = q.untracked or self._reported
            node.elapsed.append(time.perf_counter_ns() - began)
        finally:
            self._stack.pop()
        self._checked.add(name)

    def _tick(self) -> int:
        self._clock += 1
        return self._clock

    def maybe_changed_after(self, name: str, revision: int) -> bool:
        """Whether the answer, verified now, moved after a revision."""
        with self.request_span():
            self._ensure(name)
            node = self.nodes[name]
            return node.changed_at > revision or bool(node.untracked)

    def _verify(self, q: Query) -> None:
        node = self.nodes.get(q.name)
        code = fingerprint(q.fn, [q.key, q.cutoff, q.eq, *q.keys_of.values()])
        now = {d: self.nodes[d].version for d in q.deps}
        if node is None or node.code != code or set(node.seen) != set(now):
            return self._cold(q, code, now)
        node.last_used = self._tick()
        moved = [d for d in q.deps if node.seen[d] != now[d]]
        if not moved and not node.untracked:
            node.verified_at, node.decision = self.revision, "reused"
            self.counters["query_reuses"] += node.count
            return
        if node.untracked or any(d not in q.keys_of for d in moved) or any(not self._reaches(d, node.seen[d]) for d in moved):
            return self._step(q, node, now, None)
        old = {d: self._table(d, node.seen[d]) if self._reaches(d, node.seen[d]) else self._table(d) for d in q.deps}
        new = {d: self._table(d) for d in q.deps}
        dirty = None
        for d in moved:
            keys = self._changed(d, node.seen[d])
            if set(q.key) <= set(self._key(d)) and q.keys_of[d](new[d], new) is new[d]:
                # A row influences the key it carries, which the changed keys name already.
                found = keys.select(*q.key)
                dirty = found if dirty is None else dirty.unionByName(found)
                continue
            since = self.nodes[d].steps[self.nodes[d].at[node.seen[d]] :]
            one = self._read(since[0].rows).drop(*HASHES) if len(since) == 1 and d in self.inputs else new[d]
            for rows in (null_safe(old[d], keys, self._key(d), "left_semi"), null_safe(one, keys, self._key(d), "left_semi")):
                # With several inputs moved, either state of the others may link a row to a key.
                for world in (old, new) if len(moved) > 1 else (new,):
                    found = q.keys_of[d](rows, world).select(*q.key)
                    dirty = found if dirty is None else dirty.unionByName(found)
        self._step(q, node, now, self._cut(dirty.distinct(), f"{q.name}-dirty"))

    def _reaches(self, name: str, version: int) -> bool:
        """Whether the steps from a version to now are all differences."""
        x = self.nodes[name]
        return version in x.at and all(s.keys for s in x.steps[x.at[version] :])

    def _changed(self, name: str, version: int) -> DataFrame:
        """Keys that counted as changed since a version."""
        x, out = self.nodes[name], None
        for s in x.steps[x.at[version] :]:
            keys = self._read(s.keys).where("_moved").select(*self._key(name))
            out = keys if out is None else out.unionByName(keys)
        return out if len(x.steps) - x.at[version] == 1 else out.distinct()

    def _evaluate(self, q: Query, dirty: DataFrame | None) -> DataFrame:
        tables = {d: self._table(d) for d in q.deps}
        if dirty is not None:
            whole = dict(tables)
            for d, keys_of in q.keys_of.items():
                keys = keys_of(whole[d], whole)
                if keys is whole[d]:
                    tables[d] = null_safe(whole[d], dirty, q.key, "left_semi")
                else:  # rows that can influence a dirty key, each once
                    own = self._key(d)
                    aside = [c for c in own if c not in keys.columns]
                    if aside:
                        raise InputKeyError(f"keys_of {d} drops {aside}")
                    wanted = null_safe(keys, dirty, q.key, "left_semi").select(*own).distinct()
                    tables[d] = null_safe(whole[d], wanted, own, "left_semi")
        out = q.fn(tables)
        if self.mode != "fast":
            check_reads(out, [self.dir, *(s for d in q.deps for x in self.nodes[d].steps for s in (x.base, x.rows, x.keys) if s)], refuse_unstable=not (q.untracked or self._reported))
        return out if dirty is None else null_safe(out, dirty, q.key, "left_semi")

    def _cold(self, q: Query, code: str, now: dict[str, int]) -> None:
        base = self._write(hashed(self._evaluate(q, None), q.cutoff, q.key), q.name)
        self.revision += 1
        previous = self.nodes.get(q.name)
        node = self.nodes[q.name] = _Node("query", code=code, seen=dict(now), version=(previous.version if previous else 0) + 1, steps=[_Step(base=base)])
        node.at[node.version] = 1
        node.changed_at = node.verified_at = self.revision
        node.decision, node.last_used = "executed", self._tick()
        node.count = self._read(base).select(*q.key).distinct().count()
        self.counters["query_executions"] += node.count
        self._tell(q.name, self._read(base).select(*q.key).distinct().withColumn("decision", F.lit("executed")))

    def _step(self, q: Query, node: _Node, now: dict[str, int], dirty: DataFrame | None) -> None:
        fresh = self._cut(hashed(self._evaluate(q, dirty), q.cutoff, q.key), f"{q.name}-fresh")
        old = self._raw(q.name)
        if fresh.columns != old.columns:
            return self._cold(q, node.code, now)
        if dirty is not None:
            old = null_safe(old, dirty, q.key, "left_semi")
        log = self._cut(moved_keys(old, fresh, q.key, q.eq, every=True), f"{q.name}-log")
        count = {r[0]: (r[1], r[2]) for r in log.groupBy("decision").agg(F.count(F.lit(1)), F.sum(F.col("_changed").cast("long"))).collect()}
        size = {k: v[0] for k, v in count.items()}
        executed, gone = size.get("executed", 0) + size.get("new", 0), size.get("gone", 0)
        reused = node.count - (size.get("executed", 0) + size.get("backdated", 0) + gone)
        for k, v in (("query_executions", executed), ("query_backdates", size.get("backdated", 0)), ("query_gone", gone), ("query_reuses", max(0, reused))):
            self.counters[k] += v
        node.count += size.get("new", 0) - gone
        decisions = log.select(*q.key, F.when(F.col("decision") == "new", "executed").otherwise(F.col("decision")).alias("decision"))
        node.seen = dict(now)
        rest = null_safe(self._table(q.name).select(*q.key).distinct(), log, q.key, "left_anti").withColumn("decision", F.lit("reused"))
        node.log = decisions.unionByName(rest)
        # All keys that were looked at with their fresh rows: those that came out equal are replaced by themselves.
        changed = sum(v[1] or 0 for v in count.values())
        step = _Step(keys=log._tw_path, rows=fresh._tw_path) if changed else None
        if executed or gone:
            self.revision += 1
            node.decision = "executed"
            self._commit(node, step, True)
            self._tell(q.name, decisions.where("decision in ('executed', 'gone')"))
        else:
            node.decision = "backdated" if size.get("backdated") else "reused"
            self._commit(node, step, False)
        node.verified_at = self.revision

    # Observation

    def observe(self, name: str, callback: Callable[[str, DataFrame], None]) -> Callable[[], None]:
        """callback(query, keys and decisions) after each request in which the stored answer moved; returns the unsubscriber.
        A callback that raises reaches on_error, or the list `errors`; it stops neither the request nor other callbacks."""
        self._outside("observe")
        self._tokens += 1
        token = self._tokens
        self.observers[token] = (name, callback)
        return lambda: self.observers.pop(token, None)

    def _tell(self, name: str, changes: DataFrame) -> None:
        """Queue an event for those who observe now."""
        to = [callback for n, callback in self.observers.values() if n == name]
        if to:
            self._events.append((to, name, changes))

    def _dispatch(self) -> None:
        events, self._events = self._events, []
        for to, name, changes in events:
            for callback in to:
                self.counters["observer_events"] += 1
                try:
                    callback(name, changes)
                except Exception as e:  # isolated: one observer's error is no one else's
                    self.counters["observer_errors"] += 1
                    self.on_error(name, e) if self.on_error else self.errors.append((name, e))

    def statistics(self) -> dict[str, int]:
        kinds = [n.kind for n in self.nodes.values()]
        return self.counters | {"revision": self.revision, "query_nodes": kinds.count("query"), "input_nodes": kinds.count("input"), "edges": sum(len(n.seen) for n in self.nodes.values())}

    def reset_statistics(self) -> None:
        self.counters = {k: v if k == "total_requests" else 0 for k, v in self.counters.items()}

    def query_profile(self) -> dict[str, dict[str, int]]:
        return {n: {"count": len(x.elapsed), "total": sum(x.elapsed), "mean": sum(x.elapsed) // len(x.elapsed), "min": min(x.elapsed), "max": max(x.elapsed), "last": x.elapsed[-1]} for n, x in self.nodes.items() if x.elapsed}

    def dependency_graph(self) -> list[tuple[str, list[str]]]:
        return sorted((n, sorted(x.seen)) for n, x in self.nodes.items())

    def last_decisions(self, name: str) -> DataFrame | None:
        """Key and decision of the last step of a query."""
        return self.nodes[name].log

    def inspect(self, name: str) -> dict:
        """Recorded provenance, without verification."""
        x = self.nodes[name]
        return {"name": name, "kind": x.kind, "decision": x.decision, "changed_at": x.changed_at, "verified_at": x.verified_at, "untracked": x.untracked, "dependencies": [self.inspect(d) for d in sorted(x.seen)]}

    def inspect_fresh(self, name: str) -> dict:
        self.get(name)
        return self.inspect(name)

    def explain(self, name: str) -> str:
        def lines(x, depth):
            yield f"{'  ' * depth}{x['kind']} {x['name']}: {x['decision']}, changed at {x['changed_at']}, verified at {x['verified_at']}" + (f", untracked: {x['untracked']}" if x["untracked"] else "")
            for d in x["dependencies"]:
                yield from lines(d, depth + 1)

        return "\n".join(lines(self.inspect(name), 0))

    # Memory

    def _evict(self) -> None:
        held = sorted((n for n, x in self.nodes.items() if x.kind == "query"), key=lambda n: self.nodes[n].last_used)
        while self.cap is not None and len(held) > self.cap:
            del self.nodes[held.pop(0)]
            self.counters["evictions"] += 1

    def vacuum(self) -> int:
        """Delete tables that neither a current answer nor a later difference needs; DataFrames of older answers end with them.  Returns how many went."""
        self._outside("vacuum")
        needed = set()
        for name, x in self.nodes.items():
            oldest = min([len(x.steps), *(x.at[y.seen[name]] for y in self.nodes.values() if y.seen.get(name) in x.at)])
            base = max((i for i, s in enumerate(x.steps[:oldest]) if s.base), default=0)
            needed |= {p for s in x.steps[base:] for p in (s.base, s.rows, s.keys) if p}
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = jvm.Path(self.dir)
        fs, gone = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), 0
        if fs.exists(folder):
            for s in fs.listStatus(folder):
                if s.getPath().getName() not in {p.rsplit("/", 1)[-1] for p in needed}:
                    fs.delete(s.getPath(), True)
                    gone += 1
        for x in self.nodes.values():
            x.log = None
        return gone

    # Checkpoints

    def save_checkpoint(self, path: str) -> str:
        """Copy every current table and a manifest to path/ck<sha256>; returns that name."""
        self._outside("save_checkpoint")
        closed: set[str] = {n for n, x in self.nodes.items() if x.kind == "input"}
        waiting = {n: x for n, x in self.nodes.items() if x.kind == "query" and not x.untracked}
        while True:  # a query is closed once all it has seen is current and closed
            more = {n for n, x in waiting.items() if n not in closed and all(d in closed and v == self.nodes[d].version for d, v in x.seen.items())}
            if not more:
                break
            closed |= more
        nodes = {}
        for n in sorted(closed):
            x = self.nodes[n]
            nodes[n] = {"kind": x.kind, "version": x.version, "seen": x.seen, "code": x.code, "count": x.count, "digest": self._table_digest(self._raw(n))}
        body = {"format": FORMAT, "mode": self.mode, "revision": self.revision, "nodes": nodes}
        name = "ck" + hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
        for n in nodes:
            self._raw(n).write.mode("overwrite").parquet(f"{path}/{name}/{hashlib.sha256(n.encode()).hexdigest()}")
        self.spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}/manifest")
        return name

    def load_checkpoint(self, path: str, name: str) -> None:
        """Validate everything, then take the tables over.  A query whose code differs stays cold.  Inputs that are set already keep
        their rows: what differs from the checkpoint is found and becomes an edit, so restored answers are verified before they
        are reused."""
        self._outside("load_checkpoint")
        body = json.loads(self.spark.read.text(f"{path}/{name}/manifest").first()[0])
        _validate(body, self.mode)
        if name != "ck" + hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest():
            raise CheckpointIntegrityError("manifest")
        staged = {}
        for n, x in body["nodes"].items():
            at = f"{path}/{name}/{hashlib.sha256(n.encode()).hexdigest()}"
            if self._table_digest(self._read(at)) != x["digest"]:
                raise CheckpointIntegrityError(n)
            if n in self.inputs or n in self.queries:
                staged[n] = _Node(x["kind"], version=x["version"], steps=[_Step(base=at)], at={x["version"]: 1}, seen=x["seen"], code=x["code"], count=x["count"], changed_at=body["revision"], verified_at=body["revision"], decision="reused")
        live = {n: self._table(n) for n in self.inputs if n in self.nodes and n in staged}
        self.nodes.update(staged)
        self.revision = max(self.revision, body["revision"])
        if live:
            self.set_many([(self.inputs[n], rows) for n, rows in live.items()])
        self.request_inputs_changed()

    # Tables

    def _key(self, name: str) -> list[str]:
        return self.inputs[name].key if name in self.inputs else self.queries[name].key

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.dir}/{hashlib.sha256(name.encode()).hexdigest()[:16]}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._schemas[path] = df.schema
        return path

    def _read(self, path: str) -> DataFrame:
        known = self._schemas.get(path)
        return self.spark.read.schema(known).parquet(path) if known is not None else self.spark.read.parquet(path)

    def _cut(self, df: DataFrame, name: str) -> DataFrame:
        path = self._write(df, name)
        out = self._read(path)
        out._tw_path = path
        return out

    def _raw(self, name: str, version: int | None = None) -> DataFrame:
        """A table with its hash columns: the last base before a version, with the steps since."""
        x, key = self.nodes[name], self._key(name)
        last = x.at[x.version if version is None else version]
        start = max(i for i in range(last) if x.steps[i].base)
        out = self._read(x.steps[start].base)
        for s in x.steps[start + 1 : last]:
            out = null_safe(out, self._read(s.keys), key, "left_anti").unionByName(self._read(s.rows))
        if version is None and last == len(x.steps) and last - start > STEPS:
            x.steps.append(_Step(keys=self._write(self._read(x.steps[-1].keys).limit(0), name), base=self._write(out, name)))
            x.at[x.version] = len(x.steps)
            return self._read(x.steps[-1].base)
        return out

    def _table(self, name: str, version: int | None = None) -> DataFrame:
        return self._raw(name, version).drop(*HASHES)

    def _table_digest(self, df: DataFrame) -> str:
        """Order-free digest of a table: two sums over row hashes and the row count."""
        r = df.agg(F.count(F.lit(1)), F.sum(F.col(HASHES[0]).cast("decimal(20,0)")), F.sum(F.col(HASHES[1]).cast("decimal(20,0)"))).first()
        return canon.digest([str(x) for x in r])


def _shared(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return "file://" + tempfile.mkdtemp(prefix="tidewell-engine-")
    raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def _validate(body: dict, mode: str) -> None:
    """Refuse a manifest that isn't whole."""
    if not isinstance(body, dict) or set(body) != {"format", "mode", "revision", "nodes"}:
        raise CheckpointManifestError("fields")
    if body["format"] != FORMAT:
        raise CheckpointVersionError(str(body["format"]))
    if body["mode"] != mode:
        raise CheckpointModeError(str(body["mode"]))
    if type(body["revision"]) is not int or body["revision"] < 0 or not isinstance(body["nodes"], dict):
        raise CheckpointManifestError("revision")
    kinds = {"kind": str, "version": int, "seen": dict, "code": str, "count": int, "digest": str}
    for n, x in body["nodes"].items():
        if not isinstance(x, dict) or set(x) != set(kinds) or any(type(x[k]) is not t for k, t in kinds.items()):
            raise CheckpointManifestError(f"{n}: fields")
        if x["kind"] not in ("input", "query") or x["version"] < 1 or len(x["digest"]) != 64:
            raise CheckpointManifestError(f"{n}: values")
        for d, v in x["seen"].items():
            if d not in body["nodes"] or body["nodes"][d]["version"] != v:
                raise CheckpointManifestError(f"{n} isn't closed: {d}")
