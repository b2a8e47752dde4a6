"""The query catalogue on the driver's tables, with the equivalent SQL.

Queries named incremental_* go through the engine: a first version, an edit, and the answer after it; their SQL computes
the final state from scratch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, Input, Query
from .functions import calc, documents, python_source, schema, versions
from .functions.canon import row_digest
from .operators import graph, joins, ledger, packages, workspace
from .operators.memo import decide, with_digest
from .operators.reconcile import classify, digests, path_conflicts
from .sources.files import overlay, probe_changes
from .streaming.watch import debounce, tumbling

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        Q[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return wrap


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _edited(orders: DataFrame) -> DataFrame:
    return orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 100 == 0, F.col("o_totalprice") + 10).otherwise(F.col("o_totalprice")))


def _revenue(tables):
    return tables["orders"].groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


def _after_edit(spark: SparkSession, d: str) -> Engine:
    e = Engine(spark)
    orders = e.declare(Input("orders", ["o_orderkey"]))
    e.declare(Query("revenue", ["o_custkey"], ["orders"], _revenue, {"orders": lambda rows, tables: rows}))
    raw = _t(spark, d, "orders")
    e.set(orders, raw)
    e.get("revenue")
    e.set(orders, _edited(raw))
    return e


_EDITED = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 100 = 0 THEN o_totalprice + 10 ELSE o_totalprice END AS p, o_totalprice AS q FROM orders"


@query(f"SELECT o_custkey, round(sum(p), 2) AS total, count(*) AS n FROM ({_EDITED}) GROUP BY o_custkey")
def incremental_agg_localized_edit(spark, d):
    return _after_edit(spark, d).get("revenue")


@query(f"SELECT decision, count(*) AS n FROM (SELECT o_custkey, CASE WHEN max(o_orderkey % 100 = 0) THEN 'executed' ELSE 'reused' END AS decision FROM ({_EDITED}) GROUP BY 1) GROUP BY 1")
def incremental_decisions(spark, d):
    e = _after_edit(spark, d)
    e.get("revenue")
    return e.last_decisions("revenue").groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'groups' AS query, 'backdated' AS decision, 10 AS n, 10 AS customers UNION ALL SELECT 'revenue', 'executed', (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 100 = 0), 0")
def incremental_early_cutoff(spark, d):
    """A second layer over an edited first: the first moves, the second is computed again and comes out equal, so the wave stops."""
    e = Engine(spark)
    orders = e.declare(Input("orders", ["o_orderkey"]))
    e.declare(Query("revenue", ["o_custkey"], ["orders"], _revenue, {"orders": lambda rows, tables: rows}))
    e.declare(Query("groups", ["g"], ["revenue"], lambda t: t["revenue"].groupBy((F.col("o_custkey") % 10).alias("g")).agg(F.count(F.lit(1)).alias("customers")), {"revenue": lambda r, t: r.withColumn("g", F.col("o_custkey") % 10)}))
    raw = _t(spark, d, "orders")
    e.set(orders, raw)
    groups = e.get("groups").count()
    e.set(orders, _edited(raw))
    after = e.get("groups").count()
    log = lambda q, n: e.last_decisions(q).where("decision <> 'reused'").groupBy("decision").agg(F.count(F.lit(1)).alias("n")).select(F.lit(q).alias("query"), "decision", "n", F.lit(n).alias("customers"))
    return log("groups", min(groups, after)).unionByName(log("revenue", 0))


@query("SELECT o_orderstatus, CASE WHEN o_orderstatus IS NULL THEN 9 ELSE 1 END * count(*) AS total FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders) GROUP BY 1")
def incremental_null_keys(spark, d):
    """Rows of a null query key are edited; their answer follows."""
    e = Engine(spark)
    src = e.declare(Input("src", ["o_orderkey"]))
    e.declare(Query("by_status", ["o_orderstatus"], ["src"], lambda t: t["src"].groupBy("o_orderstatus").agg(F.sum("v").alias("total")), {"src": lambda r, t: r}))
    raw = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), F.lit(1).cast("long").alias("v"))
    e.set(src, raw)
    e.get("by_status")
    e.set(src, raw.withColumn("v", F.when(F.col("o_orderstatus").isNull(), F.lit(9)).otherwise(F.col("v")).cast("long")))
    return e.get("by_status")


@query("SELECT l_orderkey, count(*) + count(*) FILTER (l_linenumber = 1) AS n, sum(l_quantity::BIGINT)::BIGINT + coalesce(sum(l_quantity::BIGINT) FILTER (l_linenumber = 1), 0)::BIGINT AS quantity FROM lineitem GROUP BY 1")
def incremental_repeated_rows(spark, d):
    """A table without a usable key; the edit repeats rows that are there already."""
    e = Engine(spark)
    src = e.declare(Input("lines", ["l_orderkey", "l_linenumber"]))
    e.declare(Query("per_order", ["l_orderkey"], ["lines"], lambda t: t["lines"].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity")), {"lines": lambda r, t: r}))
    raw = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    e.set(src, raw)
    e.get("per_order")
    e.set(src, raw.unionByName(raw.where("l_linenumber = 1")))
    return e.get("per_order")


@query("SELECT c_custkey, count(*) FILTER (o_totalprice > 200000.0) AS large FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def shared_input_fanout(spark, d):
    """One small input, a threshold, that every key depends on: moving it makes all keys dirty, and only those whose answer differs move."""
    e = Engine(spark)
    orders, customer, limit = e.declare(Input("orders", ["o_orderkey"])), e.declare(Input("customer", ["c_custkey"])), e.declare(Input("limit", ["k"]))

    def large(t):
        j = t["customer"].join(t["orders"], F.col("c_custkey") == F.col("o_custkey"), "left").join(F.broadcast(t["limit"].agg(F.max("v").alias("v"))))  # one row
        return j.groupBy("c_custkey").agg(F.count(F.when(F.col("o_totalprice") > F.col("v"), 1)).alias("large"))

    e.declare(Query("large", ["c_custkey"], ["orders", "customer", "limit"], large))
    cell = lambda v: spark.range(1).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    e.set_many([(orders, _t(spark, d, "orders")), (customer, _t(spark, d, "customer")), (limit, cell(100000.0))])
    e.get("large")
    e.set(limit, cell(200000.0))
    return e.get("large")


@query("SELECT p_partkey, CASE WHEN floor(p_retailprice / 100) <> floor((p_retailprice + 7) / 100) THEN 'executed' ELSE 'backdated' END AS decision FROM part")
def cutoff_policy(spark, d):
    """Prices move a little; only those that reach another hundred count."""
    e = Engine(spark)
    part = e.declare(Input("part", ["p_partkey"]))
    e.declare(Query("hundreds", ["p_partkey"], ["part"], lambda t: t["part"].select("p_partkey", "p_retailprice", F.floor(F.col("p_retailprice") / 100).alias("hundred")), {"part": lambda r, t: r}, cutoff=["hundred"]))
    raw = _t(spark, d, "part").select("p_partkey", "p_retailprice")
    e.set(part, raw)
    e.get("hundreds")
    e.set(part, raw.withColumn("p_retailprice", F.col("p_retailprice") + 7))
    e.get("hundreds")
    return e.last_decisions("hundreds")


@query(f"SELECT o_custkey, 'executed' AS decision FROM ({_EDITED}) GROUP BY 1 HAVING max(o_orderkey % 100 = 0)")
def observer_changes(spark, d):
    """What an observer is told after an edit."""
    e, told = _after_edit(spark, d), []
    e.observe("revenue", lambda name, changes: told.append(changes))
    e.get("revenue")
    return told[0]


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders WHERE o_orderkey % 50 <> 1 GROUP BY 1")
def checkpoint_roundtrip(spark, d):
    """Answers saved by one engine and taken over by another whose input has moved on: the difference is an edit."""
    import uuid

    first = Engine(spark)
    build = lambda e: (e.declare(Input("orders", ["o_orderkey"])), e.declare(Query("revenue", ["o_custkey"], ["orders"], _revenue, {"orders": lambda rows, tables: rows})))
    raw = _t(spark, d, "orders")
    first.set(build(first)[0], raw)
    first.get("revenue")
    path = f"{first.dir}/checkpoints-{uuid.uuid4().hex}"
    name, second = first.save_checkpoint(path), Engine(spark)
    second.set(build(second)[0], raw.where("o_orderkey % 50 <> 1"))
    second.load_checkpoint(path, name)
    return second.get("revenue")


@query("SELECT 'part ' || p_partkey AS node FROM part WHERE p_size <= 45 UNION ALL SELECT 'supplier ' || s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = s_suppkey AND p_size > 45) UNION ALL SELECT 'nation ' || n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE s_nationkey = n_nationkey AND p_size > 45)")
def checkpoint_closure(spark, d):
    """Nodes a checkpoint may hold: impure parts spoil the suppliers that read them, and their nations."""
    named = lambda kind, c: F.concat(F.lit(kind + " "), F.col(c).cast("string"))
    part, supplier, line, nation = (_t(spark, d, t) for t in ("part", "supplier", "lineitem", "nation"))
    nodes = part.select(named("part", "p_partkey").alias("node"), (F.col("p_size") <= 45).alias("pure")).union(supplier.select(named("supplier", "s_suppkey"), F.lit(True))).union(nation.select(named("nation", "n_nationkey"), F.lit(True)))
    edges = line.select(named("supplier", "l_suppkey").alias("node"), named("part", "l_partkey").alias("reads")).union(supplier.select(named("nation", "s_nationkey"), named("supplier", "s_suppkey"))).distinct()
    return ledger.closed(nodes, edges.withColumn("current", F.lit(True)))


@query("SELECT c_nationkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 <> 0 GROUP BY 1")
def incremental_join_batch(spark, d):
    """Two inputs edited in one batch: deletions on one side, new rows on the other."""
    e = Engine(spark)
    orders, customer = e.declare(Input("orders", ["o_orderkey"])), e.declare(Input("customer", ["c_custkey"]))
    join = lambda o, c: o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    e.declare(Query("by_nation", ["c_nationkey"], ["orders", "customer"], lambda t: join(t["orders"], t["customer"]).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")),
                    {"orders": lambda r, t: join(r, t["customer"]), "customer": lambda r, t: r}))
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    e.set_many([(orders, o), (customer, c.where("c_custkey % 11 <> 0"))])
    e.get("by_nation")
    e.set_many([(orders, o.where("o_orderkey % 7 <> 0")), (customer, c)])
    return e.get("by_nation")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'executed' WHEN doc_id % 10 = 0 THEN 'backdated' ELSE 'reused' END AS decision FROM documents")
def backdate_decisions(spark, d):
    """White space edited on one tenth of the documents, words on another."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    words = lambda x: with_digest(x.select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("w")))
    dirty = docs.where("doc_id % 10 in (0, 3)")
    new = dirty.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("  "))).otherwise(F.concat("text", F.lit(" more"))))
    return decide(words(docs), words(new), dirty, ["doc_id"])


@query("SELECT o_orderkey, sha256('T1;i' || length(o_orderkey::VARCHAR) || ':' || o_orderkey || 's' || length(o_orderstatus) || ':' || o_orderstatus) AS digest FROM orders")
def canonical_digest(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return o.select("o_orderkey", row_digest(o).alias("digest"))


_RECON = """WITH w AS (SELECT 'p' || p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN p_brand || '!' ELSE p_brand END AS v FROM part WHERE p_partkey % 3 <> 0),
l AS (SELECT 'p' || p_partkey AS path, p_brand AS v FROM part WHERE p_partkey % 2 = 0), a AS (SELECT 'p' || p_partkey AS path, CASE WHEN p_partkey % 7 = 0 THEN 'other' ELSE p_brand END AS v FROM part WHERE p_partkey % 11 <> 0)
SELECT path, outcome FROM (SELECT path, CASE WHEN w.v IS NOT NULL AND a.v = w.v THEN 'unchanged' WHEN w.v IS NOT NULL AND a.v IS NULL AND l.v IS NULL THEN 'created' WHEN w.v IS NOT NULL AND a.v IS NULL THEN 'repaired'
WHEN w.v IS NOT NULL AND l.v IS NOT NULL AND a.v <> l.v THEN 'repaired' WHEN w.v IS NOT NULL THEN 'updated' WHEN l.v IS NOT NULL AND a.v = l.v THEN 'deleted' WHEN l.v IS NOT NULL AND a.v IS NOT NULL THEN 'kept' WHEN l.v IS NOT NULL THEN 'released' END AS outcome
FROM w FULL JOIN l USING (path) FULL JOIN a USING (path)) WHERE outcome IS NOT NULL"""


@query(_RECON)
def reconcile_outcomes(spark, d):
    p = _t(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), "p_partkey", "p_brand")
    desired = p.where("p_partkey % 3 <> 0").select("path", F.when(F.col("p_partkey") % 5 == 0, F.concat("p_brand", F.lit("!"))).otherwise(F.col("p_brand")).alias("digest"))
    actual = p.where("p_partkey % 11 <> 0").select("path", F.when(F.col("p_partkey") % 7 == 0, F.lit("other")).otherwise(F.col("p_brand")).alias("digest"))
    return classify(desired, p.where("p_partkey % 2 = 0").select("path", F.col("p_brand").alias("digest")), actual)


@query("SELECT c_name || '/x' AS path, 'collision' AS conflict FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT upper(c_name) || '/x', 'collision' FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT '/' || c_custkey, 'absolute' FROM customer WHERE c_custkey % 50 = 1")
def output_path_conflicts(spark, d):
    """A path a customer, all of them; some come again in capitals, others again with an absolute path."""
    c = _t(spark, d, "customer")
    clashing, absolute = c.where("c_custkey % 50 = 0"), c.where("c_custkey % 50 = 1")
    return path_conflicts(c.select(F.concat("c_name", F.lit("/x")).alias("path")).union(clashing.select(F.concat(F.upper("c_name"), F.lit("/x")))).union(absolute.select(F.concat(F.lit("/"), "c_custkey"))))


@query("SELECT doc_id, sha256(text) AS digest, strlen(text)::BIGINT AS length FROM documents WHERE text IS NOT NULL")
def content_digest(spark, d):
    """Probe and size of every document as a file's content."""
    docs = _t(spark, d, "documents").where("text is not null")
    return digests(docs.select("doc_id", F.encode("text", "UTF-8").alias("content"))).select("doc_id", "digest", F.length("content").cast("long").alias("length"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 13 = 0 THEN 'gone' WHEN o_orderkey % 9 = 0 THEN 'new' WHEN o_orderkey % 5 = 0 THEN 'miss' ELSE 'hit' END AS state FROM orders WHERE NOT (o_orderkey % 13 = 0 AND o_orderkey % 9 = 0)")
def probe_states(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("probe"))
    new = o.where("key % 13 <> 0").withColumn("probe", F.when(F.col("key") % 5 == 0, F.lit("moved")).otherwise(F.col("probe")))
    return probe_changes(o.where("key % 9 <> 0"), new)


_REGIONS = "SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"
_EDGES = f"SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION {_REGIONS}"


def _named(kind: str, c: str):
    return F.concat(F.lit(kind), F.col(c).cast("string"))


def _regions(spark, d) -> DataFrame:
    s, n = _t(spark, d, "supplier"), _t(spark, d, "nation")
    return s.select(_named("s", "s_suppkey").alias("src"), _named("n", "s_nationkey").alias("dst")).union(n.select(_named("n", "n_nationkey"), _named("r", "n_regionkey"))).distinct()


def _edges(spark, d) -> DataFrame:
    """Parts depend on their suppliers, suppliers on nations, nations on regions: all rows of the four tables."""
    return _t(spark, d, "lineitem").select(_named("p", "l_partkey").alias("src"), _named("s", "l_suppkey").alias("dst")).union(_regions(spark, d)).distinct()


@query(f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT * FROM r")
def dependency_closure(spark, d):
    return graph.closure(_edges(spark, d))


@query(f"WITH RECURSIVE e AS ({_REGIONS} UNION SELECT 'r' || r_regionkey, 's' || s_suppkey FROM region JOIN supplier ON s_suppkey % 5 = r_regionkey AND s_acctbal < 0), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT DISTINCT src AS node FROM r WHERE src = dst")
def cycle_members(spark, d):
    """Regions depend in turn on the suppliers in debt that they sponsor."""
    back = _t(spark, d, "region").join(_t(spark, d, "supplier"), (F.col("s_suppkey") % 5 == F.col("r_regionkey")) & (F.col("s_acctbal") < 0)).select(_named("r", "r_regionkey").alias("src"), _named("s", "s_suppkey").alias("dst"))
    return graph.cycle_members(_regions(spark, d).union(back).distinct())


@query(f"SELECT src, string_agg(dst, ',' ORDER BY dst) AS dependencies FROM ({_EDGES}) GROUP BY src")
def dependency_graph_labels(spark, d):
    return graph.labels(_edges(spark, d))


@query("SELECT l_shipdate::DATE AS node, count(*) AS n, sum(q)::BIGINT AS total, min(q) AS least, max(q) AS most, (sum(q) // count(*))::BIGINT AS mean, max_by(q, k) AS last FROM (SELECT *, l_quantity::BIGINT AS q, l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS k FROM lineitem) GROUP BY 1")
def query_profile(spark, d):
    """Line items as timings of nodes, one a shipping day."""
    key = F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    timings = _t(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("node"), F.col("l_quantity").cast("long").alias("took"), key.alias("at"))
    return ledger.profile(timings, ["node"], "took", "at")


@query("SELECT decision, count(*) AS n FROM (SELECT o_custkey, CASE WHEN max(o_orderkey % 100 = 0) THEN 'executed' ELSE 'reused' END AS decision FROM orders GROUP BY 1) GROUP BY 1 UNION ALL SELECT 'cold', count(DISTINCT o_custkey) FROM orders")
def statistics_counters(spark, d):
    """The engine's own counters over a cold run and an edit."""
    e = Engine(spark)
    orders = e.declare(Input("orders", ["o_orderkey"]))
    e.declare(Query("revenue", ["o_custkey"], ["orders"], _revenue, {"orders": lambda rows, tables: rows}))
    raw = _t(spark, d, "orders")
    e.set(orders, raw)
    e.get("revenue")
    cold = e.statistics()["query_executions"]
    e.reset_statistics()
    e.set(orders, _edited(raw))
    e.get("revenue")
    s = e.statistics()
    return spark.createDataFrame([("cold", cold), ("executed", s["query_executions"]), ("reused", s["query_reuses"])], "decision string, n long")


@query("SELECT user_id, max(ts) AS used, row_number() OVER (ORDER BY max(ts) DESC, user_id) > 100 AS evicted FROM events GROUP BY 1")
def lru_eviction(spark, d):
    """Events as touches of nodes; the 100 nodes touched last stay."""
    return ledger.evicted(_t(spark, d, "events"), "user_id", "ts", 100)


@query("SELECT ts::DATE AS request, user_id, event_type, min(event_id) AS first, count(*) - 1 AS repeats FROM events GROUP BY 1, 2, 3")
def once_per_request(spark, d):
    """Events as calls, a request a day: the first of equal calls works."""
    return ledger.once(_t(spark, d, "events").withColumn("request", F.col("ts").cast("date")), "request", ["user_id", "event_type"], "event_id")


@query("SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM events)) GROUP BY user_id, run")
def watcher_debounce(spark, d):
    return debounce(_t(spark, d, "events"), "user_id", "ts", 3600)


@query("SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, coalesce(b.v, a.v) AS v FROM (SELECT p_partkey, p_brand AS v FROM part WHERE p_partkey % 4 <> 0) a FULL JOIN (SELECT p_partkey, p_type AS v FROM part WHERE p_partkey % 6 = 0) b USING (p_partkey)")
def snapshot_overlay(spark, d):
    p = _t(spark, d, "part")
    return overlay(p.where("p_partkey % 4 <> 0").select("p_partkey", F.col("p_brand").alias("v")), p.where("p_partkey % 6 = 0").select("p_partkey", F.col("p_type").alias("v")), "p_partkey", "v")


@query("SELECT s_suppkey, regexp_replace(lower(s_name), '[-_.#]+', '_', 'g') AS name FROM supplier")
def normalized_names(spark, d):
    return _t(spark, d, "supplier").select("s_suppkey", versions.normalize_name(F.regexp_replace("s_name", "#", "-")).alias("name"))


@query("SELECT p_partkey, p_partkey % 7 >= 3 OR (p_partkey % 7 = 2 AND p_size >= 10) AS at_least FROM part")
def version_compare(spark, d):
    v = F.concat_ws(".", (F.col("p_partkey") % 7).cast("string"), F.col("p_size").cast("string"), F.lit("0"))
    return _t(spark, d, "part").select("p_partkey", (versions.release_key(v) >= versions.release_key(F.lit("2.10"))).alias("at_least"))


@query("SELECT event_id::VARCHAR AS path, '<root>' AS section, k AS key, CASE json_type(props, '$.' || k) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL)")
def json_sections(spark, d):
    e = _t(spark, d, "events").where("props is not null").select(F.col("event_id").cast("string").alias("path"), F.col("props").alias("text"))
    return documents.analyze(e, "json").select("path", "section", "key", "type")


@query("SELECT n_nationkey::VARCHAR AS path, 'KEY_' || n_nationkey AS key, n_name AS value FROM nation")
def env_entries(spark, d):
    n = _t(spark, d, "nation")
    text = F.concat(F.lit("# nation\nexport KEY_"), "n_nationkey", F.lit('="'), "n_name", F.lit('" # note\n'))
    return documents.analyze(n.select(F.col("n_nationkey").cast("string").alias("path"), text.alias("text")), "env").select("path", "key", "value")


@query("SELECT p_partkey::VARCHAR AS path, 'pkg_' || p_partkey AS name, '>=' || p_size || '.0' AS specifier, CASE WHEN p_partkey % 2 = 0 THEN 'python_version >= \"3.9\"' ELSE '' END AS markers FROM part")
def requirements_parse(spark, d):
    p = _t(spark, d, "part")
    text = F.concat(F.lit("-i https://example.com\nPkg-"), "p_partkey", F.lit(" >= "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.lit('.0 ; python_version >= "3.9"  # why')).otherwise(F.lit(".0 # why")))
    return documents.analyze(p.select(F.col("p_partkey").cast("string").alias("path"), text.alias("text")), "requirements").where("kind = 'requirement'").select("path", "name", "specifier", "markers")


@query("SELECT s_suppkey::VARCHAR AS path, CASE WHEN i = 0 THEN 'r' ELSE 'r.i' END AS element, CASE WHEN i = 0 THEN '' ELSE s_name END AS text FROM supplier, (VALUES (0), (1)) v(i)")
def xml_elements(spark, d):
    s = _t(spark, d, "supplier")
    return documents.analyze(s.select(F.col("s_suppkey").cast("string").alias("path"), F.concat(F.lit("<r><i k='1'> "), "s_name", F.lit("</i></r>")).alias("text")), "xml").select("path", "element", "text")


@query("SELECT conv_id::VARCHAR AS path, turn AS number, 'markdown' AS kind, role AS heading FROM conversations")
def notebook_cells(spark, d):
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.expr("transform(array_sort(collect_list(struct(turn, role))), x -> struct('markdown' as cell_type, concat('# ', x.role, '\n') as source))").alias("cells"))).alias("text"))
    first = _t(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.min("turn").alias("least"))
    cells = documents.analyze(c.select(F.col("conv_id").cast("string").alias("path"), "text"), "notebook")
    return cells.join(first, "path").select("path", (F.col("number") + F.col("least")).alias("number"), "kind", "heading")


@query("SELECT o_orderkey, CASE WHEN p IS NULL THEN 'missing' WHEN p % 3 = 0 THEN 'version_mismatch' ELSE 'satisfied' END AS status FROM (SELECT o_orderkey, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey END AS p FROM orders)")
def dependency_check(spark, d):
    o = _t(spark, d, "orders")
    declared = o.select(F.concat(F.lit("k"), "o_orderkey").alias("name"), F.lit(">=1.1,<2").alias("specifier"))
    installed = o.where("o_custkey % 4 <> 0").select(F.concat(F.lit("k"), "o_orderkey").alias("name"), F.when(F.col("o_custkey") % 3 == 0, F.lit("1.0.9")).otherwise(F.lit("1.10")).alias("version"))
    return documents.dependency_status(declared, installed).select(F.substring("name", 2, 20).cast("long").alias("o_orderkey"), "status")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 10 < 4 THEN 'workspace' WHEN l_partkey % 10 = 4 THEN 'ambiguous' WHEN l_partkey % 10 < 7 THEN 'stdlib' WHEN l_partkey % 10 < 9 THEN 'installed' ELSE 'missing' END AS resolution FROM lineitem")
def import_resolution(spark, d):
    m = F.concat(F.lit("m"), (F.col("l_partkey") % 10).cast("string"))
    rows = lambda ns: spark.createDataFrame([(f"m{n}", f"m{n}") for n in ns], "module string, path string")
    return documents.resolve_imports(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", m.alias("module")), rows([0, 1, 2, 3, 4, 4]), rows([5, 6]).select("module"), rows([7, 8]).toDF("top_level", "distribution")).drop("module")


@query("SELECT 'c' || p_partkey AS class, m AS member, CASE WHEN m = 'size' AND p_partkey % 3 <> 0 THEN 'base' ELSE 'c' || p_partkey END AS definer FROM part, (VALUES ('size'), ('own')) v(m)")
def class_flatten(spark, d):
    p = _t(spark, d, "part").select(F.concat(F.lit("c"), "p_partkey").alias("class"), "p_partkey")
    bases = p.select("class", F.lit("base").alias("base"), F.lit(0).alias("pos"))
    members = p.select("class", F.lit("own").alias("member")).union(p.where("p_partkey % 3 = 0").select("class", F.lit("size"))).union(spark.createDataFrame([("base", "size")]))
    return graph.flatten_classes(bases, members).where("class <> 'base'").drop("depth")


@query("SELECT 's' || s_suppkey AS name, CASE WHEN s_suppkey % 20 > 8 THEN 'ambiguous' ELSE 'workspace' END AS outcome FROM supplier")
def symbol_follow(spark, d):
    s = _t(spark, d, "supplier")
    nxt = F.when(F.col("s_suppkey") % 20 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), (F.col("s_suppkey") - 1).cast("string")))
    return graph.follow(s.select(F.concat(F.lit("s"), "s_suppkey").alias("name"), nxt.alias("next"))).select("name", "outcome")


@query("SELECT doc_id, (len(string_split(text, chr(10))))::BIGINT AS lines, length(text)::BIGINT AS points, strlen(text)::BIGINT AS bytes, (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))::BIGINT AS units FROM documents WHERE text IS NOT NULL")
def source_geometry(spark, d):
    """Lengths of every document in lines, code points, UTF-8 bytes and UTF-16 units."""
    docs = _t(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), python_source.points(F.col("text")).alias("points"), python_source.utf8_units(F.col("text")).alias("bytes"), python_source.utf16_units(F.col("text")).alias("units"))


@query("SELECT c_nationkey::VARCHAR AS path, count(*) + 1 AS lines, 2::BIGINT AS columns FROM customer GROUP BY 1")
def csv_shape(spark, d):
    """The customers of each nation rendered as CSV text, then analyzed."""
    c = _t(spark, d, "customer")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda r: F.concat(r["c_custkey"].cast("string"), F.lit(',"'), r["c_name"], F.lit('"'))), "\n")
    found = documents.analyze(c.groupBy(F.col("c_nationkey").cast("string").alias("path")).agg(F.concat(F.lit("key,name\n"), rows).alias("text")), "csv")
    size = found.where("kind = 'rows'").select("path", "number").join(found.where("kind = 'column'").groupBy("path").agg(F.count(F.lit(1)).alias("columns"), F.max((F.col("name") == "key").cast("int")).alias("header")), "path")
    return size.select("path", (F.col("number") + F.col("header")).alias("lines"), "columns")


@query("SELECT doc_id, len(regexp_extract_all(regexp_replace(coalesce(text, ''), '\\\\\n', '', 'g'), '[^\n]+'))::BIGINT AS lines FROM documents")
def logical_lines(spark, d):
    """Lines with something in them after backslash continuations are joined."""
    joined = versions.logical_lines(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(F.filter(joined, lambda x: x != "")).cast("long").alias("lines"))


@query("SELECT p_partkey, p_size >= 10 AND p_size < 40 AND p_size <> 25 AND p_partkey % 2 = 0 AS holds FROM part")
def specifier_eval(spark, d):
    """>=1.10,<1.40,!=1.25 against 1.<size>, or 0.<size> for every other part, which is below the range."""
    p = _t(spark, d, "part")
    version = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("1.")).otherwise(F.lit("0.")), F.col("p_size").cast("string"))
    return p.select("p_partkey", versions.specifier_column(">=1.10,<1.40,!=1.25", version).alias("holds"))


@query("SELECT p_partkey, p_brand = 'Brand#1' OR (contains('Brand#2 Brand#3', p_brand) AND p_size >= 10) AS holds FROM part")
def marker_eval(spark, d):
    """A marker over variables that are columns, compiled to one expression."""
    p = _t(spark, d, "part")
    marker = "os_name == 'Brand#1' or (os_name in 'Brand#2 Brand#3' and python_version >= '3.10')"
    return p.select("p_partkey", versions.marker_column(marker, {"os_name": F.col("p_brand"), "python_version": F.concat(F.lit("3."), F.col("p_size").cast("string"))}).alias("holds"))


@query("SELECT 'pkg' || l_suppkey AS distribution, min(l_orderkey)::VARCHAR AS path FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0 GROUP BY 1")
def undeclared_imports(spark, d):
    """Line items as imports of their supplier's package; suppliers with money are declared."""
    name = F.concat(F.lit("pkg"), F.col("l_suppkey").cast("string"))
    used = _t(spark, d, "lineitem").select(name.alias("distribution"), F.col("l_orderkey"), F.lit("installed").alias("resolution"))
    declared = _t(spark, d, "supplier").where("s_acctbal >= 0").select(F.concat(F.lit("pkg"), F.col("s_suppkey").cast("string")).alias("name"))
    found = packages.undeclared_imports(used.select("distribution", F.col("l_orderkey").alias("path"), F.lit(0).cast("long").alias("line"), "resolution"), declared)
    return found.select("distribution", F.col("path").cast("string").alias("path"))


@query("SELECT 'b' || substr(p_brand, 7) || '_' || p_size AS name FROM part GROUP BY p_brand, p_size HAVING NOT bool_or(p_retailprice > 1500)")
def namespace_packages(spark, d):
    """Parts as files of a folder a brand and size; dear ones are its __init__."""
    p = _t(spark, d, "part")
    folder = F.concat(F.lit("b"), F.substring("p_brand", 7, 10), F.lit("_"), F.col("p_size").cast("string"))
    return packages.namespace_packages(p.select(F.concat(folder, F.when(F.col("p_retailprice") > 1500, F.lit("/__init__.py")).otherwise(F.concat(F.lit("/m"), F.col("p_partkey").cast("string"), F.lit(".py")))).alias("path")))


@query("SELECT o_orderkey, 'e' || (o_orderkey * 10 + w) AS name FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS w FROM orders)")
def symbol_at_containment(spark, d):
    """Two spans a line, one within the other; the innermost that holds each place."""
    o = _t(spark, d, "orders")
    span = lambda n, start, end: o.select(F.col("o_orderkey").alias("line"), F.lit(start).alias("_s"), F.lit(end).alias("_e"), F.concat(F.lit("e"), (F.col("o_orderkey") * 10 + n).cast("string")).alias("name"))
    places = o.select(F.col("o_orderkey").alias("line"), F.when(F.col("o_orderkey") % 3 == 0, 35).otherwise(70).alias("at"))
    found = joins.range_join(places, span(1, 0, 100).union(span(2, 30, 40)), "at", "_s", "_e", ["line"], 16)
    return joins.innermost(found, ["line", "at"], "_s", "_e").select(F.col("line").alias("o_orderkey"), "name")


_EVENT_BEFORE = "SELECT e.event_id, coalesce(max(p.event_id), -1) AS since FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.event_id <= e.event_id GROUP BY 1"


@query(_EVENT_BEFORE)
def binding_as_of(spark, d):
    """For every event its user's latest purchase so far, -1 for none."""
    e = _t(spark, d, "events").select("event_id", "user_id", "event_type")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("since"))
    return joins.as_of(e, right, ["user_id"], "event_id", "since", ["since"]).select("event_id", F.coalesce("since", F.lit(-1).cast("long")).alias("since"))


@query("SELECT coalesce(nation.n_regionkey, -1) AS n_regionkey, coalesce(nation.n_nationkey, -1) AS n_nationkey, count(*) AS n, CASE WHEN nation.n_regionkey IS NULL THEN 3 WHEN nation.n_nationkey IS NULL THEN 1 ELSE 0 END::BIGINT AS level FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (nation.n_regionkey, nation.n_nationkey)")
def rollup_counts(spark, d):
    j = _t(spark, d, "nation").join(_t(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = joins.subtotals(j, ["n_regionkey", "n_nationkey"], F.count(F.lit(1)).alias("n"))
    return out.select(*[F.coalesce(c, F.lit(-1)).alias(c) for c in ("n_regionkey", "n_nationkey")], "n", "level")


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def common_keys(spark, d):
    return joins.common(_t(spark, d, "orders").select(F.col("o_custkey").alias("k")), _t(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k")))


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_orderpriority = o.o_orderpriority)")
def correlated_mean(spark, d):
    return joins.above_own_mean(_t(spark, d, "orders"), ["o_orderpriority"], "o_totalprice").select("o_orderkey")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_counts(spark, d):
    """Tumbling windows of a day."""
    out = tumbling(_t(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")), "at", "1 day", ["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT name, max_by(version, rank) AS version FROM (SELECT 'pkg' || (o_custkey % 97) AS name, o_orderkey::VARCHAR AS version, (CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END)::BIGINT * 10000000000 + o_orderkey AS rank FROM orders) GROUP BY 1")
def requirements_include_lastwins(spark, d):
    """Orders as requirement lines of three files, of which the last includes the first two; the last definition of a name wins."""
    o = _t(spark, d, "orders")
    file = F.when(F.col("o_orderstatus") == "F", "a.txt").when(F.col("o_orderstatus") == "O", "b.txt").otherwise("root.txt")
    rows = o.select(file.alias("path"), F.col("o_orderkey").alias("number"), F.concat(F.lit("pkg"), (F.col("o_custkey") % 97).cast("string")).alias("name"), F.col("o_orderkey").cast("string").alias("version"))
    includes = spark.createDataFrame([("root.txt", -2, "a.txt"), ("root.txt", -1, "b.txt")], "path string, number long, target string")
    return packages.last_wins(rows, packages.include_closure(includes, "root.txt")).select("name", "version")


@query("WITH RECURSIVE v AS (SELECT p_partkey AS k, p_size::BIGINT AS value FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT p_partkey, value + p_size FROM v JOIN part ON p_partkey = k + 1 AND p_partkey % 10 <> 0) SELECT 'v' || k AS name, value FROM v")
def calc_evaluate(spark, d):
    """Chains of ten bindings, one a part: each adds its size to the one before."""
    p = _t(spark, d, "part")
    before = F.when(F.col("p_partkey") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("v"), (F.col("p_partkey") - 1).cast("string"), F.lit(" + ")))
    table = p.select(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("name"), F.concat(before, F.col("p_size").cast("string")).alias("expression"))
    return calc.evaluate(table).where("problem is null").select("name", "value")


@query("SELECT 'schema' || s_suppkey AS path, 'Supplier' || s_suppkey AS name, f AS field, CASE f WHEN 'key' THEN 'int' WHEN 'nation' THEN 'str | None' ELSE 'list[float]' END AS type, f = 'key' AS required FROM supplier, (VALUES ('key'), ('nation'), ('balances')) v(f)")
def codegen_fields(spark, d):
    """A schema a supplier; the fields of its model."""
    s = _t(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit('{"$defs": {"Supplier'), k, F.lit('": {"type": "object", "required": ["key"], "properties": {"key": {"type": "integer"}, "nation": {"type": ["string", "null"]}, "balances": {"type": "array", "items": {"type": "number"}}}}}}'))
    rows = schema.compile_schemas(s.select(F.concat(F.lit("schema"), k).alias("path"), text.alias("text")))
    return rows.where("kind = 'field'").select("path", "name", "field", "type", "required")


@query("SELECT 'm' || l_suppkey || '.py' AS path, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'warning' END AS severity FROM lineitem GROUP BY ALL")
def diagnostics_dedupe_gate(spark, d):
    """Line items as diagnostics with repeats; each stays once, and the gate sees the errors."""
    rows = _t(spark, d, "lineitem").select(F.concat(F.lit("m"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("path"), F.lit("code").alias("code"), F.lit("").alias("message"), F.when(F.col("l_returnflag") == "R", "error").otherwise("warning").alias("severity"), F.col("l_linenumber").alias("line"), *[F.lit(0).alias(c) for c in ("char", "end_line", "end_char")])
    found = workspace.dedupe(rows)
    return found.where(F.lit(workspace.gate(found, "error"))).select("path", "line", "severity")


def _sources(spark, d) -> DataFrame:
    """A workspace with a module a nation and a package a region: nations import their region's base class and one another."""
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    k, g = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    prev = F.when(F.col("n_nationkey") > 0, F.concat(F.lit("from .nation"), (F.col("n_nationkey") - 1).cast("string"), F.lit(" import total as before\n"))).otherwise("before = None\n")
    text = F.concat(F.lit("import os, requests\nfrom app.region"), g, F.lit(" import Base\n"), prev, F.lit("\n\nclass Nation"), k, F.lit("(Base):\n    key = "), k, F.lit("\n\n\ndef total(x):\n    return os.path.join(x, Base, before(x))\n"))
    nations = n.select(F.concat(F.lit("app/nation"), k, F.lit(".py")).alias("path"), text.alias("text"))
    g = F.col("r_regionkey").cast("string")
    regions = r.select(F.concat(F.lit("app/region"), g, F.lit("/__init__.py")).alias("path"), F.lit("from .base import Base\n").alias("text")).union(r.select(F.concat(F.lit("app/region"), g, F.lit("/base.py")), F.concat(F.lit("class Base:\n    region = "), g, F.lit("\n    def name(self):\n        return self.region\n"))))
    return nations.union(regions).union(spark.createDataFrame([("app/__init__.py", "")], "path string, text string"))


def _workspace(spark, d):
    facts = graph.table_of(python_source.facts(_sources(spark, d)))
    index = workspace.modules(_sources(spark, d))
    std = spark.createDataFrame([("os",)], "module string")
    installed = spark.createDataFrame([("requests", "requests")], "top_level string, distribution string")
    return facts, index, std, installed


@query("SELECT 'app/nation' || n_nationkey || '.py' AS path, m AS module, r AS resolution FROM nation, (VALUES ('os', 'stdlib'), ('requests', 'installed')) v(m, r) UNION ALL SELECT 'app/nation' || n_nationkey || '.py', 'app.region' || n_regionkey, 'workspace' FROM nation UNION ALL SELECT 'app/nation' || n_nationkey || '.py', 'app.nation' || (n_nationkey - 1), 'workspace' FROM nation WHERE n_nationkey > 0 UNION ALL SELECT 'app/region' || r_regionkey || '/__init__.py', 'app.region' || r_regionkey || '.base', 'workspace' FROM region")
def workspace_imports(spark, d):
    """Absolute and relative imports of a whole workspace, resolved."""
    facts, index, std, installed = _workspace(spark, d)
    return workspace.resolve(facts, index, std, installed).select("path", F.col("resolved_module").alias("module"), "resolution")


@query("SELECT 'app.region' || n_regionkey || '.base' AS target_module, 'app/nation' || n_nationkey || '.py' AS path, 3 AS uses FROM nation UNION ALL SELECT 'app.region' || r_regionkey || '.base', 'app/region' || r_regionkey || '/' || f, 1 FROM region, (VALUES ('__init__.py'), ('base.py')) v(f)")
def find_references(spark, d):
    """Occurrences of each region's base class: its declaration, its re-export, and import, base and argument in every nation."""
    facts, index, std, installed = _workspace(spark, d)
    followed = workspace.follow_symbols(workspace.symbol_index(facts, index).select("module", "name"), workspace.symbol_index(facts, index), index, std, installed)
    base = workspace.references(facts, index, followed).where("target_name = 'Base'")
    return base.groupBy("target_module", "path").agg(F.count(F.lit(1)).cast("int").alias("uses"))


@query("SELECT 'Nation' || n_nationkey AS class, m AS member, CASE m WHEN 'key' THEN 0 ELSE 1 END AS depth FROM nation, (VALUES ('key'), ('name'), ('region')) v(m) UNION ALL SELECT 'Base', m, 0 FROM region, (VALUES ('name'), ('region')) v(m)")
def class_models(spark, d):
    """Own and inherited members of every class of the workspace."""
    facts, index, std, installed = _workspace(spark, d)
    followed = workspace.follow_symbols(workspace.symbol_index(facts, index).select("module", "name"), workspace.symbol_index(facts, index), index, std, installed)
    return workspace.class_models(facts, index, followed).select("class", "member", "depth")
