"""Operator 9, near-duplicate documents: chosen-path set similarity join.

A document is its set of distinct shingles, of 3 words unless the caller asks for another length.  Documents with equal sets
become one class first.  Classes carry T minwise tokens.  In each of several trees a node chooses two token positions and
branches its members by the tokens they have there; nodes of at most LIMIT members are compared exhaustively by their
tokens, larger ones branch again.  With similarity s a node keeps a pair on a branch with probability s, so a tree finds a
pair with probability q = 1 - (1 - s q)^2 at any depth: 0.969 at 0.85, where it takes five trees, and 0.9375 at 0.8, where
it takes six, to miss fewer than one pair in 10^7 if trees were independent.  They share their T tokens below the root;
with that, and with the bound on common tokens, about one pair in 500,000 at the threshold itself is missed, and far fewer
above it.  A node that keeps most of its parent's members is dense (copies of one another): it is taken as one candidate
group as it is.

The comparisons make candidate groups; they only have to be supersets of the true components.  Within a group, links are
confirmed on the full shingle sets, every pair that could reach the threshold and isn't already connected, so no link is
lost to the order of comparison.  A group beyond GROUP_SHINGLES or GROUP_MEMBERS first meets a few leaders, one after the
other, each compared with all members that no leader has linked yet: of a true cluster that takes most members, at the
cost of one comparison each.  Then the group is cut into blocks, and each pair of blocks is a task of its own, but for pairs
of blocks that one leader links, which are connected already.  Links are kept as forests; components() joins them across
groups and blocks.  What stays quadratic are large groups whose members are alike enough to be candidates (about 0.6) and
mostly not linked; no pair of them is left out.

Defined cases: null or wordless text has n_shingles 0 and is its own component.  One or two words make one shingle.
Repeated rows and equal texts share a class, however many there are.  Rows that share a doc_id count as one document.
A row with a null id takes the smallest id of its class, and stays (kept) only if the class has none.  Very long texts are
handled whole, one at a time.  Columns other than doc_id and text are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .batches import changes, slices, whole_groups
from .common import cut, free_shuffles, join_groups, table
from .graph import components
from .words import Words, mix, windows

T = 64  # minwise tokens a class has
BRANCHES = 2
LIMIT = 400  # members of a node that are compared exhaustively
DEPTH = 8
DENSE = 0.6  # a node with this share of its parent's members is a candidate group
#: Chance that the trees miss a pair at the threshold; standard deviations that a candidate's common tokens may lie below the mean of such a pair.
MISSED, BELOW = 1e-7, 6.4
GROUP_SHINGLES, GROUP_MEMBERS = 2_000_000, 4_000
LEADERS = 3
THRESHOLD = (85, 100)
SHINGLE = 3

_RNG = np.random.default_rng(9)
_A = _RNG.integers(1, 2**63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, T, dtype=np.uint64)


def trees(threshold: tuple[int, int]) -> int:
    """Trees that miss fewer than MISSED of the pairs at the threshold."""
    s = threshold[0] / threshold[1]
    q = min(1.0, (2 * s - 1) / s**2)
    n = next((n for n in range(1, T // BRANCHES + 1) if (1 - q) ** n < MISSED), None) if q > 0 else None
    if n is None:
        raise ValueError(f"similarity {s:g} is too low for {T} tokens")
    return n


def agree(threshold: tuple[int, int]) -> int:
    """Tokens in common that a candidate pair needs."""
    s = threshold[0] / threshold[1]
    return int(T * s - BELOW * (T * s * (1 - s)) ** 0.5)


def shingle_sets(texts: pa.Array, k: int = SHINGLE):
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts, lower=True)
    h = w.hashes()
    for i in range(len(texts)):
        own = h[w.first[i] : w.first[i + 1]]
        if len(own) >= k:
            yield np.unique(windows(own, k))
        elif len(own):
            yield mix(windows(own, len(own)) + np.uint64(len(own)))
        else:
            yield own


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def minwise(s: np.ndarray) -> bytes:
    best = np.full(T, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(s), 4096):
        best = np.minimum(best, (s[a : a + 4096, None] * _A + _B).min(axis=0))
    return (best >> np.uint64(32)).astype("<u4").tobytes()


def _positions(node: np.ndarray, level: int, tree: int | None) -> np.ndarray:
    """The token positions that nodes choose: (len(node), BRANCHES).  At the root every tree has positions of its own."""
    if tree is not None:
        return np.broadcast_to(np.arange(tree * BRANCHES, (tree + 1) * BRANCHES), (len(node), BRANCHES))
    first = (mix(node + np.uint64(level)) % np.uint64(T)).astype(np.int64)
    second = (first + 1 + (mix(node + np.uint64(level + 1000)) % np.uint64(T - 1)).astype(np.int64)) % T
    return np.stack([first, second], axis=1)


def _branch(level: int, trees: int):
    """Rows (node, rep, parent, sig) -> rows (node, rep, parent): each member once in every branch."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype="<u4").reshape(-1, T)
            node = b.column(0).to_numpy().view(np.uint64)
            out = []
            for tree in range(trees) if level == 0 else [None]:
                where = _positions(node, level, tree)
                for k in range(BRANCHES):
                    c = where[:, k]
                    out.append(mix(mix(node + np.uint64(level * 131 + 7)) ^ (c.astype(np.uint64) << np.uint64(40)) ^ sig[np.arange(len(c)), c].astype(np.uint64)))
            n = len(out)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.tile(b.column(1).to_numpy(), n)), pa.array(np.tile(b.column(2).to_numpy(), n))], names=["node", "rep", "parent"])

    return run


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _compare(least: int):
    """Rows (node, rep, sig) of whole small nodes -> forest edges (a, b) between members that agree on at least `least` tokens."""

    def run(batches):
        for t in whole_groups(batches, [0]):
            rep = t.column(1).to_numpy()
            sig = np.frombuffer(b"".join(t.column(2).to_pylist()), dtype="<u4").reshape(-1, T)
            edge = np.concatenate([[0], changes(t, [0]), [t.num_rows]])
            size = np.diff(edge)
            two = edge[:-1][size == 2]
            two = two[(sig[two] == sig[two + 1]).sum(axis=1) >= least]
            left, right = [rep[two]], [rep[two + 1]]
            for s, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist()):
                own, parent = sig[s : s + n], list(range(n))
                for i in range(n - 1):
                    for j in (np.flatnonzero((own[i + 1 :] == own[i]).sum(axis=1) >= least) + i + 1).tolist():
                        x, y = _find(parent, i), _find(parent, j)
                        if x != y:
                            parent[y] = x
                            left.append(rep[s + i : s + i + 1])
                            right.append(rep[s + j : s + j + 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return run


def confirm(sets: list[np.ndarray], block: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> list[tuple[int, int]]:
    """Forest of confirmed links among sets; with two blocks, only pairs across them are looked at.

    Each set meets all later ones it isn't connected with: intersections come from one pass over their members.
    """
    num, den = threshold
    n = len(sets)
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    flat = np.concatenate([sets[i] for i in order])
    _, token = np.unique(flat, return_inverse=True)
    size, block = size[order], block[order]
    start = np.cumsum(size) - size
    two = len(np.unique(block)) > 1
    out, root = [], np.arange(n)
    mark = np.zeros(int(token.max()) + 1 if len(token) else 1, dtype=bool)
    for i in range(n - 1):
        most = int(np.searchsorted(size, size[i] * den // num, side="right"))  # the larger set may have size * den / num at most
        if most <= i + 1:
            continue
        wanted = root[i + 1 : most] != root[i]
        if two:
            wanted &= block[i + 1 : most] != block[i]
        js = np.flatnonzero(wanted) + i + 1
        if not len(js):
            continue
        own = token[start[i] : start[i] + size[i]]
        mark[own] = True
        if len(js) * 4 < most - i:
            common = np.array([mark[token[start[j] : start[j] + size[j]]].sum() for j in js])
        else:
            common = np.add.reduceat(mark[token[start[i + 1] : start[most - 1] + size[most - 1]]], start[i + 1 : most] - start[i + 1], dtype=np.int64)[js - i - 1]
        mark[own] = False
        for j in js[den * common >= num * (size[i] + size[js] - common)].tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append((int(order[i]), int(order[j])))
    return out


def _confirm(threshold, k: int):
    def run(batches):
        for t in whole_groups(batches, [0, 1, 2]):
            edge = [0, *changes(t, [0, 1, 2]).tolist(), t.num_rows]
            left, right = [], []
            for s, e in zip(edge, edge[1:]):
                if e - s < 2:
                    continue
                g = t.slice(s, e - s).combine_chunks()
                sets = list(shingle_sets(pa.concat_arrays(g.column(7).chunks), k))
                rep, c1, c2, block = (g.column(i).to_numpy() for i in (3, 4, 5, 6))
                good = [i for i, x in enumerate(sets) if len(x) and digest(x) == (c1[i], c2[i])]
                if len(good) > 1:
                    for a, b in confirm([sets[i] for i in good], block[good], threshold):
                        left.append(int(rep[good[a]]))
                        right.append(int(rep[good[b]]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _leads(threshold, k: int):
    """Rows (rep, c1, c2, text, leader, l1, l2, leader_text) -> the links (a, b) of leaders with members."""
    num, den = threshold

    def run(batches):
        known: tuple = (None, None)
        for batch in batches:
            for b in slices(batch, 3):
                left, right = [], []
                sets = shingle_sets(b.column(3), k)
                rep, c1, c2, leader, l1, l2 = (b.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6))
                for i, own in enumerate(sets):
                    if rep[i] == leader[i] or digest(own) != (c1[i], c2[i]):
                        continue
                    if known[0] != (leader[i], l1[i], l2[i]):
                        s = next(shingle_sets(b.column(7).slice(i, 1), k))
                        known = ((leader[i], l1[i], l2[i]), s if digest(s) == (l1[i], l2[i]) else None)
                    s = known[1]
                    if s is None or min(len(s), len(own)) * den < num * max(len(s), len(own)):
                        continue
                    common = len(np.intersect1d(s, own, assume_unique=True))
                    if den * common >= num * (len(s) + len(own) - common):
                        left.append(leader[i])
                        right.append(rep[i])
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def lead(big: DataFrame, threshold: tuple[int, int], k: int) -> DataFrame:
    """(a, b): links of a few leaders with members of large groups (rep, c1, c2, cluster, text); a member is linked by one leader at most."""
    found, left = None, cut(big.select("rep", "c1", "c2", "cluster"), "left")
    for turn in range(LEADERS):
        leaders = left.groupBy("cluster").agg(F.min_by(F.struct("rep", "c1", "c2"), F.xxhash64("rep", F.lit(turn))).alias("l"), F.count(F.lit(1)).alias("members"))
        leaders = leaders.join(big.select(F.col("rep").alias("_tw_r"), F.col("text").alias("leader_text")), F.col("l.rep") == F.col("_tw_r"))
        leaders = leaders.select("cluster", "members", F.col("l.rep").alias("leader"), F.col("l.c1").alias("l1"), F.col("l.c2").alias("l2"), "leader_text").dropDuplicates(["cluster"])
        own = big.select("rep", "c1", "c2", "cluster", "text").join(left.select("rep"), "rep", "left_semi")
        met = join_groups(own, leaders, ["cluster"], "members", left.count(), F.xxhash64("rep")).select("rep", "c1", "c2", "text", "leader", "l1", "l2", "leader_text")
        links = cut(met.where("leader is not null").mapInArrow(_leads(threshold, k), "a long, b long").distinct(), "led")
        found = links if found is None else found.unionByName(links)
        left = cut(left.join(links.select(F.col("b").alias("_tw_b")).union(links.select("a")).distinct(), F.col("rep") == F.col("_tw_b"), "left_anti"), "left")
    return found


def _blocks(big: DataFrame, led: DataFrame, pieces, total: int) -> DataFrame:
    """Members of large groups as units of block pairs: rep, c1, c2, cluster, block, bi, bj.

    A group's members fall into kinds, one a leader and one for those that none has linked (at most LEADERS + 1), and each
    kind into blocks.  Blocks of one leader are linked by it; all others meet, each also itself.
    """
    none = F.lit(-(2**63))
    by = led.select(F.col("b").alias("_tw_b"), F.col("a").alias("leader")).unionByName(led.select(F.col("a").alias("_tw_b"), F.col("a").alias("leader"))).groupBy("_tw_b").agg(F.min("leader").alias("leader"))
    big = big.join(by, F.col("rep") == F.col("_tw_b"), "left").withColumn("leader", F.coalesce("leader", none))
    kinds = big.groupBy("cluster", "leader").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles")).withColumn("blocks", pieces("shingles", "members"))
    kinds = kinds.groupBy("cluster").agg(F.sum("members").alias("members"), F.array_sort(F.collect_list(F.struct("leader", "blocks"))).alias("kinds"))
    met = join_groups(big.drop("blocks"), kinds, ["cluster"], "members", total, F.xxhash64("rep"))
    before = F.expr("aggregate(filter(kinds, x -> x.leader < leader), 0L, (n, x) -> n + x.blocks)")
    own = F.expr("filter(kinds, x -> x.leader = leader)[0].blocks")
    met = met.withColumn("first", before).withColumn("blocks", own).withColumn("block", F.col("first") + F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.expr("sequence(0L, aggregate(kinds, 0L, (n, x) -> n + x.blocks) - 1)")))
    met = met.where((F.col("leader") == none) | (F.col("other") < F.col("first")) | (F.col("other") >= F.col("first") + F.col("blocks")))
    return met.select("rep", "c1", "c2", "cluster", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))


def candidates(reps: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Forest edges (a, b) over (rep, sig): pairs above the threshold lie in one component of them."""
    edges, level = [], 0
    rows = reps.select(F.lit(0).cast("long").alias("node"), "rep", F.lit(2**62).cast("long").alias("parent"), "sig").mapInArrow(_branch(0, trees(threshold)), "node long, rep long, parent long")
    rows = cut(rows, "level0")
    while True:
        total = rows.count()
        nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("first")).where("size > 1")
        both = join_groups(rows, nodes, ["node"], "size", total, F.xxhash64("rep")).where(F.col("size").isNotNull())
        both = cut(both, f"nodes{level}")
        dense = (F.col("size") > LIMIT) & ((F.col("size") > DENSE * F.col("parent")) | F.lit(level + 1 >= DEPTH))
        edges.append(both.where(dense).select(F.col("first").alias("a"), F.col("rep").alias("b")))
        small = both.where(F.col("size") <= LIMIT).select("node", "rep").join(reps, "rep").select("node", "rep", "sig")
        edges.append(small.repartition("node").sortWithinPartitions("node", "rep").mapInArrow(_compare(agree(threshold)), "a long, b long"))
        big = both.where((F.col("size") > LIMIT) & ~dense)
        if big.isEmpty():
            break
        level += 1
        rows = cut(big.join(reps, "rep").select("node", "rep", F.col("size").alias("parent"), "sig").mapInArrow(_branch(level, trees(threshold)), "node long, rep long, parent long"), f"level{level}")
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row for every row of docs."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sign(batches):
        for batch in batches:
            for b in slices(batch, 1):
                n, c1, c2, sig = [], [], [], []
                for s in shingle_sets(b.column(1), k):
                    n.append(len(s))
                    d = digest(s)
                    c1.append(d[0])
                    c2.append(d[1])
                    sig.append(minwise(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "c1", "c2", "sig"])

    signed = cut(rows.mapInArrow(sign, "doc_id long, n_shingles long, c1 long, c2 long, sig binary"), "signed")
    classes = cut(signed.where("n_shingles > 0").groupBy("c1", "c2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = classes.where("rep is not null").join(signed, [F.col("rep") == F.col("doc_id"), *[classes[c] == signed[c] for c in ("c1", "c2", "n_shingles")]]).select("rep", "sig").dropDuplicates(["rep"])
    reps = cut(reps, "reps")
    group = components(candidates(reps, threshold))
    free_shuffles(spark)
    member = group.join(classes.where("rep is not null"), F.col("v") == F.col("rep")).select("rep", "c1", "c2", "n_shingles", F.col("root").alias("cluster"))
    member = cut(member, "members")
    sizes = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles"))
    total = member.count()
    member = join_groups(member, sizes, ["cluster"], "members", total, F.xxhash64("rep"))
    pieces = lambda shingles, members: F.greatest(F.ceil(F.col(shingles) / GROUP_SHINGLES), F.ceil(F.col(members) / GROUP_MEMBERS)).cast("long")
    member = member.select("rep", "c1", "c2", "n_shingles", "cluster", pieces("shingles", "members").alias("blocks"))
    # Texts meet the members once, always by exchange: members grow with the corpus, so a plan that broadcasts them on small inputs says nothing about large ones.
    member = cut(rows.join(member.hint("merge"), F.col("doc_id") == F.col("rep")).select(*member.columns, "text"), "texts")
    free_shuffles(spark)
    columns = ["cluster", "bi", "bj", "rep", "c1", "c2", "block", "text"]
    units, big, led = member.where("blocks = 1").select("*", *[F.lit(0).cast("long").alias(c) for c in ("block", "bi", "bj")]).select(*columns), member.where("blocks > 1"), None
    if not big.isEmpty():
        led = lead(big, threshold, k)
        units = units.unionByName(_blocks(big.drop("text"), led, pieces, total).join(big.select(F.col("rep").alias("_tw_r"), "text"), F.col("rep") == F.col("_tw_r")).select(*columns))
    links = units.repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj", "rep").mapInArrow(_confirm(threshold, k), "a long, b long")
    links = links if led is None else links.unionByName(led)
    comp = components(links)
    free_shuffles(spark)
    classes = classes.join(comp, F.col("rep") == F.col("v"), "left").select("c1", "c2", "n_shingles", "copies", F.coalesce("root", "rep").alias("component_id"))
    out = join_groups(signed.select("doc_id", "n_shingles", "c1", "c2"), classes, ["c1", "c2", "n_shingles"], "copies", signed.count(), F.xxhash64("doc_id"))
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
