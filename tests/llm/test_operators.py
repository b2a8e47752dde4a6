"""Operators of the subpackage beyond their queries."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from tidewell.llm import classifier, exact, html, lines, mixing, neardup, quality, substrings
from tidewell.llm.graph import components


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_digest_index_is_persistent(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = exact.ingest(docs(spark, [(1, "a"), (2, "a"), (3, None), (4, "")]), exact.DigestIndex(spark, path, 3)).collect()
    assert {(r.doc_id, r.kept) for r in first} == {(1, False), (2, True), (3, False), (4, True)}
    index = exact.DigestIndex(spark, path)
    assert index.buckets == 3
    second = {r.doc_id: r for r in exact.ingest(docs(spark, [(9, "a"), (10, "b")]), index).collect()}
    assert second[9].seen_before and not second[9].kept and second[10].kept
    assert exact.ingest(docs(spark, [(11, "b")]), index).first().seen_before
    index.compact()
    assert len(index.generations()) == 1
    assert exact.ingest(docs(spark, [(12, "a")]), exact.DigestIndex(spark, path)).first().seen_before


def test_null_ids(spark):
    rows = [(None, "x y z " * 30), (1, "x y z " * 30), (None, None), (1, "x y z " * 30)]
    d = docs(spark, rows).selectExpr("doc_id", "text", "'s' as source")
    assert quality.ledger(d).count() == 4
    assert substrings.dedup(d).count() == 4
    assert neardup.near_duplicates(d).count() == 4
    assert mixing.mix(d).count() == 4
    assert lines.dedup_lines(d).count() == 4
    assert exact.ingest(d, exact.DigestIndex(spark, exact.scratch_path(spark, "i"))).count() == 4


def test_ablations(spark):
    d = docs(spark, [(1, "w " * 60), (2, "a b c"), (3, " ".join(f"w{i}" for i in range(80)))])
    by = {r.rule: r for r in quality.ablations(quality.ledger(d), "base-1").collect()}
    assert (by["few_words"].failing, by["few_words"].failing_alone, by["few_words"].kept_without) == (1, 1, 2)
    assert by["repeated_words"].kept_without == 2


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)]
    root = {v: v for e in edges for v in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(v, v) == r for v, r in root.items())


def test_confirm_links_like_all_pairs():
    rng = random.Random(7)
    base = [frozenset(rng.sample(range(5000), 200)) for _ in range(4)]
    sets = []
    for b in base:
        for _ in range(15):
            s = set(b)
            for x in rng.sample(sorted(s), rng.randrange(0, 25)):
                s.remove(x)
            sets.append(np.array(sorted(s), dtype=np.uint64))
    want = list(range(len(sets)))

    def find(p, i):
        while p[i] != i:
            i = p[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(want, i), find(want, j)
                want[max(a, b)] = min(a, b)
    for block in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
        got = list(range(len(sets)))
        pairs = neardup.confirm(sets, block)
        if block.any():  # within a block, its own unit looks
            for k in (0, 1):
                own = np.flatnonzero(block == k)
                pairs += [(int(own[a]), int(own[b])) for a, b in neardup.confirm([sets[i] for i in own], np.zeros(len(own), int))]
        for i, j in pairs:
            a, b = find(got, i), find(got, j)
            got[max(a, b)] = min(a, b)
        assert [find(got, i) for i in range(len(sets))] == [find(want, i) for i in range(len(sets))]


def test_large_groups_in_blocks(spark, monkeypatch):
    """Dense groups, branching and block pairs, forced by small limits."""
    monkeypatch.setattr(neardup, "LIMIT", 5)
    monkeypatch.setattr(neardup, "GROUP_MEMBERS", 7)
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        w[i * 3] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(50))) for i in range(20)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert all(got[i] == 0 for i in range(40)) and all(got[i] == i for i in range(100, 120))


def test_cube_balances():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 3000, 500).astype(float).tolist()
    p = [0.37] * 500
    kept = mixing.ladder(size)
    left = mixing.flight(p, size, rng, sorted(set(range(500)) - set(kept)))
    mixing.landing(p, size, kept + left)
    assert set(p) <= {0.0, 1.0}
    assert abs(np.dot(p, size) - 0.37 * sum(size)) < 0.002 * sum(size) and abs(sum(p) - 185) < 10


def test_wrappers(spark):
    page = lambda i: f"<html><body><div><h2>Site name</h2></div><div><p>Text {i} of its own</p>{'<p>more</p>' * (i % 3)}</div><div>Read us daily</div></body></html>"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(12)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got[3] == "Text 3 of its own"
    assert "Site name" not in got[4] and "Text 4" in got[4]
    r = html.infer(pages.selectExpr("'h' as host", "html")).first()
    assert r.pages == 12 and html.expression(json.loads(r.wrapper)) == "<html><body>(<div>(text)?(<h2>text)?(<p>#TEXT)*)+"


def test_near_threshold_lines_are_exact(spark):
    rows = [(i * 100 + s, f"this line is on {n} sites", f"s{s}") for i, n in enumerate((7, 8, 9)) for s in range(n)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = {r.doc_id for r in lines.dedup_lines(d).where("n_removed > 0").collect()}
    assert gone == {100 + s for s in range(1, 8)} | {200 + s for s in range(1, 9)}


def test_discriminant_without_labels():
    x = classifier.vectors(pa.array(["a b c", ""]))
    assert classifier.Discriminant([], [], [], 0.5).score(x).tolist() == [0.5, 0.5]


@pytest.mark.parametrize("n", [0, 19, 20, 60])
def test_seeds_cover_every_window(n):
    h = np.random.default_rng(0).integers(0, 2**63, n, dtype=np.uint64)
    g, at = substrings.seeds(h)
    for i, s in enumerate(at):
        assert i <= s <= i + 14 and g[s] == g[i : i + 15].min()
