"""Whole jobs where a part was left out before."""

import json
import random
from collections import Counter

import pytest
from tidewell.llm import html, mixing, neardup, substrings


def test_small_sources_land_beside_a_large_one(spark):
    rng = random.Random(4)
    sizes = [("big", rng.randrange(1, 400)) for _ in range(300)] + [(f"s{k}", rng.randrange(1, 400)) for k in range(6) for _ in range(19)]
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes)]
    taken, target = Counter(), {}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=20).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(target) == 7
    for s in target:
        assert abs(taken[s] - target[s]) <= 5, (s, taken[s], target[s])


def test_stage_links_at_80_of_five_words(spark):
    import corpus_pipeline

    w = [f"w{i}" for i in range(490)]
    # 396 of 486 shingles of five words; the last row has 4 of 5 words in common with the first, but few shingles.
    rows = [(1, " ".join(w[:400])), (2, " ".join(w)), (3, " ".join(w[:300])), (4, " ".join("x" if i % 5 == 0 else x for i, x in enumerate(w)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3, 4]
    assert {r.doc_id: r.n_shingles for r in neardup.near_duplicates(docs, (80, 100), 5).collect()}[1] == 396
    assert [r.component_id for r in neardup.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 2, 3, 4]


def test_shingle_length_decides(spark):
    w = [f"w{i}" for i in range(200)]
    other = ["x" if i % 50 == 25 else x for i, x in enumerate(w)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(other))], "doc_id long, text string")
    # Four changed words: 186 of 210 shingles of three words in common, 176 of 216 of five.
    got = lambda threshold, k: neardup.near_duplicates(docs, threshold, k).where("kept").count()
    assert (got((85, 100), 3), got((85, 100), 5), got((80, 100), 5), got((82, 100), 5)) == (1, 2, 1, 2)


def test_trees_and_tokens_follow_the_threshold():
    assert (neardup.trees((85, 100)), neardup.agree((85, 100))) == (5, 36)
    assert (neardup.trees((80, 100)), neardup.agree((80, 100))) == (6, 30)
    with pytest.raises(ValueError):
        neardup.trees((50, 100))


def test_rows_that_share_an_id_keep_their_texts(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (1, a), (1, a), (2, b), (2, c), (2, c), (3, c), (4, a), (4, d), (5, "x y"), (5, d + " x"), (None, b), (None, b)]
    got = Counter((r.doc_id, r.kept_text) for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, a): 1, (1, ""): 2, (2, b): 1, (2, c): 1, (2, ""): 1, (3, ""): 1, (4, ""): 1, (4, d): 1, (5, "x y"): 1, (5, "x"): 1, (None, b): 2})


def test_layout_after_a_hundred_pages_is_learned(spark):
    old = lambda i: f"<html><body><div>Old menu</div><p>Text {i}</p></body></html>"
    new = lambda i: f"<html><body><section><h4>New menu</h4></section><blockquote>Text {i}</blockquote></body></html>"
    rows = [("h", old(i) if i < 105 else new(i)) for i in range(250)]
    r = html.infer(spark.createDataFrame(rows, "host string, html string").coalesce(1)).first()
    w = json.loads(r.wrapper)
    assert r.pages == 250 and w["/html/body/section"][html.PAGES] == w["/html/body/blockquote"][html.PAGES] == 145
    assert html.expression(w) == "<html><body>(<div>text)?(<section><h4>text)?(<blockquote>#TEXT)?(<p>#TEXT)?"
    # On over half of the host's pages the new menu is template; both texts are slots.
    assert [html.apply(f(7), html._load(json.dumps(html.mark(w, 250)))) for f in (old, new)] == ["Old menu Text 7", "Text 7"]
