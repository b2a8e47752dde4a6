"""How the operators come to their results: factors, wrappers, priors, generations, leaders, owned tables, awkward columns."""

import itertools
import json
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidewell.llm import bpe, classifier, exact, hosts, html, lines, mixing, neardup, substrings
from tidewell.llm.common import join_groups, scratch_path


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# Substring dedup


def test_factors_are_copies_of_earlier_text(spark):
    rng = random.Random(8)
    w = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [w(rng.randrange(20, 60)) for _ in range(5)]
    texts = []
    for _ in range(40):
        t = w(rng.randrange(0, 30))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 8)
            t += p[cut : len(p) - rng.randrange(0, 8)] + (w(rng.randrange(0, 12)) if rng.random() < 0.7 else [])
        texts.append(t)
    texts.append(texts[5] + texts[6])  # factors that meet
    texts.append(list(texts[7]))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in substrings.dedup(docs(spark, rows).repartition(5)).collect()}
    index = {}  # first places of windows, in reference order
    for i, t in enumerate(texts):
        hit, covered = [], [False] * len(t)
        for k in range(len(t) - 19):
            if index.setdefault(tuple(t[k : k + 20]), (i, k)) != (i, k):
                hit.append(k)
                covered[k : k + 20] = [True] * 20
        factors = [(f.start, f.words, f.from_doc, f.from_start) for f in got[i].factors]
        end = 0
        for start, words, d, p in factors:
            assert words >= 20 and start >= end and (d, p) < (i, start)
            assert t[start : start + words] == texts[d][p : p + words]
            # Greedy: no earlier start was left out, and the index doesn't name the same source for one more word.
            assert not [k for k in hit if end <= k < start]
            end = start + words
        assert not [k for k in hit if k >= end]
        assert got[i].n_removed == sum(covered)
        assert got[i].kept_text == " ".join(x for x, c in zip(t, covered) if not c)
    assert sum(len(r.factors) for r in got.values()) > 30


def test_parse_goes_on_in_one_source_and_behind_its_end():
    a = lambda *x: np.array(x, dtype=np.int64)
    assert substrings.parse(a(0, 5), a(5, 3), a(1, 1), a(100, 105)) == [(0, 27, 1, 100)]
    # The second source starts within the first factor: its windows over the boundary are spans, the parse resumes behind it.
    assert substrings.parse(a(0, 5), a(5, 40), a(1, 2), a(100, 0)) == [(0, 24, 1, 100), (24, 40, 2, 19)]
    assert substrings.parse(a(0, 5), a(5, 10), a(1, 2), a(100, 0)) == [(0, 24, 1, 100)]


# HTML extraction

PAGE = "<html><body><div class='top'>Our site</div>{}<div class='bottom'>Read us</div></body></html>"


def test_wrapper_doesnt_depend_on_order():
    pages = [PAGE.format(x) for x in ("<p>a</p>", "<p>b</p><p>c</p>", "<ul><li>1<li>2<li>3</ul>", "<p>d</p><hr>", "", "<h1>t</h1><p>e</p>")]
    want = None
    for order in itertools.permutations(pages):
        w = {}
        for p in order:
            html.merge(w, html.read(p)[1])
        got = html.expression(w), json.dumps(w, sort_keys=True)
        want = want or got
        assert got == want
    left, right = {}, {}
    for p in pages[:2]:
        html.merge(left, html.read(p)[1])
    for p in pages[2:]:
        html.merge(right, html.read(p)[1])
    assert html.expression(html.merge(right, left)) == want[0]
    assert want[0] == "<html><body><div.top>text(<h1>text)?(<ul>(<li>#TEXT)+)?(<p>#TEXT)*(<hr>)?<div.bottom>text"


def test_wrapper_decides(spark):
    rows = [(i, f"http://h/{i}", PAGE.format(f"<div><p>news {i} of the day</p></div>")) for i in range(6)]
    schema = "page_id long, url string, html string"
    assert {r.text for r in html.extract(docs(spark, rows, schema)).collect()} == {f"news {i} of the day" for i in range(6)}
    alone = docs(spark, [(i, f"http://h{i}/", p) for i, _, p in rows], schema)  # a host each: nothing shows what is template
    assert {r.text for r in html.extract(alone).collect()} == {f"Our site news {i} of the day Read us" for i in range(6)}
    assert html.apply(rows[0][2], {"order": [], html.BODY: set()}) == ""  # no slots marked, no text
    copies = docs(spark, [(i, "http://h/", rows[0][2]) for i in range(4)], schema)  # copies are no template
    assert {r.text for r in html.extract(copies).collect()} == {"Our site news 0 of the day Read us"}


def test_host_says_where_the_text_is(spark):
    page = lambda i: f"<article>tease {i}</article><div class='page-content'><p>{'the whole story ' * (i + 1)}{i}</p></div>"
    rows = [(i, "http://h/x", page(i)) for i in range(5)] + [(9, "http://h/y", "<article>only an article</article>")]
    got = {r.page_id: r.text for r in html.extract(docs(spark, rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("the whole story " * (i + 1)) + str(i) for i in range(5)} | {9: "only an article"}


@pytest.mark.parametrize("page, want", [
    ("<article>A <p>x</p></article><article class='comment'><p>reader</p></article><article class='ad'>buy</article>", "A x"),
    ("<article><div class='social-history'>1</div><div class='notice-period'>2</div><p class='share-prices'>3</p></article>", "1 2 3"),
    ("<article>a<div class='siteFooter'>b</div><div id='nav-bar'>c</div><div class='related-posts'>d</div><div class='comment-list'>e</div></article>", "a"),
    ("<!-- <article> -->plain<script>'<article>'</script>", "plain"),
    ("<article>a<nav>b<ul><li>c</article><p>d", "a"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("<article>" + "<div>" * 3000 + "deep", "deep"),
    ("<article>" + "word " * 200_000, ("word " * 200_000).strip()),
])
def test_pages(page, want):
    assert html.apply(page) == want


# URL filters


def test_labels_make_the_method_block(spark):
    rng = random.Random(1)
    pages, labels = [], []
    for h, rate in [("bad.shop.co.uk", 0.03), ("worse.shop.co.uk", 0.0), *[(f"h{i}.example.com", 0.95) for i in range(12)]]:
        for _ in range(40):
            n = len(pages)
            pages.append((n, f"http://{h}/xx/{n}.html"))
            labels.append((n, int(rng.random() < rate)))
    pages += [(9001, "http://new.shop.co.uk/"), (9002, "http://unknown.example.org/"), (9003, None)]
    got = {r.page_id: (r.host, r.verdict) for r in hosts.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert {h for h, v in got.values() if v == "block"} == {"bad.shop.co.uk", "worse.shop.co.uk", "new.shop.co.uk"}  # a host without labels takes after its domain
    assert len(got) == len(pages) and got[9003] == ("", "allow")


def test_rules_say_what_the_contract_says(spark):
    # All labels are bad, so the method blocks, and all are good, so it allows: a rule's verdict holds in both cases.
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://www.example.com/en/71": ("example.com/en/7", "allow"), "http://x.net/de/1": ("net/de/", "allow"), "http://x.example.net/de/9": ("net/de/", "allow"),
        "http://x.example.net/de/81": ("example.net/de/8", "block"), "http://b.org/es/1": ("org/es/", "block"), "http://a.com/de/1": (None, None), "http://x.net/en/1": (None, None),
    }
    pages = [(i, u) for i, u in enumerate([*want, *[f"http://{h}/xx/{n}" for h in ("a.com", "www.example.com", "x.net", "x.example.net", "b.org") for n in range(100)]])]
    for quality, method in ((0, "block"), (1, "allow")):
        labels = spark.createDataFrame([(n, quality) for n in range(100)], "doc_id long, quality int")
        got = {r.page_id: (r.rule, r.verdict) for r in hosts.judge(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()}
        assert [got[i] for i in range(len(want))] == [(r, v or method) for r, v in want.values()]


def test_concentration_follows_the_spread(spark):
    def strength(rates):
        rows = [(f"h{i}.x.com", int(k < round(100 * r))) for i, r in enumerate(rates) for k in range(100)]
        r = hosts.reputations(spark.createDataFrame(rows, "host string, good int")).collect()
        return {x.host: x.share for x in r}

    alike, apart = strength([0.5] * 10), strength([0.1, 0.9] * 5)
    assert all(abs(s - 0.5) < 1e-9 for s in alike.values())
    assert max(apart.values()) > 0.88 and min(apart.values()) < 0.12  # hosts that differ are shrunk little
    near = strength([0.45, 0.55] * 5)
    assert 0.5 < max(near.values()) < 0.51  # as far apart as chance would have them


# Exact dedup


def test_generations(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = exact.DigestIndex(spark, path, 3)
    rows = [(i, f"t{i % 7}") for i in range(40)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.dedup(docs(spark, rows), index, 3).collect()}
    assert got == {i: (max(j for j, t in rows if t == x), sum(t == x for _, t in rows), i > 32) for i, x in rows}
    assert len(index.generations()) == 3
    assert "Exchange" not in index.unseen(index._open(index.generations()[0]).select("digest"), index.generations()[1:])._jdf.queryExecution().executedPlan().toString()
    # A generation that no manifest names, as a crash leaves it, isn't read.
    index._write(docs(spark, [(1, "lost")]).selectExpr("sha2(text, 256) digest", "doc_id keep_id", "1L group_size", "true fresh"))
    assert index.totals().count() == 7
    # A number can be taken once: the second writer starts again from the newer manifest.
    number, manifest = index._manifest()
    assert index._commit(number + 1, manifest) and not index._commit(number + 1, {"buckets": 3, "generations": []})
    index.compact()
    assert len(index.generations()) == 1 and {r.group_size for r in index.totals().collect()} == {5, 6}
    other = exact.DigestIndex(spark, path)
    for i in range(index.COMPACT):
        exact.ingest(docs(spark, [(100 + i, f"n{i}")]), other)
    assert len(other.generations()) < index.COMPACT and other.totals().count() == 7 + index.COMPACT


# Near duplicates


def near_corpus(n=600):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 200))] for _ in range(60)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(int(len(w) * rng.random() * 0.025)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(w)))
    return out


def test_recall_against_all_pairs(spark):
    """Queries: every id divisible by 50, against all rows."""
    rows = near_corpus()
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in rows)}
    links = [(a, b) for a in sets if a % 50 == 0 for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    found = sum(got[a] == got[b] for a, b in links)
    assert len(links) > 40 and found >= 0.9 * len(links) and found == len(links)


def test_leaders_link_like_all_pairs(spark, monkeypatch):
    rows = near_corpus(300)
    want = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    monkeypatch.setattr(neardup, "GROUP_MEMBERS", 3)
    seen = []
    lead = neardup.lead
    monkeypatch.setattr(neardup, "lead", lambda *a: seen.append(lead(*a)) or seen[-1])
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows)).collect()} == want
    links = seen[0].collect()
    assert len(links) > 50 and max(Counter(r.b for r in links).values()) == 1 and all(want[r.a] == want[r.b] for r in links)


# Quality classifier


def test_discriminant_is_that_of_the_formula():
    rng = np.random.default_rng(3)
    d = len(classifier.FEATURES)
    x = [rng.normal(size=(200, d)) * (1 + k) + 0.3 * k for k in (0, 1)]
    mean, cov = [a.mean(axis=0) for a in x], [np.cov(a.T, bias=True) for a in x]
    pooled = (cov[0] + cov[1]) / 2
    shrunk = []
    for c in cov:
        c = 0.9 * c + 0.1 * pooled
        shrunk.append(0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(d))
    inverse = [np.linalg.inv(np.linalg.cholesky(c)) for c in shrunk]
    model = classifier.Discriminant(mean, inverse, [np.linalg.slogdet(c)[1] for c in shrunk], 0.5)
    new = rng.normal(size=(20, d))
    log = lambda v, k: -0.5 * (v - mean[k]) @ np.linalg.solve(shrunk[k], v - mean[k]) - 0.5 * np.linalg.slogdet(shrunk[k])[1]
    assert np.allclose(model.score(new), [1 / (1 + np.exp(log(v, 0) - log(v, 1))) for v in new])


def test_fit_and_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    x = classifier.features(table).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").where("label is not null").toPandas()
    own = x[[zlib.crc32(str(i).encode()) % 3 != 1 for i in x.doc_id]]
    model = classifier.fit(spark.createDataFrame(own))
    for k in (0, 1):
        v = own[own.label == k][classifier.FEATURES].to_numpy()
        assert np.allclose(model.mean[k], v.mean(axis=0))
    rest = x.drop(own.index)
    score = model.score(rest[classifier.FEATURES].to_numpy())
    good = (rest.label == 1).to_numpy()
    pairs = (score[good][:, None] > score[~good][None, :]).mean()
    assert ((score >= 0.5) == good).mean() > 0.95 and pairs > 0.97


# Tables and joins


def test_results_survive_a_pipeline(spark, tmp_path):
    import corpus_pipeline

    own = neardup.near_duplicates(docs(spark, near_corpus(40)))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in near_corpus(40)]
    d = docs(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, step in corpus_pipeline.STAGES[1:4]:
        d = step(spark, d, "")
    assert d.count() > 0 and own.count() == 40


@pytest.mark.parametrize("total", [1, 40, 10**6])
def test_join_groups_cuts_hot_and_null_keys(spark, total):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 99), (None, 100), (None, 101), (3, 102)], "k long, i long")
    groups = spark.createDataFrame([(1, 50, "a"), (2, 1, "b")], "k long, n long, v string")
    got = Counter((r.k, r.n, r.v) for r in join_groups(rows, groups, ["k"], "n", total, F.xxhash64("i")).collect())
    assert got == {(1, 50, "a"): 50, (2, 1, "b"): 1, (None, None, None): 2, (3, None, None): 1}


CLASHES = ["n_lines", "n_removed", "n_tokens", "input_ids", "gone", "component_id", "kept", "size", "copies", "target", "score", "key", "rep", "text_hash", "copy", "leader"]


def test_stages_pass_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, f"{t} .\n{'junk ### ' * 30 if i % 2 == 0 else t}", "s") for i, t in near_corpus(20)]
    d = docs(spark, rows, "doc_id long, text string, source string").withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    for name, step in corpus_pipeline.STAGES[:-1]:
        columns = d.columns
        d = step(spark, d, str(tmp_path))
        assert d.columns == columns, name
    kept = d.collect()
    assert kept and all(r[c] == f"own {c}" for r in kept for c in CLASHES)
    out = corpus_pipeline.bpe_encoding(spark, d, "").first()
    assert len(out.input_ids) == out.n_tokens and out.gone == "own gone"
    assert lines.dedup_lines(d).columns[-2:] == ["n_lines", "n_removed"]


def test_stages_and_repeated_rows(spark):
    import corpus_pipeline

    t = [x for _, x in near_corpus(6)]
    rows = [(1, t[0], "a")] * 3 + [(2, t[1] + " q", "a"), (2, "other words of row two here", "a"), (None, t[3], "b"), (None, t[3], "b"), (None, "zz", "b"), (7, None, None), (8, "", None)]
    d = docs(spark, rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.near_dedup(spark, d, "").collect()
    assert Counter(r.doc_id for r in kept) == {1: 1, 2: 1, 7: 1, 8: 1, None: 2}
    mixed = Counter((r.doc_id, r.source, r.text) for r in corpus_pipeline.source_mixing(spark, d, "").collect())
    want = Counter()
    for r in mixing.mix(d).collect():
        want[r.doc_id, r.source, r.text_hash] += r.copies
    hashed = {(r.doc_id, r.source, r.text): r.h for r in d.select("*", mixing.text_hash().alias("h")).collect()}
    assert Counter({(i, s, hashed[i, s, x]): n for (i, s, x), n in mixed.items()}) == +want


@pytest.mark.parametrize("size", [300_000])
def test_very_long_texts(spark, size):
    """Texts of 300,000 words beside small ones, through every operator on documents."""
    long = " ".join(f"w{i % 50_000}" for i in range(size))
    d = docs(spark, [(1, long, "s"), (2, "a b c", "s"), (3, long, "t")], "doc_id long, text string, source string")
    assert {r.doc_id: r.n_removed for r in substrings.dedup(d).collect()} == {1: size - 50_000, 2: 0, 3: size}
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(d).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.keep_id for r in exact.dedup(d, exact.DigestIndex(spark, scratch_path(spark, "index"))).collect()} == {1: 3, 2: 2, 3: 3}
    assert {r.doc_id: r.size for r in mixing.mix(d).collect()} == {1: size, 2: 3, 3: size}
    assert lines.dedup_lines(d).where("n_removed = 0").count() == 3
    assert classifier.features(d).count() == 3
    assert {r.doc_id: r.n_tokens > 1 for r in bpe.encode(d).collect()} == {1: True, 2: True, 3: True}
