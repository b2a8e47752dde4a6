"""The ten queries and the pipeline on a small corpus that has every awkward case, against SQL or brute force."""

import hashlib
import html as html_lib
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tidewell.llm.queries import oracle_sql, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
Q, SQL = queries(), oracle_sql()


def name(n):
    return next(q for q in Q if q.startswith(f"op{n}_"))


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    boiler = [prose(8) for _ in range(3)]
    passage = prose(60)
    texts = [None, "", " \t\n ", "one", "One two", "one two", "a\x0bb\x0cc", "<|endoftext|> x  y \n z", " non breaking space", "x" * 5000, "junk### " * 300, "A | B | C | " * 80]
    base = [prose(rng.randrange(40, 160)) for _ in range(25)]
    texts += base + base[:6] + [base[0]] * 20
    for b in base[6:14]:
        w = b.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [prose(30) + " " + passage + "\n" + prose(20) for _ in range(6)]
    texts += [prose(20) + "\n" + rng.choice(boiler) + "\n" + prose(10) + "\n" + rng.choice(boiler) for _ in range(40)]
    texts.append(prose(3000) + "\n" + passage + " " + passage)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    sources = [None if i % 17 == 0 else "s1" if i % 3 == 0 else f"s{i % 12}" for i in range(len(texts))]
    return ids, texts, sources


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    ids, texts, sources = corpus()
    extra = pa.array(["clash"] * len(ids))
    docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(ids), "source": pa.array(sources, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), "kept": extra, "size": extra})
    (d / "documents.parquet").mkdir()
    for i in range(4):  # several files, so that rows meet across tasks
        pq.write_table(docs.slice(i * len(ids) // 4, (i + 1) * len(ids) // 4 - i * len(ids) // 4), d / "documents.parquet" / f"p{i}.parquet")
    good = [int(not (t or "").startswith(("junk", "A |"))) for t in texts]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array(good, pa.int32()), "toxic": pa.array([0] * len(ids), pa.int32())}), d / "labels.parquet")
    urls = [None, "nothing", "http://", "HTTP://A.Example.COM?x", "https://www.example.com/en/71#t", "http://com/en/5", "http://x.example.net/de/81", "http://x.example.net/de/9?q=/", "http://b.org/es/1", "http://b.org/en/3/"]
    pages = [None, "", "plain <b>text", "<article>a&amp;b<br>c</article>"] + [
        f"<html><head><title>t</title></head><body><nav>menu {i}</nav><div class='cookie-notice'>cookies</div><header>head</header><article class=post><header><h1>T&eacute; {i}</h1></header><p>One <b>b</b>old&nbsp;x<p>two\n  three<aside>side</aside><form><input>f</form><script>if (a<b) x();</script><section id=comments><p>reader</p></section></article><footer>foot</footer></body></html>" for i in range(6)]
    pq.write_table(pa.table({"page_id": pa.array(range(10), pa.int64()), "url": pa.array(urls, pa.string()), "html": pa.array(pages, pa.string())}), d / "pages.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    string, long, int32 = pa.string(), pa.int64(), pa.int32()
    for table, columns in (("documents", {"doc_id": long, "text": string, "lang": string, "source": string, "n_chars": long}), ("labels", {"doc_id": long, "quality": int32, "toxic": int32}), ("pages", {"page_id": long, "url": string, "html": string})):
        pq.write_table(pa.table({k: pa.array([], t) for k, t in columns.items()}), d / f"{table}.parquet")
    return str(d)


def words(t):
    return WORD.findall(t or "")


@pytest.mark.parametrize("query", sorted(SQL))
def test_sql(spark, folder, query):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    for t in ("labels", "pages"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    mine, sql = Q[query](spark, folder).toPandas(), con.sql(SQL[query]).df()
    c = sorted(mine.columns)
    assert c == sorted(sql.columns)
    text = lambda x: sorted(tuple("None" if v is None or v != v else str(v) for v in r) for r in x[c].values.tolist())
    assert text(mine) == text(sql)


@pytest.mark.parametrize("query", sorted(Q))
def test_empty(spark, empty, query):
    assert Q[query](spark, empty).count() == 0


def test_op3(spark, folder):
    got = {r.page_id: r.text for r in Q[name(3)](spark, folder).collect()}
    assert got[0] == got[1] == ""
    assert got[2] == "plain text" and got[3] == "a&b c"
    assert got[7] == html_lib.unescape("T&eacute; 3 One bold&nbsp;x two three")


def test_op4(spark, folder):
    from tidewell.llm.bpe import default_path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    ids, texts, _ = corpus()
    rows = {r.doc_id: r for r in Q[name(4)](spark, folder).collect()}
    for i, x in zip(ids, texts):
        e = t.encode(x or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(e)
        assert rows[i].ids_sha256 == hashlib.sha256(b"".join(v.to_bytes(4, "little") for v in e)).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest()


def test_op5(spark, folder):
    ids, texts, _ = corpus()
    seen, want = set(), {}
    for i, t in sorted(zip(ids, texts), key=lambda x: x[0]):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        kept = [x for x, g in zip(w, gone) if not g]
        want[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q[name(5)](spark, folder).collect()}
    assert got == want
    assert sum(v[1] for v in want.values()) > 300


def test_op6(spark, folder):
    import zlib

    ids, texts, _ = corpus()
    rows = {r.doc_id: r for r in Q[name(6)](spark, folder).collect()}
    assert len(rows) == len(ids)
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= rows[i].score <= 1 and rows[i].predicted == int(rows[i].score >= 0.5) for i in ids)
    prose = [i for i, t in zip(ids, texts) if len(words(t)) > 60 and "|" not in t and "###" not in t]
    assert sum(rows[i].predicted for i in prose) >= 0.95 * len(prose)


def test_op7(spark, folder):
    ids, texts, sources = corpus()
    rows = Q[name(7)](spark, folder).collect()
    again = Q[name(7)](spark, folder).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    size = Counter()
    for t, s in zip(texts, sources):
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.remove(s)
    taken = Counter()
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(0.05 * target[s], 25), (s, taken[s], target[s])


def test_op9(spark, folder):
    ids, texts, _ = corpus()
    sets = {}
    for i, t in zip(ids, texts):
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    root = {i: i for i in ids}
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            least = min(root[a], root[b])
            if root[a] != least or root[b] != least:
                root[a] = root[b] = least
                changed = True
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in Q[name(9)](spark, folder).collect()}
    assert got == {i: (len(sets[i]), root[i], root[i] == i) for i in ids}


def test_pipeline(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for stage, fn in corpus_pipeline.STAGES[:-1]:
        docs = fn(spark, docs, folder)
        assert docs.columns == before.columns
    rows = docs.collect()
    assert 0 < len(rows)
    assert not [r for r in rows if (r.text or "").startswith("junk###")]
    out = corpus_pipeline.run(spark, folder).collect()
    assert len(out) == len(rows) and all(len(r.input_ids) == r.n_tokens for r in out)
