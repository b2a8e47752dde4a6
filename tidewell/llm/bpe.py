"""Operator 4, byte-level BPE: encode whole texts to ids and decode them back.

Merges run on a priority queue of merge ranks over a doubly linked symbol list; entries whose pair has changed since
they were queued are stale and skipped, so a pretoken of n bytes costs O(n log n) whatever its length.  Decoding
concatenates vocabulary strings.  The vocabulary is read from a tokenizer file, by default the public 50k one; its path
is a parameter, and it is read once a worker process.

Defined cases: null text counts as empty; the empty text has no ids.  Repeated rows give repeated results.  The added
token's literal string in a text becomes its id, as in the library whose files these are.  Every row is independent, so
hot sources and groups of copies have no effect on partitioning.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..shipping import ship
from .batches import slices
from .common import table

_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pretokens, and stretches between spaces, whose ids a worker remembers; beyond it the memory starts afresh.  It changes speed only.
CACHE = 500_000
_LOADED: dict[str, "Codec"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = _byte_symbols()
        to_byte = {s: b for b, s in enumerate(symbols)}
        self.first = [vocab[s] for s in symbols]
        size = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.rows: list[dict[int, int]] = [{} for _ in range(size)]  # left id -> {right id: rank}
        self.made = []  # rank -> id of the merged pair
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rows[vocab[a]][vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        strings = [b""] * size
        for token, i in vocab.items():
            strings[i] = bytes(to_byte[c] for c in token)
        for token, i in self.added.items():
            strings[i] = token.encode()
        self.buffer = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.length = np.array([len(x) for x in strings], dtype=np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.words = regex.compile(_SPLIT)
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.edge = regex.compile(r"\p{White_Space} | \p{White_Space}")
        self.rare = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        self.memory: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pretoken."""
        rows, made = self.rows, self.made
        ids = [self.first[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        shift = 14 if n < 16384 else 40
        mask = (1 << shift) - 1
        queue = []
        for i, (a, b) in enumerate(zip(ids, ids[1:])):
            rank = rows[a].get(b)
            if rank is not None:
                queue.append(rank << shift | i)
        if not queue:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & mask
            a, j = ids[i], after[i]
            if a < 0 or j >= n or rows[a].get(ids[j]) != entry >> shift:
                continue  # stale: one side has merged since
            new = ids[i] = made[entry >> shift]
            ids[j] = -1
            k = after[i] = after[j]
            row = rows[new]
            if k < n:
                before[k] = i
                rank = row.get(ids[k])
                if rank is not None:
                    heappush(queue, rank << shift | i)
            h = before[i]
            if h >= 0:
                rank = rows[ids[h]].get(new)
                if rank is not None:
                    heappush(queue, rank << shift | h)
        return [x for x in ids if x >= 0]

    def _pretokens(self, text: str) -> bytes:
        """Ids of a stretch of text by way of its pretokens."""
        memory, out = self.memory, []
        for w in self.words.findall(text):
            ids = memory.get(w)
            if ids is None:
                ids = array("I", self.merge(w.encode())).tobytes()
                if len(w) <= 64:
                    if len(memory) >= CACHE:
                        memory.clear()
                    memory[w] = ids
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens.

        Between two characters that aren't white space a lone space always starts a pretoken, so a text whose spaces are
        all of that kind falls apart into stretches that are split independently, and a stretch met before is looked up.
        """
        parts = text.split(" ")
        if len(parts) == 1 or not all(parts) or "\n " in text or " \n" in text or (self.rare.search(text) and self.edge.search(text)):
            return self._pretokens(text)
        known = self.stretches
        out = [self._pretokens(parts[0])]
        for ids, part in zip(map(known.get, parts[1:]), parts[1:]):
            if ids is None:
                ids = self._pretokens(" " + part)
                if len(part) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[part] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.specials is None or not self.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out.append(self._plain(text[at : m.start()]))
            out.append(array("I", [self.added[m.group()]]).tobytes())
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode_bytes(self, ids: bytes) -> bytes:
        """The vocabulary strings of ids, concatenated: a gather over one buffer that holds all strings."""
        out = []
        for a in range(0, len(ids), 1 << 20):
            some = np.frombuffer(ids[a : a + (1 << 20)], dtype="<u4")
            size = self.length[some]
            end = np.cumsum(size)
            out.append(self.buffer[np.repeat(self.begin[some] - end + size, size) + np.arange(int(end[-1]))].tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all but text), then input_ids array<int>, n_tokens long; kept columns with these two names give way."""
    ship(docs.sparkSession)
    path = path or default_path()
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, "input_ids", "n_tokens")]
    rows = docs.select(F.col(text).cast("string").alias("_tw_text"), *keep)

    def run(batches):
        c = codec(path)
        for batch in batches:
            for b in slices(batch, 0):
                ids = [c.encode(t or "") for t in b.column(0).to_pylist()]
                counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], lists, pa.array(counts)], names=[*keep, "input_ids", "n_tokens"])

    schema = rows.select(keep).schema.add("input_ids", ArrayType(IntegerType())).add("n_tokens", "long")
    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str | None = None, ids: str = "input_ids") -> DataFrame:
    """The columns of rows without ids, then text."""
    ship(rows.sparkSession)
    path = path or default_path()
    keep = [c for c in rows.columns if c != ids]

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [c.decode(np.array(x or [], dtype="<u4").tobytes()) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string())], names=[*keep, "text"])

    return rows.select(ids, *keep).mapInArrow(run, rows.select(keep).schema.add("text", "string"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; digests of both."""
    ship(spark)
    path = default_path()

    def run(batches):
        c = codec(path)
        for batch in batches:
            for b in slices(batch, 1):
                n, ids_hash, text_hash = [], [], []
                for t in b.column(1).to_pylist():
                    ids = c.encode(t or "")
                    n.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


SQL: dict[str, str] = {}
