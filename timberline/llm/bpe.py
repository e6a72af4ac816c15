"""Byte-level BPE with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a
vocabulary entry is one id. Tier two merges the bytes of other pre-tokens: a
linked list of parts and a heap of candidate merges, lowest rank first and
leftmost among equals. Results of distinct pre-tokens are kept in a memo of
bounded size, for words recur.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import text_chunks, texts_of

MEMO_WORDS = 400_000
MEMO_PAIRS = 1 << 20
_BUCKET = 4
_SPREAD = 0x9E3779B97F4A7C15
_U64 = (1 << 64) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file (base64 and number on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MinimalPerfectHash:
    """Hash and displace over distinct byte strings: n keys, n slots.

    Buckets with several keys get the first displacement that sends all of
    them to free slots; buckets of one key name their slot directly.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.m = m = max(1, n // _BUCKET)
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, n)
        if len(np.unique(h)) != n:
            raise ValueError("two keys have the same 64-bit hash")
        bucket = (h % np.uint64(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(m + 1))
        sizes = np.diff(starts)
        self.shift = np.zeros(m, np.int64)
        self.slot_key = np.full(n, -1, np.int64)
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            members = order[starts[b] : starts[b + 1]]
            if len(members) < 2:
                break
            hashes = [int(x) for x in h[members]]
            d = 1
            while True:
                slots = [(((x >> 20) + d * _SPREAD & _U64) ^ (x * (2 * d + 1) & _U64) >> 13) % n for x in hashes]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for s, k in zip(slots, members, strict=True):
                free[s], self.slot_key[s] = False, k
        left = iter(np.flatnonzero(free).tolist())
        for b in np.flatnonzero(sizes == 1):
            s = next(left)
            self.shift[b], self.slot_key[s] = -1 - s, order[starts[b]]

    def slots(self, words: list[bytes]) -> np.ndarray:
        """The slot of each word; whether that slot's key is the word must be compared."""
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        d = self.shift[(h % np.uint64(self.m)).astype(np.int64)]
        u = d.clip(0).astype(np.uint64)
        mixed = ((h >> np.uint64(20)) + u * np.uint64(_SPREAD)) ^ ((h * (np.uint64(2) * u + np.uint64(1))) >> np.uint64(13))
        return np.where(d < 0, -1 - d, (mixed % np.uint64(self.n)).astype(np.int64))


class ByteBpe:
    """Encoder and decoder for one rank table and split pattern; picklable, so it can be broadcast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.ids = [ranks[t] for t in self.tokens]
        self.table = MinimalPerfectHash(self.tokens)
        self._prepare()

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("pattern", "tokens", "ids", "table")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._prepare()

    def _prepare(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.ranks = dict(zip(self.tokens, self.ids, strict=True))
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.by_id = dict(zip(self.ids, self.tokens, strict=True))
        self.pairs: dict[int, int] = {}
        self.memo: dict[str, bytes] = {}
        sizes = np.zeros(max(self.ids) + 1, np.int64)
        sizes[self.ids] = [len(t) for t in self.tokens]
        self.sizes, self.offsets = sizes, np.cumsum(sizes) - sizes
        self.flat = np.frombuffer(b"".join(self.by_id.get(i, b"") for i in range(len(sizes))), np.uint8)

    def merge(self, word: bytes) -> list[int]:
        """Tier two: merge the bytes of ``word`` by rank."""
        n, ids, pairs = len(word), [self.byte_ids[b] for b in word], self.pairs
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        if len(pairs) > MEMO_PAIRS:
            pairs.clear()

        def rank(a: int, b: int) -> int:
            key = a << 20 | b
            r = pairs.get(key)
            if r is None:
                r = pairs[key] = self.ranks.get(self.by_id[a] + self.by_id[b], -1)
            return r

        for i in range(n - 1):
            if (r := rank(ids[i], ids[i + 1])) >= 0:
                heap.append(r << 40 | i)
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 40, top & 0xFFFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i], ids[j]) != r:
                continue  # a part of this merge has been used
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := rank(r, ids[k])) >= 0:
                    heapq.heappush(heap, q << 40 | i)
            if (p := before[i]) >= 0 and (q := rank(ids[p], r)) >= 0:
                heapq.heappush(heap, q << 40 | p)
        return [x for x in ids if x >= 0]

    def learn(self, words: set[str]) -> None:
        """Put the ids of ``words`` into the memo, as little-endian bytes."""
        names = list(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in names]
        found = self.table.slot_key[self.table.slots(raw)].tolist() if raw else []
        for name, word, k in zip(names, raw, found, strict=True):
            ids = [self.ids[k]] if self.tokens[k] == word else self.merge(word)
            self.memo[name] = np.array(ids, "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            parts = self.split(text)
            new = set(parts).difference(self.memo)
            if new:
                if len(self.memo) + len(new) > MEMO_WORDS:
                    self.memo.clear()
                    new = set(parts)
                self.learn(new)
            out.append(b"".join(map(self.memo.__getitem__, parts)))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<u4").tolist()

    def decode_many(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes that each text's ids stand for."""
        ids = np.frombuffer(b"".join(encoded), "<u4").astype(np.int64)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        ends, out, at, begin = np.concatenate([[0], ends]), [], 0, 0
        for e in encoded:
            at += len(e) // 4
            out.append(flat[begin : int(ends[at])])
            begin = int(ends[at])
        return out

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_many([np.array(ids, "<u4").tobytes()])[0]


def _frame(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of each row; ``vocabulary`` is a rank file that the driver can read.

    Null text is empty and gives no ids; repeated rows stay; other columns are
    ignored. The driver builds the table once and broadcasts it: its size is
    the vocabulary's.
    """
    coder = docs.sparkSession.sparkContext.broadcast(ByteBpe(load_ranks(vocabulary), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                encoded = coder.value.encode_many(texts_of(part))
                ids = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
                ends = np.cumsum([0, *[len(e) // 4 for e in encoded]])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names=["doc_id", "ids"])

    return _frame(docs).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode every text, decode the ids, and digest both.

    Null text is empty (no ids); an empty table gives an empty frame; repeated
    rows stay; columns other than doc_id and text are ignored.
    """
    coder = docs.sparkSession.sparkContext.broadcast(ByteBpe(load_ranks(vocabulary), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                encoded = coder.value.encode_many(texts_of(part))
                decoded = coder.value.decode_many(encoded)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(e) // 4 for e in encoded], pa.int64()),
                        pa.array([hashlib.sha256(e).hexdigest() for e in encoded]),
                        pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _frame(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
