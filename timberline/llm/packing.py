"""Packing documents into sequences of fixed length: dominance reduction, then best fit.

Pieces of equal length are interchangeable, so the whole instance is a
histogram with one count a length, however many documents there are. The
reduction after Martello and Toth runs on that histogram: it fixes small sets
of pieces that provably dominate every other filling of their sequence
(a piece nothing fits beside; a pair that fills a sequence exactly; the largest
partner where only one fits, or where one is at least as good as any two),
and shrinks the instance; best fit, longest first, packs the rest. The plan is
a list of patterns with multiplicities; each piece finds its place from its
rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import cut, text_chunks, texts_of

#: The split that a tokenizer file's ByteLevel step means (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITY = 1024
END = 2
#: Pieces of one length that are ranked together, about.
RANKED_TOGETHER = 1 << 18


class Tokens:
    """Ids of one tokenizer file of byte-level BPE; picklable.

    The file's own library gives the ids of texts that hold a special token's
    string and of vocabularies whose ids are not merge ranks; for all other
    texts the same merges run in the faster rank-table library.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            self.source = f.read()
        self.pattern = pattern
        spec = json.loads(self.source)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        # printable stand-ins of bytes in such files
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        back = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        self.ranks = None
        # the other library splits by the pattern alone and keeps whole pre-tokens of the vocabulary, as merging does unless merges are odd
        split = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        step, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plainly = spec.get("normalizer") is None and {k: step.get(k, True) for k in split} == split and pattern == BYTE_LEVEL
        plainly &= not any(model.get(k) for k in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        if plainly and all(c in back for t in vocab for c in t) and all(vocab[m.replace(" ", "")] == 256 + k for k, m in enumerate(merges)):
            self.ranks = {bytes(back[c] for c in t): i for t, i in vocab.items()}
        self._slow = self._fast = None

    def __getstate__(self):
        return self.__dict__ | {"_slow": None, "_fast": None}

    def ids(self, text: str) -> np.ndarray:
        if self.ranks is None or any(s in text for s in self.special):
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_str(self.source)
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)
        if self._fast is None:
            import tiktoken

            self._fast = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self._fast.encode_to_numpy(text, disallowed_special=())


def cut_points(n: int, capacity: int = CAPACITY) -> list[int]:
    """Starts of the pieces of ``n`` ids: one piece if they fit, else full pieces after a first one that may be shorter."""
    if n <= capacity:
        return [0]
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


def pieces(docs: DataFrame, tokens: Tokens, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece; each document ends with the id ``end``."""
    sent = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_of(part), strict=True):
                    ids = np.append(sent.value.ids(text), np.uint32(end)).astype("<u4")
                    starts = cut_points(len(ids), capacity)
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                        rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[list[tuple[int, int]], int]  # [(length, how many)], sequences alike


class _Histogram:
    """Counts by length with the lengths in use sorted."""

    def __init__(self, counts: dict[int, int]):
        self.count = {w: c for w, c in counts.items() if c}
        self.lengths = sorted(self.count)

    def take(self, w: int, n: int) -> None:
        self.count[w] -= n
        if not self.count[w]:
            del self.count[w]
            self.lengths.remove(w)

    def smallest(self, without: int, n: int) -> list[int]:
        """Up to ``n`` smallest lengths, with repeats, leaving out one piece of length ``without``."""
        out: list[int] = []
        for w in self.lengths:
            out += [w] * min(n, self.count[w] - (w == without))
            if len(out) >= n:
                break
        return out[:n]

    def largest_at_most(self, room: int, without: int) -> int | None:
        k = bisect.bisect_right(self.lengths, room) - 1
        while k >= 0 and self.count[self.lengths[k]] - (self.lengths[k] == without) < 1:
            k -= 1
        return self.lengths[k] if k >= 0 else None

    def best_pair_at_most(self, room: int, without: int) -> int:
        """The largest sum of two pieces that fit in ``room`` (0 if none do)."""
        have = [(w, self.count[w] - (w == without)) for w in self.lengths if w < room]
        have = [(w, c) for w, c in have if c > 0]
        lo, hi, best = 0, len(have) - 1, 0
        while lo <= hi:
            total = have[lo][0] + have[hi][0]
            if lo == hi and have[lo][1] < 2:
                break
            if total <= room:
                best, lo = max(best, total), lo + 1
            else:
                hi -= 1
        return best


def reduce_by_dominance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns that some optimal packing contains, and the counts that remain."""
    left, fixed = _Histogram(counts), []
    for w in list(left.lengths):  # exact pairs first: they dominate for any piece
        other = capacity - w
        n = left.count.get(w, 0)
        if w == capacity and n:
            fixed.append(([(w, 1)], n))
            left.take(w, n)
        elif other == w and n >= 2:
            fixed.append(([(w, 2)], n // 2))
            left.take(w, n // 2 * 2)
        elif w > other > 0 and n and (m := min(n, left.count.get(other, 0))):
            fixed.append(([(w, 1), (other, 1)], m))
            left.take(w, m)
            left.take(other, m)
    changed = True
    while changed and left.lengths:
        changed = False
        for w in sorted(left.lengths, reverse=True):
            while (n := left.count.get(w, 0)):
                room, few = capacity - w, left.smallest(w, 3)
                if not few or few[0] > room:
                    fixed.append(([(w, 1)], n))
                    left.take(w, n)
                    changed = True
                    break
                two = len(few) > 1 and few[0] + few[1] <= room
                three = len(few) > 2 and sum(few) <= room
                partner = left.largest_at_most(room, w)
                if two and (three or partner < left.best_pair_at_most(room, w)):
                    break  # nothing provable for this length
                # with one partner at most, or none better than it, the largest partner dominates
                m = min(n, left.count[partner]) if partner != w else n // 2
                if two:
                    m = 1  # the best pair may change
                fixed.append(([(w, 1), (partner, 1)] if partner != w else [(w, 2)], m))
                left.take(w, m)
                left.take(partner, m)
                changed = True
    return fixed, dict(left.count)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best fit, longest first, on counts: equal sequences are kept together with their number."""
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []

    def put(room: int, items: list[tuple[int, int]], n: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((items, n))

    for w in sorted(counts, reverse=True):
        c = counts[w]
        while c:
            k = bisect.bisect_left(rooms, w)
            if k == len(rooms):
                room, items, n = capacity, [], -(-c // (capacity // w))
            else:
                room = rooms[k]
                items, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
            each = room // w  # the tightest sequence stays the tightest until nothing more fits
            whole = min(n, c // each)
            if whole:
                put(room - each * w, [*items, (w, each)], whole)
            c -= whole * each
            n -= whole
            if n and c:
                put(room - c * w, [*items, (w, c)], 1)
                n -= 1
                c = 0
            if n and room < capacity:
                put(room, items, n)
    return [p for room in rooms for p in open_[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use every piece of ``counts`` exactly once."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def intervals(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, per sequence, first sequence, offset): where the pieces of each rank go."""
    rows, used, sequence = [], {}, 0
    for items, n in patterns:
        offset = 0
        for w, each in items:
            rank = used.get(w, 0)
            rows.append((w, rank, rank + n * each, each, sequence, offset))
            used[w] = rank + n * each
            offset += w * each
        sequence += n
    return rows


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Only the histogram (``capacity`` rows) comes to the driver; the plan goes
    back as intervals of ranks whose number depends on ``capacity`` alone.
    Ranks are counted inside (length, bucket) and shifted by the counts of the
    buckets before; a length has as many buckets as its count asks for, so one
    that a third of all pieces have is spread out at any size.
    """
    spark = parts.sparkSession
    turned = cut(parts.withColumn("turn", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in turned.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    spread = spark.createDataFrame([(w, -(-n // RANKED_TOGETHER)) for w, n in counts.items()], "_w long, _buckets long")
    mixed = F.xxhash64("doc_id", "piece", "ids_crc32")
    # where one bucket does not do, repeated rows are dealt by their place in the input as well
    keyed = turned.join(F.broadcast(spread), F.col("length") == F.col("_w"))  # capacity rows at most
    keyed = keyed.withColumn("bucket", F.when(F.col("_buckets") > 1, F.pmod(mixed + F.col("turn"), F.col("_buckets"))).otherwise(F.lit(0)).cast("long"))
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    schema = "w long, first long, end long, each long, sequence long, at long"
    places = spark.createDataFrame(intervals(plan(counts, capacity)), schema)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(F.col("length").alias("_length"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start"))
    ranked = keyed.withColumn("own", own).join(shifts, (F.col("length") == F.col("_length")) & (F.col("bucket") == F.col("_bucket")))
    ranked = ranked.withColumn("rank", F.col("own") - 1 + F.col("shift"))
    # a plan has some intervals a length, bounded by ``capacity`` and not by the corpus
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("w")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    turn = F.col("rank") - F.col("first")  # within the interval
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(turn / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(turn, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Tokenize every row's whole text and pack the pieces; one row a piece.

    Null text is empty (the end id alone); repeated rows are packed as often as
    they occur; an empty table gives an empty frame; columns other than doc_id
    and text are ignored. ``tokenizer`` is a file that the driver can read.
    """
    return pack(pieces(docs, Tokens(tokenizer, pattern), capacity, end), capacity)
