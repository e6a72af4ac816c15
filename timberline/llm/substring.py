"""Substring dedup by sliding sentence spans.

A text is cut into sentences; the shortest runs of at least ``MIN_SENTENCES``
sentences and ``MIN_WORDS`` words that begin and that end at every sentence are
hashed, so that the runs inside a passage cover it to both its ends.
Runs are joined over the whole corpus by 88 bits of two hashes, so that chance
collisions stay away from a corpus of 10^12 runs; the first place of a run
(least doc_id, then text hash, then position) keeps it, and the sentences that
any later place of it covers are removed.

Sentences of more than ``LONG`` words are cut further at words chosen by their
hash, so that passages without full stops line up wherever they stand. With
these sizes every repeated passage of more than 50 words holds a whole run: up
to 16 words of its first sentence may belong to the text before it, and a run
ends within 31 words after that.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.common import by_text_chunks, text_chunks, texts_of

MIN_SENTENCES = 2
MIN_WORDS = 16
LONG = 16
#: Runs that a task holds at once to find repeats within its own partition.
HELD_RUNS = 1_000_000
_NO_ID = -(1 << 63)
_SPACE, _STOP, _CLOSING = (np.isin(np.arange(256), list(x)) for x in (b"\t\n\x0b\x0c\r ", b".!?", b"\"')]"))
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Sentences(NamedTuple):
    """Sentences of several texts: text number, byte range within the text, words and hash."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    hash: np.ndarray


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _K[3]
    return h ^ (h >> np.uint64(29))


def _word_hashes(flat: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes; ``flat`` ends with 32 spare bytes."""
    eight = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))
    sizes = ends - starts
    h = sizes.astype(np.uint64) * _K[4]
    for k, at in enumerate((0, 8, 16)):
        left = np.clip(sizes - at, 0, 8)
        mask = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (left * 8).clip(0, 63).astype(np.uint64)) - np.uint64(1))
        h = _mix(h ^ ((eight[starts + at] & mask) * _K[k]))
    for w in np.flatnonzero(sizes > 24):
        h[w] = xxhash.xxh3_64_intdigest(flat[starts[w] : ends[w]])
    return h


def split(texts: list[bytes]) -> Sentences:
    """The sentences of each UTF-8 text.

    A sentence ends with a word that ends in a full stop (closing quotes and
    brackets aside) or is followed by a line break. The ranges cover each text
    that has a word; the hash takes words only, so white space does not count.
    """
    flat = b"\n".join(texts) + b"\n" + bytes(32)
    buf = np.frombuffer(flat, np.uint8)[:-32]
    text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    text_starts = np.concatenate([[0], text_ends[:-1] + 1]) if len(texts) else text_ends
    edge = np.diff((~_SPACE[buf]).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        none = np.empty(0, np.int64)
        return Sentences(none, none, none, none, none.astype(np.uint64))
    h = _word_hashes(flat, starts, ends)
    doc = np.searchsorted(text_ends, starts)
    lines = np.cumsum(buf == 10)
    tail = buf[ends - 1]
    stop = _STOP[tail] | (_CLOSING[tail] & _STOP[buf[np.maximum(ends - 2, starts)]])
    stop[:-1] |= lines[starts[1:]] > lines[ends[:-1] - 1]
    stop[-1] = True

    def begins(stop: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.flatnonzero(stop[:-1]) + 1])

    for mask in (7, 3, 1):  # words that end a piece, more of them where pieces are still long
        first = begins(stop)
        sizes = np.diff(np.append(first, len(starts)))
        stop |= np.repeat(sizes > LONG, sizes) & ((h >> np.uint64(17)) & np.uint64(mask) == 0)
    first = begins(stop)
    sizes = np.diff(np.append(first, len(starts)))
    place = np.arange(len(starts)) - np.repeat(first, sizes)
    stop |= place % LONG == LONG - 1
    first = begins(stop)
    sizes = np.diff(np.append(first, len(starts)))
    place = np.arange(len(starts)) - np.repeat(first, sizes)
    of = doc[first]
    begin = starts[first] - text_starts[of]
    begin[np.append(True, of[1:] != of[:-1])] = 0
    end = np.append(begin[1:], 0)
    last = np.append(of[1:] != of[:-1], True)
    end[last] = (text_ends - text_starts)[of[last]]
    return Sentences(of, begin, end, sizes, np.add.reduceat(_mix(h + place.astype(np.uint64) * _K[0]), first))


def runs(s: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, number of sentences, hash, 24 bits of another) of the shortest long enough runs that begin or end at each sentence.

    A run has at most ``MIN_WORDS`` sentences, as each has a word.
    """
    n = len(s.doc)
    total, place = np.cumsum(s.words), np.arange(n)
    before = total - s.words
    last = np.maximum(np.searchsorted(total, before + MIN_WORDS), place + MIN_SENTENCES - 1)
    begin = np.minimum(np.searchsorted(before, total - MIN_WORDS, side="right") - 1, place - MIN_SENTENCES + 1)
    spans = np.concatenate([(place * n + last)[last < n], (begin * n + place)[begin >= 0]])
    spans = np.unique(spans)
    first, last = (spans // n, spans % n) if n else (spans, spans)
    whole = s.doc[first] == s.doc[last]
    first, size = first[whole], (last - first + 1)[whole]
    h, check = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        live = size > k
        one = s.hash[first[live] + k]
        h[live] = _mix((h[live] + _K[2]) * _K[1] ^ one)
        check[live] = _mix((check[live] ^ (one * _K[4])) * _K[0] + _K[3])
    return first, size, h, (check >> np.uint64(40)).astype(np.int64)


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a partition; of a run that repeats here only the first is left to be joined, later ones are known repeats."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        h, check, doc, mark, at, size = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((at, mark, doc, check, h))
        sh, sc, sd, sm, sa = h[order], check[order], doc[order], mark[order], at[order]
        new = np.append(True, (sh[1:] != sh[:-1]) | (sc[1:] != sc[:-1]))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        first = np.empty(len(h), bool)
        first[order] = (sd == sd[head]) & (sm == sm[head]) & (sa == sa[head])  # repeated rows are one text
        # known repeats of a text need no partner and go as few ranges; all in the order of documents, which packs well
        idx = np.flatnonzero(~first)
        d, m, a, e = doc[idx], mark[idx], at[idx], at[idx] + size[idx]
        other = np.append(True, (d[1:] != d[:-1]) | (m[1:] != m[:-1]) | (a[1:] < a[:-1]))[: len(idx)]
        reach = np.maximum.accumulate(np.cumsum(other) << 32 | e)
        begin = other.copy()
        begin[1:] |= a[1:] > (reach[:-1] & 0xFFFFFFFF)
        begin = np.flatnonzero(begin)
        length = (reach[np.append(begin[1:], len(idx)) - 1] & 0xFFFFFFFF) - a[begin] if len(idx) else begin
        d, m, a = d[begin], m[begin], a[begin]
        key = np.concatenate([h[first].view(np.int64), d * 1_000_003 ^ m])
        known = np.concatenate([np.zeros(int(first.sum()), bool), np.ones(len(d), bool)])
        columns = [key, known, np.concatenate([doc[first], d]), np.concatenate([mark[first], m]), np.concatenate([at[first] << 32 | check[first] << 8 | size[first], a << 32 | length])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "known", "doc", "mark", "run"])

    count = 0
    for batch in batches:
        for part in text_chunks(batch):
            s = split([t.encode("utf-8", "surrogatepass") for t in texts_of(part)])
            first, size, h, check = runs(s)
            of = s.doc[first]
            offset = np.searchsorted(s.doc, of)  # the text's first sentence
            held.append((h, check, part.column("doc").to_numpy()[of], part.column("mark").to_numpy()[of], first - offset, size))
            count += len(first)
            if count >= HELD_RUNS:
                yield flush()
                count = 0
    if count:
        yield flush()


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc, mark, run) of every run that has an earlier place, ``docs`` having (doc, mark, text).

    ``run`` is the first sentence's number times 2^32 plus the number of
    sentences. Repeats within a partition are settled there, so a run reaches
    the shuffle once a partition at most, however many documents share it.
    """
    rows = docs.select("doc", "mark", "text").mapInArrow(_run_rows, "key long, known boolean, doc long, mark long, run long")
    # runs that are not known repeats hold 24 bits of the check between their first sentence (32) and their size (8)
    place, check = F.struct("doc", "mark", "run"), F.when(F.col("known"), F.lit(0)).otherwise(F.shiftright("run", 8).bitwiseAND((1 << 24) - 1))
    first = F.min(place).over(Window.partitionBy("key", "known", "check"))
    found = rows.withColumn("check", check.cast("int")).withColumn("first", first).where(F.col("known") | (place != F.col("first")))
    sized = F.col("run").bitwiseAND(F.lit(~0xFFFFFFFF)).bitwiseOR(F.col("run").bitwiseAND(0xFF))
    return found.select("doc", "mark", F.when(F.col("known"), F.col("run")).otherwise(sized).alias("run"))


def _covered(text: str, hits: list[int]) -> tuple[str, int]:
    """The text without the sentences that the runs ``hits`` cover, and their number."""
    raw = text.encode("utf-8", "surrogatepass")
    s, at, size = split([raw]), np.array(hits) >> 32, np.array(hits) & 0xFFFFFFFF
    gone = np.zeros(len(s.doc) + 1, np.int64)
    np.add.at(gone, at, 1)
    np.add.at(gone, at + size, -1)
    covered = np.cumsum(gone[:-1]) > 0
    kept = b"".join(raw[a:b] for a, b in zip(s.start[~covered].tolist(), s.end[~covered].tolist(), strict=True))
    return kept.decode("utf-8", "surrogatepass"), int(covered.sum())


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated sentences removed from ``text`` and their number in ``removed_sentences`` (a clashing column is replaced).

    No row is dropped: a text of which every sentence is a later repeat becomes
    empty. Null and empty texts and those shorter than a run stay. Rows with
    the same doc_id and the same text are one document and are treated alike;
    null doc_ids come first in the order. An empty table gives an empty frame;
    other columns are kept.
    """
    docs = docs.drop("removed_sentences")
    place, schema = docs.columns.index("text"), docs.schema
    own = [f"c{k}" for k in range(len(docs.columns))]  # names that clash with nothing
    rows = docs.toDF(*own)
    doc_id, text = F.col(f"c{docs.columns.index('doc_id')}"), F.col(f"c{place}").cast("string")
    keyed = rows.withColumn("doc", F.coalesce(doc_id.cast("long"), F.lit(_NO_ID))).withColumn("mark", F.xxhash64(text))
    hits = repeated_runs(keyed.select("doc", "mark", text.alias("text"))).distinct()
    hits = hits.groupBy(F.col("doc").alias("_doc"), F.col("mark").alias("_mark")).agg(F.collect_list("run").alias("hits"))
    joined = keyed.join(hits, (F.col("doc") == F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left").select(*own, "hits")

    def rewrite(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, hits = batch.column(place).to_pylist(), batch.column(len(own)).to_pylist()
        new = [_covered(t, h) if h else (t, 0) for t, h in zip(texts, hits, strict=True)]
        field = batch.schema.field(place)
        out = batch.set_column(place, field, pa.array([t for t, _ in new], field.type))
        return out.set_column(len(own), "removed_sentences", pa.array([n for _, n in new], pa.int32()))

    types = T.StructType([T.StructField(c, f.dataType) for c, f in zip(own, schema, strict=True)]).add("removed_sentences", T.IntegerType())
    return joined.mapInArrow(by_text_chunks(rewrite, place), types).toDF(*schema.names, "removed_sentences")
