"""Spelling variant grouping by full neighbourhood generation.

Words are counted over all texts; each word emits every string that one deletion,
one replacement or one insertion over the observed alphabet makes of it, each once.
Those that are words themselves are found by a hash join with the vocabulary and need
no distance to be computed. A word emits some thousand strings, nearly none of which
is a word, so a bitmap of the vocabulary's hashes, of a size fixed beforehand, rules
most of them out before they are written and shuffled; the join decides on the strings.

A string's hash is a sum over its letters, so those of all neighbours come from sums
over a word's beginnings, without making the strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import cut

#: Runs of letters; A-Z are lower-cased.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: An occurrence loses a letter where this divides its checksum.
DROPS = 31
#: Bits of the bitmap: 16 MB, whatever the vocabulary.
BITS = 27
#: 64-bit slots of the bitmap that one task puts together.
BLOCK_SLOTS = 1 << 10
#: Neighbours made at once in a worker.
BLOCK = 1 << 20
#: Base of the letters' sums, odd and so invertible modulo 2^64; numbers of letters are drawn from this seed.
BASE, SEED = 0x9E3779B97F4A7C15, 20_240_607


def occurrences(docs: DataFrame, min_length: int = MIN_LENGTH, drops: int = DROPS) -> DataFrame:
    """(word) for each run of letters in ``docs`` (doc_id, text) that is long enough, with a letter left out where its checksum says so."""
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.where(F.char_length("run") >= min_length).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"), F.char_length("run").alias("size"))
    at = F.pmod("h", F.col("size")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    return runs.select(F.when(F.pmod("h", F.lit(drops)) == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; counts are combined before the shuffle."""
    counted = words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _numbers(letters: str) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, len(letters), np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.array([1, *[BASE] * n], np.uint64), dtype=np.uint64)


def _bits_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the bitmap."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(64 - BITS), (h >> np.uint64(10)) & np.uint64((1 << BITS) - 1)


def _by_length(words: list[str], letters: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``words``, letters' places in ``letters``) of the words of each length."""
    place = np.full(max(map(ord, letters), default=0) + 1, -1, np.int64)
    place[[ord(c) for c in letters]] = np.arange(len(letters))
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        points = np.frombuffer("".join(words[k] for k in at.tolist()).encode("utf-32-le"), np.uint32).reshape(-1, size)
        yield at, place[points]


def _marker(letters: str):
    """A ``mapInArrow`` function: (slot, bits), the bitmap's 64-bit slots that words set."""
    numbers = _numbers(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, spelt in _by_length(batch.column("word").to_pylist(), letters):
                bits = np.concatenate(_bits_of((numbers[spelt] * _powers(spelt.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array((bits >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bits & np.uint64(63))).view(np.int64))], names=["slot", "bits"])

    return run


def _packed(table: pa.Table) -> pa.Table:
    """The slots of one block of the bitmap, put together."""
    block, slots = table.column("block")[0].as_py(), np.zeros(BLOCK_SLOTS, np.int64)
    np.bitwise_or.at(slots, table.column("slot").to_numpy() % BLOCK_SLOTS, table.column("bits").to_numpy())
    return pa.table({"block": pa.array([block], pa.int64()), "packed": pa.array([slots.tobytes()], pa.binary())})


def bitmap_of(vocab: DataFrame, letters: str) -> np.ndarray:
    """The bitmap of all words' hashes. Its blocks are put together by the tasks; the driver gets them packed, 2^(BITS - 3) bytes at most."""
    marks = vocab.select("word").mapInArrow(_marker(letters), "slot long, bits long").withColumn("block", F.floor(F.col("slot") / BLOCK_SLOTS))
    out = np.zeros(1 << (BITS - 6), np.int64)
    for batch in marks.groupBy("block").applyInArrow(_packed, "block long, packed binary").toArrow().to_batches():
        for block, packed in zip(batch.column("block").to_pylist(), batch.column("packed"), strict=True):
            out[block * BLOCK_SLOTS : (block + 1) * BLOCK_SLOTS] = np.frombuffer(packed.as_buffer(), np.int64)
    return out.view(np.uint64)


def neighbours(spelt: np.ndarray, letters: str, keep) -> Iterator[tuple[int, str]]:
    """(row, neighbour) for every distinct string that one edit makes of the words ``spelt`` (n, size) and whose hash passes ``keep``.

    Of a run of equal letters only the first is deleted, and a letter is inserted
    only in front of a run of its own: the other places give the same strings.
    """
    numbers, (n, size) = _numbers(letters), spelt.shape
    inverse, power = np.uint64(pow(BASE, -1, 1 << 64)), _powers(size)
    value = numbers[spelt] * power[:-1]
    upto = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(value, axis=1, dtype=np.uint64)], axis=1)
    whole, every = upto[:, -1:], np.arange(len(letters))
    chars = np.array(list(letters))
    before = np.concatenate([np.full((n, 1), -1), spelt], axis=1)  # the letter in front of each place

    def text(row: int, start: int, middle: str, end: int) -> str:
        return "".join(chars[spelt[row, :start]]) + middle + "".join(chars[spelt[row, end:]])

    gone = keep(upto[:, :-1] + (whole - upto[:, 1:]) * inverse) & (before[:, :-1] != spelt)
    for row, i in zip(*(x.tolist() for x in np.nonzero(gone)), strict=True):
        yield row, text(row, i, "", i + 1)
    for i in range(size + 1):
        added = upto[:, i, None] + numbers[None, :] * power[i] + ((whole[:, 0] - upto[:, i]) * np.uint64(BASE))[:, None]
        ok = keep(added) & (every[None, :] != before[:, i, None])
        for row, c in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
            yield row, text(row, i, letters[c], i)
        if i == size:
            break
        other = (whole[:, 0] - value[:, i])[:, None] + numbers[None, :] * power[i]
        ok = keep(other) & (every[None, :] != spelt[:, i, None])
        for row, c in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
            yield row, text(row, i, letters[c], i + 1)


def candidates(vocab: DataFrame, letters: str, bitmap: np.ndarray) -> DataFrame:
    """(word, near): strings that one edit makes of a word and that the bitmap does not rule out; each once."""
    shared = vocab.sparkSession.sparkContext.broadcast(bitmap)

    def keep(h: np.ndarray) -> np.ndarray:
        one, two = _bits_of(h)
        set_ = (shared.value[one >> np.uint64(6)] >> (one & np.uint64(63))) & np.uint64(1) == 1
        at = two[set_]
        set_[set_] = (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return set_

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            for at, spelt in _by_length(words, letters):
                step = max(1, BLOCK // (len(letters) * spelt.shape[1]))
                for s in range(0, len(at), step):
                    found = list(neighbours(spelt[s : s + step], letters, keep))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([words[at[s + r]] for r, _ in found]), pa.array([t for _, t in found])], names=["word", "near"])

    return vocab.select("word").mapInArrow(run, "word string, near string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's way along ``forms`` (word, form), whose words are distinct and whose ways do not close.

    Each round follows twice as many forms as the one before.
    """
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        after = cut(at.join(onward, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        at = after.drop("moved")
        if after.where("moved").isEmpty():
            return at


def group_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, drops: int = DROPS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``docs`` (doc_id, text).

    Words are near if one inserted, deleted or replaced letter makes one of the other. A
    word's form is its near word with the largest n (ties: the first in code-point order)
    if that is ``ratio`` times its own at least, else null; the root is where the
    forms end, the word itself without one.

    Null texts have no words; a null doc_id counts as an empty one; rows that are
    repeated count again; texts and words of any length are read whole; an empty
    table gives an empty frame; other columns are ignored.
    """
    vocab = cut(vocabulary(occurrences(docs, min_length, drops), min_length, min_count))
    letters = "".join(sorted(r.c for r in vocab.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()))  # as many as RUN has at most
    if not letters:
        return vocab.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    near = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge")  # both sides grow
    met = candidates(vocab, letters, bitmap_of(vocab, letters)).join(near, "near")
    best = met.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    formed: Column = -F.col("best.less") >= ratio * F.col("n")
    table = vocab.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"),
    )
    table = cut(table)
    ends = roots(table.where(F.col("form").isNotNull()))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
