"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features are the presence of hashed words, pairs of neighbouring words and
pairs with one word between (skip-grams). Per-coordinate learning rates and L1
leave few weights other than zero, which are broadcast to score every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import text_chunks, texts_of

BITS = 22
#: Labelled rows that the model is fitted on, at most; chosen by the hash of their ids.
MAX_LABELLED = 32_768
#: Bytes of their features that the fitting task holds at most; later rows in its order are not learnt from.
MAX_FEATURE_BYTES = 512 << 20
#: Rate, L1 and passes have the least log loss on an inner fold (remainder 1) of the rows that may be learnt from.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 6.0, 0.1, 2
#: Fewest examples of either label from which the scores are calibrated.
MIN_CALIBRATION = 20
FOLDS = 5
_BIAS = 0
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), 95, 39, *range(128, 256)]] = True
_SHIFT = np.uint64(64 - BITS)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _K[3]
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every word, in order; words are runs of letters, digits, ``_`` and ``'``, lower-cased."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    flat = b"\0".join(raw) + bytes(40)
    buf = np.frombuffer(flat, np.uint8)
    edge = np.diff(_IS_WORD[buf].astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = ends - starts
    eight = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))
    h = lengths.astype(np.uint64) * _K[4]
    for k, at in enumerate((0, 8, 16)):  # the first 24 bytes ...
        left = np.clip(lengths - at, 0, 8)
        mask = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (left * 8).clip(0, 63).astype(np.uint64)) - np.uint64(1))
        h = _mix(h ^ ((eight[np.minimum(starts + at, len(eight) - 1)] & mask) * _K[k]))
    long = lengths > 24
    h[long] ^= eight[ends[long] - 8] * _K[5]  # ... and the last eight of longer words
    bounds = np.cumsum([len(r) + 1 for r in raw])
    return np.searchsorted(bounds, starts, side="right"), _mix(h)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate) of every feature occurrence; coordinate 0 is kept for the bias."""
    doc, h = word_hashes(texts)
    docs, found = [doc], [h]
    for gap, k in ((1, 0), (2, 1)):
        same = doc[gap:] == doc[:-gap] if len(doc) > gap else np.empty(0, bool)
        a, b = h[: len(same)][same], h[gap:][same] if len(same) else h[:0]
        docs.append(doc[: len(same)][same])
        found.append(_mix(a * _K[k] + (b ^ _K[2])))
    coordinate = (np.concatenate(found) >> _SHIFT).astype(np.int64)
    return np.concatenate(docs), np.maximum(coordinate, 1)


class Ftrl:
    """FTRL-proximal for logistic loss over binary features; coordinate 0 is an unpenalised bias."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        bias = (i == _BIAS) if isinstance(i, np.ndarray) else np.arange(len(z)) == _BIAS
        if bias.any():
            w[bias] = -z[bias] * self.alpha / (self.beta + np.sqrt(n[bias]))
        return w

    def learn(self, i: np.ndarray, label: int) -> None:
        """One example whose distinct active coordinates are ``i``."""
        w = self.weights(i)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[i]
        after = n + g * g
        self.z[i] += g - (np.sqrt(after) - np.sqrt(n)) / self.alpha * w
        self.n[i] = after


def held_out() -> Column:
    """Rows that are never learnt from: crc32 of the id as text is a multiple of ``FOLDS``, or there is no id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0, F.lit(True))


def _example_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_chunks(batch):
            doc, at = features(texts_of(part))
            keys = np.unique(doc * np.int64(1 << BITS) + at)
            cuts = np.searchsorted(keys, np.arange(1, part.num_rows) * np.int64(1 << BITS))
            blobs = [(k & ((1 << BITS) - 1)).astype("<i4").tobytes() for k in np.split(keys, cuts)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(blobs, pa.binary())], names=["doc_id", "label", "features"])


def _fit(batches: Iterator[pa.RecordBatch], epochs: int) -> Iterator[pa.RecordBatch]:
    examples, held = [], 0
    for batch in batches:
        for f, y in zip(batch.column("features").to_pylist(), batch.column("label").to_pylist(), strict=True):
            held += len(f)
            if held <= MAX_FEATURE_BYTES:
                examples.append((np.append(np.frombuffer(f, "<i4"), np.int32(_BIAS)), y))
    model, margins = Ftrl(), []
    for epoch in range(epochs):
        for i, y in examples:
            if not epoch:
                margins.append(model.weights(i).sum())  # before it is learnt from
            model.learn(i, y)
    if examples:
        half = len(examples) // 2
        slope, shift = calibration(np.array(margins[half:]), np.array([y for _, y in examples[half:]]))
        w = model.weights() * slope
        w[_BIAS] += shift
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), pa.array(w[kept])], names=["coordinate", "weight"])


def calibration(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make margins of unseen examples log-odds (logistic regression by Newton's method, steps halved until the loss falls).

    L1 keeps unseen texts' margins small; without this step 0.5 would be too
    high a bar. Targets lie a little inside 0 and 1 by the labels' numbers
    (Platt), so that labels which the margins part do not ask for a slope without end.
    """
    bad, good = labels.sum(), (1 - labels).sum()
    if min(bad, good) < MIN_CALIBRATION:
        return 1.0, 0.0
    target = np.where(labels == 1, (bad + 1) / (bad + 2), 1 / (good + 2))

    def loss(at: np.ndarray) -> float:
        m = at[0] * margins + at[1]
        return float((np.logaddexp(0, m) - target * m).sum())

    at = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1.0 / (1.0 + np.exp(-np.clip(at[0] * margins + at[1], -35, 35)))
        gradient = np.array([((q - target) * margins).sum(), (q - target).sum()])
        v = q * (1 - q)
        hessian = np.array([[(v * margins * margins).sum() + 1e-9, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(hessian, gradient)
        now, size = loss(at), 1.0
        while size > 1e-9 and not loss(at - size * step) <= now:
            size /= 2
        at = at - size * step if size > 1e-9 else at
        if size * np.abs(step).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if np.isfinite(at).all() and at[0] > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, epochs: int = EPOCHS) -> DataFrame:
    """(coordinate, weight) of the weights that are not zero, learnt from labelled rows outside the held-out fold.

    At most ``max_labelled`` labels are used, those with the smallest hash of
    their id, and ``MAX_FEATURE_BYTES`` of their features in the order of
    another hash, so the broadcast of the labels, the fitting task and the
    weights are bounded whatever the corpus' size. A document with contradicting labels
    is toxic; ids that several texts share count once, with the least feature set.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    usable = usable.where(F.col("label").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    usable = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    examples = text.join(F.broadcast(usable), "doc_id").mapInArrow(_example_batches, "doc_id long, label int, features binary")
    examples = examples.groupBy("doc_id").agg(F.min(F.struct("features", "label")).alias("e")).select("doc_id", "e.*")
    ordered = examples.repartition(1).sortWithinPartitions(F.xxhash64(F.col("doc_id"), F.lit(1)), "doc_id")
    return ordered.select("features", "label").mapInArrow(partial(_fit, epochs=epochs), "coordinate int, weight double")


class _Scorer:
    """The broadcast sparse weights, spread out once in each worker."""

    def __init__(self, docs: DataFrame, model: DataFrame):
        rows = model.select("coordinate", "weight").toArrow()  # at most 2^BITS rows of 12 bytes
        sparse = rows.column("coordinate").to_numpy().astype(np.int32), rows.column("weight").to_numpy().astype(np.float64)
        self.sent = docs.sparkSession.sparkContext.broadcast(sparse)

    def margins(self, texts: list[str], dense: np.ndarray) -> np.ndarray:
        """Log-odds of each text; minus infinity without a model."""
        if not len(self.sent.value[0]):
            return np.full(len(texts), -np.inf)
        doc, i = features(texts)
        hit = dense[i] != 0
        keys = np.unique(doc[hit] * np.int64(1 << BITS) + i[hit])
        return np.bincount(keys >> BITS, weights=dense[keys & ((1 << BITS) - 1)], minlength=len(texts)) + dense[_BIAS]

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.sent.value[0]] = self.sent.value[1]
        return out


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; only the text decides the score.

    Null and empty texts get the score of the bias alone (0 without a model);
    repeated rows stay; an empty table gives an empty frame; columns other than
    doc_id and text are ignored.
    """
    scorer = _Scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = scorer.dense()
        for batch in batches:
            for part in text_chunks(batch):
                with np.errstate(over="ignore"):
                    p = 1.0 / (1.0 + np.exp(-scorer.margins(texts_of(part), dense)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they are; nulls and empty texts as in :func:`score`."""
    scorer = _Scorer(docs, model)
    place = docs.schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = scorer.dense()
        for batch in batches:
            for part in text_chunks(batch, place):
                yield part.filter(pa.array(scorer.margins([t or "" for t in part.column(place).to_pylist()], dense) < 0))

    return docs.mapInArrow(run, docs.schema)
