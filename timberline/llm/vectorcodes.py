"""Vector code compression: product quantisation in whole numbers, by Hamerly's form of Lloyd's rounds.

Components become integers, vectors are cut into parts, and each part position has
a codebook. The vectors stay in a table in the shared folder, together with each
part's code and two bounds: one on the distance to its own entry from above, one on
the distance to the second nearest entry from below. When entries move, the bounds
move with them; a part is compared with all entries of its codebook only where they
no longer rule out another nearest one, strictly: where distances may be equal it is
compared, and the lower index wins. Bounds are rounded outwards, distances are
whole numbers, so the codes are those of a full comparison.

A round reads the table, writes the next one, and adds up sums per entry in the
tasks; the driver sees only codebooks (64 entries, so 64 times a vector's length).
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import cut, ensure_checkpoint_dir

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Distances compared at once in a worker.
BLOCK = 1 << 20
#: Labels up to which their sums are broadcast; more are joined by merge.
BROADCAST_LABELS = 1 << 16
STATE = "vec_id {id}, label {label}, ints array<int>, code binary, upper array<float>, lower array<float>"
_LARGEST = (1 << 63) - 1


def limit_of(length: int) -> int:
    """The largest integer component for which a vector's summed squared distance fits a long."""
    return min(math.isqrt(_LARGEST // (4 * max(length, 1))), (1 << 31) - 1)


def fit_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, e) of the rows that can be coded: no null vector, no null or non-finite component."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    return vectors.where(e.isNotNull() & ~bad).select("vec_id", label, e.alias("e"))


def whole_numbers(fit: DataFrame, length: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, ints): floor(scale * x), with zeros up to ``length``; what would not fit a long later is held at the limit."""
    most = limit_of(length)
    ints = F.transform("e", lambda x: F.least(F.greatest(F.floor(x * scale), F.lit(-most)), F.lit(most)).cast("int"))
    return fit.select("vec_id", "label", F.concat(ints, F.array_repeat(F.lit(0), F.lit(length) - F.size("e"))).alias("ints"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel(), kind))


def up(x: np.ndarray) -> np.ndarray:
    """Float32 numbers that are not below ``x``."""
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """Float32 numbers that are not above ``x``."""
    return np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the parts ``x`` (n, d) in the codebook ``book`` (entries, d): nearest entry, its squared distance, that of the second nearest (-1: none)."""
    code, best, second = (np.empty(len(x), np.int64) for _ in range(3))
    step = max(1, BLOCK // len(book))
    for s in range(0, len(x), step):
        part = x[s : s + step]
        far = np.zeros((len(part), len(book)), np.int64)
        for j in range(x.shape[1]):
            diff = part[:, j, None] - book[None, :, j]
            far += diff * diff
        at, rows = far.argmin(axis=1), np.arange(len(part))  # the first of equal ones
        code[s : s + step], best[s : s + step] = at, far[rows, at]
        if len(book) > 1:
            far[rows, at] = np.iinfo(np.int64).max
            second[s : s + step] = far.min(axis=1)
        else:
            second[s : s + step] = -1
    return code, best, second


def moves(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry: how far it moved at most, how far any other moved at most, and half the way to the nearest other entry at least."""
    moved = np.sqrt(((new - old) ** 2).sum(axis=1).astype(np.float64))
    others = np.zeros_like(moved)
    half = np.full(len(new), np.inf)
    if len(new) > 1:
        top = moved.argsort()[-2:]
        others[:] = moved[top[1]]
        others[top[1]] = moved[top[0]]
        for k in range(len(new)):
            way = ((np.delete(new, k, axis=0) - new[k]) ** 2).sum(axis=1).min()
            half[k] = math.sqrt(int(way)) / 2
    return moved, others, half


def bounded(x: np.ndarray, book: np.ndarray, moved: tuple[np.ndarray, np.ndarray, np.ndarray], code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and bounds of the parts ``x`` after the entries moved to ``book``; and how many were compared with all entries."""
    own, others, half = (m[code] for m in moved)
    upper, lower = up(upper.astype(np.float64) + own), down(lower.astype(np.float64) - others)
    rival = np.maximum(lower, down(half))
    open_ = np.flatnonzero(~(upper < rival))
    upper[open_] = up(np.sqrt(((x[open_] - book[code[open_]]) ** 2).sum(axis=1).astype(np.float64)))
    open_ = open_[~(upper[open_] < rival[open_])]
    if len(open_):
        found, best, second = nearest(x[open_], book)
        code = code.copy()
        code[open_], upper[open_] = found, up(np.sqrt(best.astype(np.float64)))
        lower[open_] = np.where(second < 0, np.inf, down(np.sqrt(np.maximum(second, 0).astype(np.float64))))
    return code, upper, lower, len(open_)


def _assigned(batch: pa.RecordBatch, books: np.ndarray, moved: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts (n, parts, d), codes, upper and lower bounds (n, parts) of a batch of the state; ``moved``: how the entries moved since its codes were found."""
    parts, _, d = books.shape
    x = _matrix(batch.column("ints"), parts * d).astype(np.int64).reshape(-1, parts, d)
    codes = np.empty((len(x), parts), np.uint8)
    upper, lower = (np.empty((len(x), parts), np.float32) for _ in range(2))
    if moved:
        codes[:] = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
        upper[:], lower[:] = (_matrix(batch.column(c), parts) for c in ("upper", "lower"))
    for p in range(parts):
        if moved:
            codes[:, p], upper[:, p], lower[:, p], _ = bounded(x[:, p], books[p], moved[p], codes[:, p].astype(np.int64), upper[:, p], lower[:, p])
        else:
            codes[:, p], best, second = nearest(x[:, p], books[p])
            upper[:, p] = up(np.sqrt(best.astype(np.float64)))
            lower[:, p] = np.where(second < 0, np.inf, down(np.sqrt(np.maximum(second, 0).astype(np.float64))))
    return x, codes, upper, lower


def _assigner(books: np.ndarray, before: np.ndarray | None, last: bool = False) -> Callable:
    """A ``mapInArrow`` function: the state with codes and bounds for ``books`` (parts, entries, d), or if ``last`` codes and errors; ``before``: the books that its codes belong to."""
    moved = None if before is None else [moves(a, b) for a, b in zip(before, books, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes, upper, lower = _assigned(batch, books, moved)
            own = {"vec_id": batch.column("vec_id"), "label": batch.column("label")}
            if last:
                error = sum(((x[:, p] - books[p][codes[:, p]]) ** 2).sum(axis=1) for p in range(len(books)))
                own |= {"code": pa.array([r.tobytes().hex() for r in codes]), "error": pa.array(error)}
            else:
                own |= {"ints": batch.column("ints"), "code": pa.array([r.tobytes() for r in codes], pa.binary()), "upper": _lists(upper, pa.float32()), "lower": _lists(lower, pa.float32())}
            yield pa.RecordBatch.from_arrays(list(own.values()), names=list(own))

    return run


def _summer(shape: tuple[int, int, int]) -> Callable:
    """A ``mapInArrow`` function: (slot, n, total) of each component of each used entry, once a task."""
    parts, entries, d = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("ints"), parts * d).reshape(-1, parts, d)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                for j in range(d):  # whole numbers below 2^53, so exact
                    total[p, :, j] += np.bincount(codes[:, p], x[:, p, j], entries).astype(np.int64)
        used = np.repeat(count.ravel(), d) > 0
        if used.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(used)), pa.array(np.repeat(count.ravel(), d)[used]), pa.array(total.ravel()[used])], names=["slot", "n", "total"])

    return run


def updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each used entry at the floor of its parts' mean."""
    rows = state.select("ints", "code").mapInArrow(_summer(books.shape), "slot long, n long, total long")
    sums = rows.groupBy("slot").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # a row a component of a codebook
    out = books.copy().ravel()
    for r in sums:
        out[r.slot] = int(r.total) // r.n
    return out.reshape(books.shape)


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row of ``vectors`` (vec_id, embedding, label) that can be coded.

    Vectors that are null or hold null or non-finite components are dropped. The
    codebooks start as the parts of the ``entries`` rows with the smallest vec_ids (nulls
    last; equal ids by label, then vector), or of all rows if there are fewer. Vectors
    shorter than the longest, or than a multiple of ``parts``, count as followed by zeros.
    Components beyond ``limit_of`` are held there, so that every error fits a long; a
    label's sum is held at the largest long. Equal vectors get equal codes; repeated rows
    stay; a missing label column counts as null; other columns are ignored; a table
    without rows that can be coded gives an empty frame.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes are bytes: 1 to 256 entries")
    spark, fit = vectors.sparkSession, fit_rows(vectors)
    longest = fit.agg(F.max(F.size("e"))).first()[0]
    kinds = dict(fit.dtypes)
    if longest is None:
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    d = max(1, -(-longest // parts))
    given = whole_numbers(fit, parts * d, scale)
    first = given.orderBy(F.col("vec_id").asc_nulls_last(), "label", "ints").limit(entries).select("ints").collect()
    books = np.array([r.ints for r in first], np.int64).reshape(len(first), parts, d).transpose(1, 0, 2)
    schema, folder = STATE.format(id=kinds["vec_id"], label=kinds["label"]), f"{ensure_checkpoint_dir(spark)}/codes-{uuid.uuid4().hex}"
    state, before = given, None
    for k in range(rounds):
        state.mapInArrow(_assigner(books, before), schema).write.parquet(f"{folder}/{k}")
        state = spark.read.schema(schema).parquet(f"{folder}/{k}")
        before, books = books, updated(state, books)
    coded = cut(state.mapInArrow(_assigner(books, before, last=True), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return with_label_errors(coded).withColumn("codebooks_sha256", F.lit(digest))


def with_label_errors(coded: DataFrame, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """``coded`` (vec_id, label, code, error) with the errors' sum over equal labels; null labels together."""
    whole = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LARGEST).cast("decimal(38,0)")).cast("long")
    sums = cut(coded.groupBy(F.col("label").alias("_label")).agg(whole.alias("label_error")))
    few = sums.limit(broadcast_labels + 1).count() <= broadcast_labels
    joined = coded.join(F.broadcast(sums) if few else sums.hint("merge"), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error")
