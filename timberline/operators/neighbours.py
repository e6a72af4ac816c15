"""Nearest neighbours on adaptive leaves (JN4-6, FLT11, UDF6).

Space is cut where the targets are: a k-d tree is split at the medians of a bounded
sample until a leaf holds about ``LEAF`` targets, so a dense spot gets many small
leaves and an empty region few large ones. The queries of a leaf are dealt into shares
of at most ``SHARE``, each of which meets the leaf's targets in one task. A query is
settled when no other leaf's box lies within its k-th distance; else it asks the
nearest of those leaves, and more of them in each further round while there are any. The
driver holds the tree, its boxes and counts (``MAX_LEAVES`` leaves), nothing more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators.graph import checkpointed

#: Targets that a leaf holds about, as long as there are at most ``MAX_LEAVES`` leaves.
LEAF = 512
MAX_LEAVES = 1 << 14
#: Targets whose places decide on the tree.
SAMPLE = 1 << 17
#: Queries that meet a leaf's targets in one task.
SHARE = 1 << 13
#: Queries, or targets that are sent to them, of a task about, where there are enough.
TASK = 1 << 15
#: Distances computed at once in a worker, and targets beyond which a leaf is cut once more there.
BLOCK = 1 << 18
LOCAL = 1 << 11
#: Pairs of a query and a node of the tree looked at together in a worker.
PAIRS = 1 << 19
#: Leaves that a query asks in the second round; each later round asks four times as many.
ASKS = 4
#: Shares of the targets in one place.
_SALTS = 64


class Tree:
    """A k-d tree over points (n, dims): arrays by node, leaves numbered from 0."""

    def __init__(self, points: np.ndarray, leaf: int, max_leaves: int = MAX_LEAVES, first: bool = False):
        """Split at medians until ``leaf`` points are left; along the widest side, or with ``first`` along dimension 0 while it differs."""
        self.dim, self.at, self.kids, self.leaf = [], [], [], []
        self.n_leaves, stack = 0, [(points, -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            node = len(self.dim)
            if parent >= 0:
                self.kids[parent][side] = node
            split = self._split(rows, first) if len(rows) > leaf and len(stack) + self.n_leaves + 2 <= max_leaves else None
            self.dim.append(split[0] if split else 0)
            self.at.append(split[1] if split else 0.0)
            self.kids.append([-1, -1])
            self.leaf.append(-1 if split else self.n_leaves)
            if split:
                left = rows[:, split[0]] < split[1]
                stack += [(rows[~left], node, 1), (rows[left], node, 0)]
            else:
                self.n_leaves += 1
        self.dim, self.at, self.kids, self.leaf = np.array(self.dim), np.array(self.at), np.array(self.kids), np.array(self.leaf)

    @staticmethod
    def _split(rows: np.ndarray, first: bool) -> tuple[int, float] | None:
        low, high = rows.min(axis=0), rows.max(axis=0)
        order = np.argsort(low - high, kind="stable").tolist()
        for d in [0, *order] if first else order:
            if high[d] > low[d]:
                middle = float(np.partition(rows[:, d], len(rows) // 2)[len(rows) // 2])
                return d, middle if middle > low[d] else float(rows[rows[:, d] > low[d], d].min())
        return None

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        open_ = np.flatnonzero(self.leaf[node] < 0)
        while len(open_):
            at = node[open_]
            node[open_] = self.kids[at, (points[open_, self.dim[at]] >= self.at[at]).astype(int)]
            open_ = open_[self.leaf[node[open_]] < 0]
        return self.leaf[node]

    def bounded(self, low: np.ndarray, high: np.ndarray) -> Tree:
        """Keep the leaves' boxes (leaves, dims), inf to -inf where one is empty, and those of the nodes above."""
        self.low = np.full((len(self.leaf), low.shape[1]), np.inf)
        self.high = -self.low
        ends = np.flatnonzero(self.leaf >= 0)
        self.low[ends], self.high[ends] = low[self.leaf[ends]], high[self.leaf[ends]]
        for node in range(len(self.leaf) - 1, -1, -1):  # children come after their parents
            if self.leaf[node] < 0:
                self.low[node], self.high[node] = self.low[self.kids[node]].min(axis=0), self.high[self.kids[node]].max(axis=0)
        return self

    def within(self, points: np.ndarray, reach: np.ndarray, keyed: bool, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, distance) of the leaves whose box is no farther than ``reach`` from each point; of dimension 0 the boxes must hold the point's if ``keyed``."""
        out, stack = [], [(np.arange(len(points)), np.zeros(len(points), np.int64))]
        while stack:  # (row, node) pairs, a level of the tree at once
            rows, node = stack.pop()
            if len(rows) > PAIRS:
                stack += [(rows[k : k + PAIRS], node[k : k + PAIRS]) for k in range(0, len(rows), PAIRS)]
                continue
            far, kept = self._far(points, rows, node, keyed)
            near = (far <= reach[rows]) & kept
            rows, node, far = rows[near], node[near], far[near]
            end = self.leaf[node] >= 0
            if end.any():
                out.append((rows[end], self.leaf[node[end]], far[end]))
            if not end.all():
                stack.append((np.repeat(rows[~end], 2), self.kids[node[~end]].ravel()))
        if not out:
            none = np.empty(0, np.int64)
            return none, none, np.empty(0)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _far(self, points: np.ndarray, rows: np.ndarray, node: np.ndarray, keyed: bool) -> tuple[np.ndarray, np.ndarray]:
        """(distance, whether the node's box may hold an answer) of pairs of a row and a node."""
        at = points[rows]
        gap = np.maximum(np.maximum(self.low[node] - at, at - self.high[node]), 0.0)
        far = np.sqrt(sum(gap[:, d] * gap[:, d] for d in range(int(keyed), gap.shape[1])))
        return far, np.isfinite(far) & ((gap[:, 0] == 0) if keyed else True)

    def reached(self, points: np.ndarray, leaf: np.ndarray, reach: float, keyed: bool) -> np.ndarray:
        """Whether the box of each point's ``leaf`` is no farther than ``reach``."""
        far, kept = self._far(points, np.arange(len(points)), np.flatnonzero(self.leaf >= 0)[np.argsort(self.leaf[self.leaf >= 0])][leaf], keyed)
        return (far <= reach) & kept


def closest(targets: np.ndarray, queries: np.ndarray, k: int, same: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, target, distance), each query's ``k`` nearest in order; of equal distances the earlier target. ``same``: labels of targets and queries that must be equal."""
    out, step = [], max(1, BLOCK // max(1, len(targets)))
    for s in range(0, len(queries), step):
        part = queries[s : s + step]
        far = np.zeros((len(part), len(targets)))
        for d in range(targets.shape[1]):
            diff = targets[None, :, d] - part[:, None, d]
            far += diff * diff
        far = np.sqrt(far)
        if same is not None:
            far[same[1][s : s + step, None] != same[0][None, :]] = np.inf
        if k == 1:
            rows, at = np.arange(len(part)), far.argmin(axis=1)
        else:
            bound = np.partition(far, min(k, len(targets)) - 1, axis=1)[:, min(k, len(targets)) - 1]
            rows, at = np.nonzero(far <= bound[:, None])
            order = np.lexsort((at, far[rows, at], rows))
            rows, at = rows[order], at[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, at = rows[place < k], at[place < k]
        dist = far[rows, at]
        met = np.isfinite(dist)
        out.append((rows[met] + s, at[met], dist[met]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def closest_in_leaf(targets: np.ndarray, queries: np.ndarray, k: int, same: tuple[np.ndarray, np.ndarray] | None = None, local: int = LOCAL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``closest``; many targets are cut into groups, and a group of queries meets only the groups that its largest distance reaches."""
    if len(targets) <= local:
        return closest(targets, queries, k, same)
    tree = Tree(targets, local // 4)
    mine, theirs = tree.leaf_of(targets), tree.leaf_of(queries)
    members = np.split(np.argsort(mine, kind="stable"), np.cumsum(np.bincount(mine, minlength=tree.n_leaves))[:-1])
    tree.bounded(*(np.array([f(targets[m], axis=0, initial=e) for m in members]) for f, e in ((np.min, np.inf), (np.max, -np.inf))))
    out = []
    for g in np.unique(theirs).tolist():
        asked = np.flatnonzero(theirs == g)
        label = lambda at: None if same is None else (same[0][at], same[1][asked])  # noqa: B023, E731
        reach = np.full(len(asked), np.inf)
        if len(members[g]):
            q, _, dist = closest(targets[members[g]], queries[asked], k, label(members[g]))
            top = np.zeros(len(asked))
            np.maximum.at(top, q, dist)
            reach = np.where(np.bincount(q, minlength=len(asked)) == k, top, np.inf)
        at = np.sort(np.concatenate([members[x] for x in np.unique(tree.within(queries[asked], reach, False)[1]).tolist()]))
        q, t, dist = closest(targets[at], queries[asked], k, label(at))
        out.append((asked[q], at[t], dist))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else closest(targets, queries, k, same)


def _places(table: pa.Table | pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in columns]).astype(np.float64)


def _in_order(table: pa.Table, column: str) -> pa.Table:
    """Rows by an id, which may be a structure."""
    ids = pa.table({"_tid": table.column(column)})
    while any(pa.types.is_struct(f.type) for f in ids.schema):
        ids = ids.flatten()
    return table.take(pc.sort_indices(ids, [(c, "ascending") for c in ids.column_names], null_placement="at_start"))


def _added(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def _dealt(tree, columns: list[str], shares: np.ndarray, spread: bool) -> Callable:
    """A ``mapInArrow`` function: rows with _leaf and _share. Queries (which name their leaf and a number) get one share, with ``spread`` targets get all shares of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if spread:
                leaf = tree.value.leaf_of(_places(batch, columns))
                rows = np.repeat(np.arange(len(leaf)), shares[leaf])
                share = np.arange(len(rows)) - np.repeat(np.cumsum(shares[leaf]) - shares[leaf], shares[leaf])
                batch = _added(batch.take(pa.array(rows)), _leaf=pa.array(leaf[rows].astype(np.int32)), _share=pa.array(share.astype(np.int32)))
            else:
                share = batch.column("_h").to_numpy() % np.maximum(shares[batch.column("_leaf").to_numpy()], 1)
                batch = _added(batch, _share=pa.array(share.astype(np.int32)))
            yield batch

    return run


def _one_place(targets: DataFrame, place: list[str], k: int) -> DataFrame:
    """Of the targets in one place the ``k`` with the least ids; a place may hold any number of them."""
    if k == 1:
        rest = [c for c in targets.columns if c not in place and c != "_tid"]
        return targets.groupBy(*place).agg(F.min(F.struct("_tid", *rest)).alias("_m")).select(*place, "_m.*")
    least = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_tid"))
    some = targets.withColumn("_s", F.pmod(F.xxhash64("_tid"), F.lit(_SALTS)))
    some = some.withColumn("_n", least(*place, "_s")).where(F.col("_n") <= k)
    return some.withColumn("_n", least(*place)).where(F.col("_n") <= k).drop("_n", "_s")


def nearest(
    queries: DataFrame, targets: DataFrame, k: int = 1, dims: tuple[str, ...] = ("x", "y"), query_id: str = "pid", target_id: str = "gid", values: tuple[str, ...] = (), limit: float | None = None, keys: tuple[str, ...] = (), leaf: int = LEAF, share: int = SHARE, asks: int = ASKS
) -> DataFrame:
    """kNN join: (query_id, rank, dist, target_id, values) of the ``k`` nearest targets, ties to the smallest id.

    With ``limit`` only targets nearer than that count. Targets answer queries with equal
    ``keys`` (not null) only; the tree is then split by key first. Of targets in one place
    only the ``k`` with the least ids are met. Rows with a null coordinate, or one
    that is no number, have no neighbours. Of queries with equal ids the nearest answers count where ``k`` is 1;
    otherwise ids must be distinct. No queries or no targets give an empty frame.
    """
    spark, keyed = queries.sparkSession, bool(keys)

    def side(frame: DataFrame, own: str, id_: str, more: tuple[str, ...]) -> DataFrame:
        known: list[Column] = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in dims] + [F.col(c).isNotNull() for c in keys]
        hashed = [F.xxhash64(*keys).alias("_k"), F.shiftright(F.xxhash64(*keys), 11).cast("double").alias("_d0")] if keyed else []
        return frame.where(reduce(lambda a, b: a & b, known)).select(F.col(id_).alias(own), *hashed, *[F.col(c).cast("double").alias(f"_d{n}") for n, c in enumerate(dims, int(keyed))], *more)

    place = [f"_d{n}" for n in range(len(dims) + keyed)]
    same = ["_k"] if keyed else []
    t = checkpointed(_one_place(side(targets, "_tid", target_id, values), [*place, *same], k))
    q = side(queries, "_qid", query_id, ())
    kinds = dict(q.dtypes) | dict(t.dtypes)
    kept = ", ".join(f"{c}: {kinds[c]}" for c in ("_tid", *values))
    hit = f"array<struct<dist: double, {kept}>>"
    n = t.count()
    if n == 0:
        return spark.createDataFrame([], f"{query_id} {kinds['_qid']}, rank int, dist double, {target_id} {kinds['_tid']}" + "".join(f", {c} {kinds[c]}" for c in values))
    every = max(1, -(-n // SAMPLE))
    seen = t.where(F.pmod(F.xxhash64("_tid", *place), F.lit(every)) == 0).select(*place).toArrow() if every > 1 else t.select(*place).toArrow()
    leaf = max(leaf, 4 * k)
    tree = Tree(_places(seen, place), max(1, leaf // every), first=keyed)
    sent = spark.sparkContext.broadcast(tree)

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _added(batch, _leaf=pa.array(sent.value.leaf_of(_places(batch, place)).astype(np.int32)))

    def schema(frame: DataFrame, *more: str) -> str:
        return ", ".join([*(f"{c} {kind}" for c, kind in frame.dtypes), *more])

    boxes = t.mapInArrow(located, schema(t, "_leaf int")).groupBy("_leaf").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{e}") for c in place for f, e in ((F.min, "a"), (F.max, "b"))]).collect()  # a row a leaf
    counts, low = np.zeros(tree.n_leaves, np.int64), np.full((tree.n_leaves, len(place)), np.inf)
    high = -low
    for r in boxes:
        counts[r._leaf] = r.n
        low[r._leaf], high[r._leaf] = [r[f"{c}a"] for c in place], [r[f"{c}b"] for c in place]
    bounded = spark.sparkContext.broadcast(tree.bounded(low, high))
    # a query whose own leaf has too few targets begins in the next one that has enough
    enough = np.flatnonzero(counts >= k)
    home = np.arange(tree.n_leaves) if not len(enough) else enough[np.minimum(np.searchsorted(enough, np.arange(tree.n_leaves)), len(enough) - 1)]
    if keyed:
        home = np.arange(tree.n_leaves)

    def homed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _places(batch, place)
            if limit is None:
                yield _added(batch, _leaf=pa.array(home[sent.value.leaf_of(points)].astype(np.int32)))
                continue
            own = sent.value.leaf_of(points)
            settled = bounded.value.reached(points, own, float(limit), keyed)
            other = np.flatnonzero(~settled)
            row, leaf_, far = bounded.value.within(points[other], np.full(len(other), float(limit)), keyed)  # what no box is near to has no neighbours
            order = np.lexsort((leaf_, far, row))
            rows, first = np.unique(row[order], return_index=True)
            own[other[rows]] = leaf_[order][first]
            settled[other[rows]] = True
            at = np.flatnonzero(settled)
            yield _added(batch.take(pa.array(at)), _leaf=pa.array(own[at].astype(np.int32)))

    def met(asked: DataFrame, ids: list[str]) -> DataFrame:
        """``ids`` and best (the k nearest of the leaf) of each row of ``asked`` (ids, places, _leaf), dealt by leaf and share."""
        wanted, rows = np.zeros(tree.n_leaves, np.int64), 0
        for r in asked.groupBy("_leaf").count().collect():  # a row a leaf
            wanted[r._leaf] = -(-r["count"] // share)
            rows += r["count"]
        rows = max(rows, int((wanted * counts).sum()))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(rows // TASK, int(wanted.sum()) // 4, 1 << 14))
        asked = asked.withColumn("_h", F.xxhash64(*ids[:1], *place))
        ours = asked.mapInArrow(_dealt(bounded, place, wanted, False), schema(asked, "_share int")).repartition(parts, "_leaf", "_share")
        theirs = t.mapInArrow(_dealt(bounded, place, wanted, True), schema(t, "_leaf int", "_share int")).repartition(parts, "_leaf", "_share")
        real = place[int(keyed) :]

        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            right = _in_order(right, "_tid")
            label = (right.column("_k").to_numpy(), left.column("_k").to_numpy()) if keyed else None
            none = not (left.num_rows and right.num_rows)
            rows, at, dist = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)) if none else closest_in_leaf(_places(right, real), _places(left, real), k, label)
            if limit is not None:
                rows, at, dist = rows[dist < limit], at[dist < limit], dist[dist < limit]
            order = np.argsort(rows, kind="stable")
            rows, at, dist = rows[order], at[order], dist[order]
            picked = right.select(["_tid", *values]).take(pa.array(at, pa.int64())).combine_chunks()
            columns = [picked.column(c).combine_chunks() for c in picked.column_names]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else pa.array([], c.type) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            found = pa.StructArray.from_arrays([pa.array(dist, pa.float64()), *columns], names=["dist", *picked.column_names])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=left.num_rows))]).astype(np.int32)
            return left.select(ids).append_column("best", pa.ListArray.from_arrays(pa.array(offsets), found))

        known = dict(asked.dtypes)
        by = ["_leaf", "_share"]
        return ours.groupBy(*by).cogroup(theirs.groupBy(*by)).applyInArrow(answer, ", ".join([*(f"{c} {known[c]}" for c in ids), f"best {hit}"]))

    def open_leaves(step: int) -> Callable:
        """A ``mapInArrow`` function: the next ``step`` leaves within each row's k-th distance, nearest first; the first that a row met is no more asked."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                points, reach = _places(batch, place), batch.column("_reach").to_numpy(zero_copy_only=False)
                row, leaf_, far = bounded.value.within(points, reach, keyed)
                other = leaf_ != batch.column("_leaf").to_numpy()[row]
                row, leaf_, far = row[other], leaf_[other], far[other]
                order = np.lexsort((leaf_, far, row))
                row, leaf_ = row[order], leaf_[order]
                at = np.arange(len(row)) - np.searchsorted(row, row)
                done = batch.column("_asked").to_numpy()[row]
                now = (at >= done) & (at < done + step)
                sizes = np.bincount(row[now], minlength=batch.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(leaf_[now].astype(np.int32)))
                yield _added(batch, _next=lists)

        return run

    reach = F.coalesce(F.get("best", F.lit(k - 1))["dist"], F.lit(float("inf") if limit is None else float(limit)))
    state = met(q.mapInArrow(homed, schema(q, "_leaf int")), ["_qid", *same, *place, "_leaf"]).withColumn("_asked", F.lit(0)).withColumn("_row", F.monotonically_increasing_id())
    done, step = None, asks
    while True:
        state = state.withColumn("_reach", reach)
        state = checkpointed(state.mapInArrow(open_leaves(step), schema(state, "_next array<int>")))
        settled = state.where(F.size("_next") == 0).select("_qid", "best")
        done = settled if done is None else done.union(settled)
        state = state.where(F.size("_next") > 0)
        if state.isEmpty():
            break
        asked = state.select("_row", *same, *place, F.explode("_next").alias("_leaf"))
        more = met(asked, ["_row"])
        rest = ["_qid", *same, *place, "_leaf"]
        both = state.select("_row", *rest, "_asked", "best").unionByName(more, allowMissingColumns=True)
        # a row has at most `step` answers; its own columns stand in one of them
        merged = both.groupBy("_row").agg(*[F.first(c, ignorenulls=True).alias(c) for c in rest], (F.max("_asked") + step).alias("_asked"), F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        state, step = merged, step * 4
    if k == 1:
        best = done.select("_qid", F.get("best", F.lit(0)).alias("b")).where(F.col("b").isNotNull()).groupBy("_qid").agg(F.min("b").alias("b")).withColumn("rank", F.lit(1))
    else:
        best = done.select("_qid", F.posexplode("best").alias("rank", "b")).withColumn("rank", F.col("rank") + 1)
    return best.select(F.col("_qid").alias(query_id), "rank", F.col("b.dist").alias("dist"), F.col("b._tid").alias(target_id), *[F.col(f"b.{c}").alias(c) for c in values])
