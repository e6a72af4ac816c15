"""Sample selection for annotation (AL1-8, JN7, JN8)."""

from __future__ import annotations

import heapq
import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.operators.graph import checkpointed

#: Codes in one block of the pairwise distances.
BLOCK = 512
#: Tiles of codes that meet in tasks, as many as codes allow that are neither fewer nor more than these in a tile.
TILES, LEAST_TILE, LARGEST_TILE = 16, 2048, 1 << 16
#: Codes of a cluster of medoids that one task compares.
CLUSTER = 1 << 17
#: Codes of a pool that is clustered or searched in one place; larger ones are in blocks over the cluster.
LOCAL = 20_000
#: Codes left by the bounds among which the best batch is searched; their distances (8 bytes a pair) go to every task.
SEARCHED = 1024
#: Groups of subtrees that are searched apart, and partial choices looked at in each.
SUBTREES, LOOKED_AT = 64, 50_000


def random_ids(pool: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """AL1, SRT2: ``budget`` ids in a random order that the seed fixes."""
    return pool.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(budget).select("id")


def least_certain(pool: DataFrame, budget: int, column: str = "prob") -> DataFrame:
    """AL2, AL3, SRT1: the ids with the smallest probability or margin, ties to the least id."""
    return pool.orderBy(column, "id").limit(budget).select("id", column)


def _packed(codes: DataFrame, *kept: str) -> DataFrame:
    """``kept`` with bits and wide: each code's components as little-endian floats of 4 bytes where they are such numbers, else of 8; null codes go."""
    known = codes.where(F.col("code").isNotNull()).select(*kept, "code")

    def pack(batches):
        for batch in batches:
            column = batch.column("code")
            wide = np.diff(column.offsets.to_numpy())
            values = column.flatten().to_numpy(zero_copy_only=False).astype("<f8")
            with np.errstate(over="ignore"):
                small = values.astype("<f4")
            data = small if (small == values).all() else values
            bits = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(wide * data.itemsize)]).astype("<i4")), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], bits, pa.array(wide, pa.int32())], names=[*kept, "bits", "wide"])

    fields = ", ".join(f"{c} {kind}" for c, kind in known.dtypes if c != "code")
    return known.mapInArrow(pack, f"{fields}, bits binary, wide int")


def _unpacked(table: pa.Table) -> np.ndarray:
    """The codes of a table of ``_packed`` rows."""
    if not table.num_rows:
        return np.empty((0, 0))
    wide, bits = table.column("wide")[0].as_py(), table.column("bits").to_pylist()
    out = np.empty((len(bits), wide))
    sizes = np.array([len(b) for b in bits])
    for size, kind in ((4, "<f4"), (8, "<f8")):
        rows = np.flatnonzero(sizes == size * wide)
        if len(rows):
            out[rows] = np.frombuffer(b"".join(bits[r] for r in rows.tolist()), kind).reshape(len(rows), wide)
    return out


def _tile_size(n: int) -> int:
    """Codes of one tile: ``TILES`` tiles as long as they fit a task, so what is sent grows with the codes."""
    return min(max(-(-n // TILES), LEAST_TILE), LARGEST_TILE)


def _blocked(a: np.ndarray, b: np.ndarray):
    """(rows of a, rows of b, their distances) by blocks."""
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    for s in range(0, len(a), BLOCK):
        for t in range(0, len(b), 4 * BLOCK):
            i, j = slice(s, min(s + BLOCK, len(a))), slice(t, min(t + 4 * BLOCK, len(b)))
            d = a[i] @ b[j].T
            d *= -2
            d += aa[i, None]
            d += bb[j]
            np.maximum(d, 0, out=d)
            yield i, j, np.sqrt(d, out=d)


def _pair_sums(table: pa.Table, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, weighted sums of distances, codes met) of the codes of tiles ``_p`` and ``_q`` that meet; one tile meets itself."""
    ids, tile = table.column("id").to_numpy(), table.column("_tile").to_numpy()
    codes, one, other = _unpacked(table), table.column("_p")[0].as_py(), table.column("_q")[0].as_py()
    weights = np.ones(len(ids)) if weights is None else weights
    left, right = np.flatnonzero(tile == one), np.flatnonzero(tile == other)
    total, met = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    for i, j, d in _blocked(codes[left], codes[right]):
        i, j = left[i], right[j]
        if one == other:
            d[ids[i][:, None] == ids[j][None, :]] = 0.0
        total[i] += d @ weights[j]
        met[i] += len(j)
        if one != other:
            total[j] += weights[i] @ d
            met[j] += len(i)
    return ids, total, met


def _paired_tiles(rows: DataFrame, tiles: Column) -> DataFrame:
    """``rows`` with _tile, once for each pair (_p, _q) of the ``tiles`` that its tile is in; equal ids have one tile."""
    own = rows.withColumn("_tile", F.pmod(F.xxhash64("id"), tiles)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    return own.withColumns({"_p": F.least("_tile", "_other"), "_q": F.greatest("_tile", "_other")}).drop("_other")


def mean_distances(codes: DataFrame) -> DataFrame:
    """JN8: (id, spread) mean distance of each code to all, itself included.

    All pairs are needed; tiles of codes meet tiles once and one partial sum a
    code leaves each meeting. Null codes count as absent.
    """
    n = codes.where(F.col("code").isNotNull()).count()
    tiles = max(1, -(-n // _tile_size(n)))

    def sums(table: pa.Table) -> pa.Table:
        ids, total, met = _pair_sums(table)
        return pa.table({"id": pa.array(ids, pa.int64()), "total": total, "n": met})

    sent = _paired_tiles(_packed(codes.withColumn("id", F.col("id").cast("long")), "id"), F.lit(tiles).cast("long"))
    out = sent.repartition(max(1, tiles * (tiles + 1) // 2), "_p", "_q").groupBy("_p", "_q").applyInArrow(sums, "id long, total double, n long")
    return out.groupBy("id").agg((F.sum("total") / F.sum("n")).alias("spread"))


def density_weighted(pool: DataFrame, budget: int, density: float = 0.1) -> DataFrame:
    """AL4: the ids with the smallest ``density`` times mean distance plus probability."""
    scored = pool.select("id", "prob").join(mean_distances(pool.select("id", "code")), "id")
    return scored.withColumn("score", F.col("spread") * density + F.col("prob")).orderBy("score", "id").limit(budget).select("id", "score")


def _nearest_in(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the ``k`` nearest, ties to the earlier of b: products choose, differences decide."""
    k, out = min(k, len(b)), []
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    slack = 1e-9 * (aa + bb.max(initial=0.0)) + 1e-300
    step = max(1, (1 << 21) // max(1, len(b)))
    for s in range(0, len(a) if k else 0, step):
        part = a[s : s + step]
        d = aa[s : s + step, None] + bb[None, :] - 2 * part @ b.T
        row, at = np.nonzero(d <= (np.partition(d, k - 1, axis=1)[:, k - 1] + slack[s : s + step])[:, None])
        dist = np.concatenate([np.sqrt(((part[row[x : x + (1 << 15)]] - b[at[x : x + (1 << 15)]]) ** 2).sum(1)) for x in range(0, len(row), 1 << 15)])
        order = np.lexsort((at, dist, row))
        row, at, dist = row[order], at[order], dist[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((row[first] + s, at[first], dist[first]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def nearest_codes(unlabelled: DataFrame, labelled: DataFrame, k: int = 5) -> DataFrame:
    """JN7: (id, rank, lid, label, dist) the ``k`` nearest labelled codes, ties to the least lid.

    Tiles of codes meet tiles of labelled ones, one meeting at a time in a worker;
    each leaves ``k`` rows a code. Null codes have no neighbours.
    """
    kind = dict(labelled.dtypes)["label"]
    u = unlabelled.select(F.col("id").cast("long").alias("id"), "code")
    t = labelled.select(F.col("id").cast("long").alias("id"), "code", "label")
    sizes = [f.where(F.col("code").isNotNull()).count() for f in (u, t)]
    tiles = [max(1, -(-n // _tile_size(n))) for n in sizes]
    tiles[1] = max(1, -(-sizes[1] // LARGEST_TILE))  # few, as each leaves ``k`` rows a code

    def sent(frame: DataFrame, own: int, others: int, first: str, second: str) -> DataFrame:
        mine = frame.withColumn(first, F.pmod(F.xxhash64("id"), F.lit(own)).cast("int"))
        return mine.withColumn(second, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).repartition(tiles[0] * tiles[1], "_p", "_q")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("id")
        row, at, dist = _nearest_in(_unpacked(left), _unpacked(right), k) if left.num_rows and right.num_rows else (np.empty(0, int), np.empty(0, int), np.empty(0))
        found = right.select(["id", "label"]).take(pa.array(at, pa.int64()))
        return pa.table([left.column("id").take(pa.array(row, pa.int64())), *found.columns, pa.array(dist, pa.float64())], names=["id", "lid", "label", "dist"])

    both = sent(_packed(u, "id"), *tiles, "_p", "_q").groupBy("_p", "_q").cogroup(sent(_packed(t, "id", "label"), *tiles[::-1], "_q", "_p").groupBy("_p", "_q"))
    pairs = both.applyInArrow(best, f"id long, lid long, label {kind}, dist double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "lid"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "lid", "label", "dist")


def frontier(unlabelled: DataFrame, labelled: DataFrame, k: int = 5) -> DataFrame:
    """Share of the commonest label among the ``k`` nearest labelled codes."""
    near = nearest_codes(unlabelled, labelled, k).groupBy("id", "label").count()
    return near.groupBy("id").agg((F.max("count") / k).alias("frontier"))


def _matrix(pool: DataFrame, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """ids, codes, probabilities and a random order of a pool of at most ``LOCAL`` candidates on the driver; None for larger ones. Null codes are no candidates."""
    rows = pool.where(F.col("code").isNotNull()).select("id", "code", "prob", F.xxhash64(F.lit(seed), "id").alias("h")).orderBy("id").limit(LOCAL + 1).collect()
    if len(rows) > LOCAL:
        return None
    width = len(rows[0]["code"]) if rows else 0
    codes = np.array([r["code"] for r in rows], float).reshape(len(rows), width)
    return np.array([r["id"] for r in rows], np.int64), codes, np.array([r["prob"] for r in rows], float), np.argsort([r["h"] for r in rows], kind="stable")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def k_medoids(codes: np.ndarray, probs: np.ndarray, budget: int, rounds: int = 100, power: float = 1.0, seed: int = 0, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """AL5 on matrices: (medoids, assignment, cost summed over all rounds); a medoid minimises the distances weighted by uncertainty."""
    n, weight = len(codes), (1 - probs) ** power
    if not n:
        return np.empty(0, int), np.empty(0, int), 0.0
    dist = _distances(codes, codes)
    np.fill_diagonal(dist, 0)
    start = np.random.default_rng(seed).permutation(n) if start is None else start
    medoids, total = np.sort(start[:budget]), 0.0
    assign = np.zeros(n, int)
    for _ in range(rounds):
        assign = dist[medoids].argmin(0)
        chosen = []
        for k in range(len(medoids)):
            mine = np.flatnonzero(assign == k)
            if not len(mine):
                chosen.append(medoids[k])
                continue
            cost = weight[mine] @ dist[np.ix_(mine, mine)]
            total += cost.min()
            chosen.append(mine[cost.argmin()])
        medoids = np.unique(chosen)
    return medoids, assign, total


def _far_medoids(pool: DataFrame, budget: int, rounds: int, power: float, seeds: list[int]) -> list[tuple[list[int], float]]:
    """AL5 for pools of any size: (medoid ids, cost summed over all rounds) of a start for each seed.

    Each round assigns every code to its nearest medoid of each start (``budget`` of them
    are held) and sends it to its clusters; larger clusters than ``CLUSTER`` are cut
    into tiles that meet. A cluster in one tile gives its best code, others their sums.
    """
    weight = F.pow(1 - F.col("prob"), F.lit(float(power))).alias("weight")
    data = checkpointed(_packed(pool.select(F.col("id").cast("long").alias("id"), weight, "code"), "id", "weight"))
    coded = lambda rows: list(zip((r["id"] for r in rows), (np.frombuffer(r["bits"], f"<f{len(r['bits']) // max(1, r['wide'])}").astype(float) for r in rows), strict=True))
    first = [data.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(budget).collect() for seed in seeds]
    medoids = [sorted(coded(rows), key=lambda m: m[0]) for rows in first]
    totals, open_ = [0.0] * len(seeds), [k for k, m in enumerate(medoids) if m]
    for turn in range(rounds):
        if not open_:
            break
        centres = {k: np.array([c for _, c in medoids[k]]) for k in open_}

        def placed(tiles: dict, centres=centres) -> DataFrame:
            def run(batches):
                for batch in batches:
                    codes = _unpacked(pa.Table.from_batches([batch]))
                    for k, held in centres.items() if batch.num_rows else ():
                        cluster = _distances(codes, held).argmin(1)
                        cut = np.array([tiles.get((k, c), 1) for c in range(len(held))])[cluster]
                        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(cluster), k)), pa.array(cluster), pa.array(cut)], names=[*batch.schema.names, "start", "cluster", "_tiles"])

            return data.mapInArrow(run, "id long, weight double, bits binary, wide int, start long, cluster long, _tiles long")

        def costs(table: pa.Table) -> pa.Table:
            ids, total, _ = _pair_sums(table, table.column("weight").to_numpy())
            if table.column("_tiles")[0].as_py() == 1:
                at = np.lexsort((ids, total))[:1]
                ids, total = ids[at], total[at]
            own = [np.full(len(ids), table.column(c)[0].as_py()) for c in ("start", "cluster")]
            return pa.table({"start": own[0], "cluster": own[1], "id": ids, "cost": total})

        sizes = placed({}).groupBy("start", "cluster").count().collect()  # ``budget`` rows a start at most
        sent = _paired_tiles(placed({(r["start"], r["cluster"]): -(-r["count"] // CLUSTER) for r in sizes}), F.col("_tiles"))
        each = sent.groupBy("start", "cluster", "_p", "_q").applyInArrow(costs, "start long, cluster long, id long, cost double").groupBy("start", "cluster", "id").agg(F.sum("cost").alias("cost"))
        best = each.groupBy("start", "cluster").agg(F.min(F.struct("cost", "id")).alias("b")).select("start", "cluster", "b.*").collect()
        code_of = dict(coded(data.where(F.col("id").isin(sorted({r["id"] for r in best}))).collect()))
        for k in list(open_):
            now = {r["cluster"]: (r["id"], code_of[r["id"]]) for r in best if r["start"] == k}
            paid = sum(r["cost"] for r in sorted(best) if r["start"] == k)
            after = sorted({i: c for i, c in (now.get(n, m) for n, m in enumerate(medoids[k]))}.items(), key=lambda m: m[0])
            if [i for i, _ in after] == [i for i, _ in medoids[k]]:  # nothing moves any more
                totals[k] += paid * (rounds - turn)
                open_.remove(k)
            else:
                totals[k], medoids[k] = totals[k] + paid, after
    return [([i for i, _ in m], total) for m, total in zip(medoids, totals, strict=True)]


def _medoids(pool: DataFrame, budget: int, rounds: int, power: float, seed: int) -> tuple[list[int], float]:
    held = _matrix(pool, seed)
    if held is None:
        return _far_medoids(pool, budget, rounds, power, [seed])[0]
    ids, codes, probs, order = held
    medoids, _, cost = k_medoids(codes, probs, budget, rounds, power, start=order)
    return ids[medoids].tolist(), cost


def medoid_ids(pool: DataFrame, budget: int, rounds: int = 100, power: float = 1.0, seed: int = 0) -> DataFrame:
    """AL5: the ids of k medoids. Pools of up to ``LOCAL`` codes are clustered on the driver, larger ones in blocks, with the same start and steps; an empty pool gives none."""
    return pool.sparkSession.createDataFrame([(int(i),) for i in _medoids(pool, budget, rounds, power, seed)[0]], "id long")


def medoid_ids_restarted(pool: DataFrame, budget: int, rounds: int = 100, repeats: int = 20, power: float = 1.0, seed: int = 0) -> DataFrame:
    """AL6: the medoids of the cheapest of several starts (the first of equal ones), with its cost; small pools' starts run in parallel, large pools' rounds do."""
    spark, schema = pool.sparkSession, "id long, cost double"
    held = _matrix(pool)
    if held is None:
        runs = _far_medoids(pool, budget, rounds, power, [seed + k for k in range(repeats)])
        ids, cost = min(runs, key=lambda r: r[1])
        return spark.createDataFrame([(int(i), float(cost)) for i in ids], schema)
    sent = spark.sparkContext.broadcast(held[:3])
    orders = pool.where(F.col("code").isNotNull()).select("id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("start"))
    orders = orders.groupBy("start").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64(F.col("start") + seed, "id").alias("h"), "id"))), 1, budget), lambda x: x["id"]).alias("first"))

    def run(batches):
        for pdf in batches:
            ids, codes, probs = sent.value
            for start, first in zip(pdf["start"], pdf["first"], strict=True):
                medoids, _, cost = k_medoids(codes, probs, budget, rounds, power, start=np.searchsorted(ids, np.array(first)))
                yield pd.DataFrame({"start": start, "cost": cost, "id": ids[medoids]})

    starts = checkpointed(orders.repartition(repeats, "start").mapInPandas(run, "start int, cost double, id long"))
    best = starts.agg(F.min(F.struct("cost", "start")).alias("b")).select("b.start")
    return starts.join(F.broadcast(best), "start").select("id", "cost")  # one row


def cluster_exemplars(pool: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """AL7: distinct samples nearest to k-means centres, the closest centre choosing first; an empty pool gives none."""
    if pool.isEmpty():
        return pool.sparkSession.createDataFrame([], "id long")
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = pool.select("id", "code", array_to_vector("code").alias("features"))
    centres = [c.tolist() for c in KMeans(k=budget, seed=seed, maxIter=20).fit(features).clusterCenters()]
    spark = pool.sparkSession
    near = nearest_codes(spark.createDataFrame([(k, c) for k, c in enumerate(centres)], "id long, code array<double>"), features.withColumn("label", F.lit(0)), k=budget)
    rows, used, chosen = sorted((r["dist"], r["id"], r["lid"]) for r in near.collect()), set(), {}  # budget^2 rows
    for _, centre, lid in rows:
        if centre not in chosen and lid not in used:
            chosen[centre] = lid
            used.add(lid)
    return spark.createDataFrame([(int(v),) for v in chosen.values()], "id long")


def batch_value(dist: np.ndarray, cost: np.ndarray, chosen: tuple[int, ...], alpha: float) -> float:
    """Objective of AL8 for one choice: ``alpha`` times the mean pairwise distance minus the mean cost."""
    c = list(chosen)
    pairs = len(c) * (len(c) - 1) / 2
    return (alpha * dist[np.ix_(c, c)].sum() / 2 / pairs if pairs else 0.0) - float(cost[c].mean())


def _exchanged(pool: DataFrame, scored: DataFrame, budget: int, alpha: float) -> tuple[list[int], float]:
    """AL8 for pools of any size: the least costly choice, improved by exchanges; ``budget`` codes are held and each exchange is one pass."""
    rows = checkpointed(pool.select("id", "code").join(scored, "id"))
    best = [(r["id"], r["code"], r["cost"]) for r in rows.orderBy("cost", "id").limit(budget).collect()]
    budget = len(best)
    pairs = budget * (budget - 1) / 2 or 1

    def value(chosen: list) -> float:
        codes = np.array([c for _, c, _ in chosen], float)
        return (alpha * _distances(codes, codes)[np.triu_indices(len(codes), 1)].sum() / pairs if budget > 1 else 0.0) - float(np.mean([c for _, _, c in chosen]))

    now, improved = value(best), True
    while improved:
        improved = False
        for at in range(budget):
            others = [b for n, b in enumerate(best) if n != at]
            held, taken = np.array([c for _, c, _ in others], float).reshape(len(others), -1), {i for i, _, _ in best}

            def gains(batches, held=held, taken=taken):
                for pdf in batches:
                    codes = np.array(pdf["code"].tolist(), float)
                    gain = (alpha * _distances(codes, held).sum(1) / pairs if len(held) else 0.0) - pdf["cost"].to_numpy() / budget
                    gain = np.where(pdf["id"].isin(taken), -np.inf, gain)
                    k = np.lexsort((pdf["id"], -gain))[:1]
                    yield pd.DataFrame({"gain": gain[k], "id": pdf["id"].iloc[k]})

            found = rows.mapInPandas(gains, "gain double, id long").agg(F.max(F.struct("gain", -F.col("id"))).alias("b")).first()["b"]
            if found is None or found[0] == -np.inf:
                continue
            new = rows.where(F.col("id") == -found[1]).first()
            candidate = [*others, (new["id"], new["code"], new["cost"])]
            if (v := value(candidate)) > now + 1e-12:
                best, now, improved = candidate, v, True
    return [i for i, _, _ in best], now


def _farthest(dist: np.ndarray, most: int) -> np.ndarray:
    """Column k: the sum of each row's k largest distances."""
    most = min(most, len(dist))
    parts = [-np.sort(np.partition(-dist[at : at + BLOCK], most - 1, axis=1)[:, :most], axis=1) if most else np.zeros((len(dist[at : at + BLOCK]), 0)) for at in range(0, len(dist), BLOCK)]
    return np.column_stack([np.zeros(len(dist)), *np.cumsum(np.vstack(parts), axis=1).T])


class _Bounds:
    """Upper bounds of AL8's objective over all ways to fill up a partial choice.

    The distances among codes yet to be chosen are at most half of the sum of each
    one's largest distances, so each code has a weight of its own and the largest weights
    bound the rest. ``alpha`` is not negative.
    """

    def __init__(self, dist: np.ndarray, cost: np.ndarray, budget: int, alpha: float):
        self.dist, self.cost, self.budget = dist, cost, budget
        self.share = alpha / (budget * (budget - 1) / 2 or 1)
        self.far = _farthest(dist, budget - 1)

    def filled(self, chosen: list[int], start: int) -> tuple[np.ndarray, np.ndarray]:
        """(bound, value so far) for each code from ``start`` on that comes next, when the later ones lie behind it."""
        need = self.budget - len(chosen)
        near = self.dist[chosen][:, start:].sum(0) if chosen else 0.0
        own = self.share * near - self.cost[start:] / self.budget
        so_far = self.share * self.dist[np.ix_(chosen, chosen)].sum() / 2 - self.cost[chosen].sum() / self.budget
        weight = own + self.share * self.far[start:, min(need - 1, self.far.shape[1] - 1)] / 2
        bound, held = np.full(len(weight), -np.inf), []
        total = 0.0  # of the need - 1 largest weights behind
        for k in range(len(weight) - 1, -1, -1):
            if len(held) == need - 1:
                bound[k] = so_far + weight[k] + total
            if need > 1:
                heapq.heappush(held, weight[k])
                total += weight[k] - (heapq.heappop(held) if len(held) > need - 1 else 0.0)
        return bound, so_far + own

    def containing(self) -> np.ndarray:
        """For each code a bound of all batches that hold it."""
        weight = self.share * self.far[:, -1] / 2 - self.cost / self.budget
        largest = np.sort(weight)[::-1]
        others = largest[: self.budget - 1].sum()
        # a code among the largest leaves its place to the next
        return np.where(weight >= largest[self.budget - 1], largest[: self.budget].sum(), weight + others)

    def search(self, prefix: list[int], value: float, looked_at: int) -> tuple[float, list[int] | None, float, int]:
        """(best value over ``value``, its choice, bound of what was not looked at, places left): depth first behind ``prefix``."""
        best, choice, left, stack = value, None, -np.inf, [(np.inf, prefix)]
        while stack:
            bound, chosen = stack.pop()
            if bound <= best + 1e-12:
                continue
            if not looked_at:
                left = max(left, bound)
                continue
            looked_at -= 1
            start = chosen[-1] + 1
            bounds, values = self.filled(chosen, start)
            if len(chosen) + 1 == self.budget:
                if len(values) and values.max() > best + 1e-12:
                    best, choice = float(values.max()), [*chosen, start + int(values.argmax())]
                continue
            open_ = np.flatnonzero(bounds > best + 1e-12)
            stack.extend((float(bounds[k]), [*chosen, start + int(k)]) for k in open_[np.argsort(bounds[open_], kind="stable")].tolist())
        return best, choice, left, looked_at


def _proven(spark: SparkSession, dist: np.ndarray, cost: np.ndarray, best: tuple[int, ...], value: float, alpha: float) -> tuple[tuple[int, ...], float, float]:
    """(choice, value, bound): branch and bound from a good choice; subtrees are dealt to tasks, each with a fixed number of places."""
    budget, kept = len(best), np.arange(len(cost))
    while True:  # codes that no better batch can hold go, which tightens the bounds of the others
        bounds = _Bounds(dist[np.ix_(kept, kept)], cost[kept], budget, alpha)
        with_it = bounds.containing()
        stay = with_it > value + 1e-12
        if stay.sum() < budget:
            return best, value, value
        if stay.all():
            break
        kept = kept[stay]
    if len(kept) > SEARCHED:
        return best, value, float(with_it.max())
    kept = kept[np.argsort(-with_it, kind="stable")]
    bounds = _Bounds(dist[np.ix_(kept, kept)], cost[kept], budget, alpha)
    depth_one, _ = bounds.filled([], 0)
    rows = [(float(b), [k]) for k, b in enumerate(depth_one.tolist()) if b > value + 1e-12]
    if budget > 2:
        rows = [(float(b), [*p, p[-1] + 1 + k]) for _, p in rows for k, b in enumerate(bounds.filled(p, p[-1] + 1)[0].tolist()) if b > value + 1e-12]
    if not rows:
        return best, value, value
    rows.sort(key=lambda r: (-r[0], r[1]))
    dealt = pd.DataFrame({"task": np.arange(len(rows)) % SUBTREES, "at": np.arange(len(rows)), "bound": [b for b, _ in rows], "prefix": [p for _, p in rows]})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        top, choice, left, places = value, None, -np.inf, LOOKED_AT
        for row in pdf.sort_values("at").itertuples():
            if row.bound <= top + 1e-12:
                continue
            if not places:
                left = max(left, row.bound)
                continue
            top, found, rest, places = bounds.search([int(k) for k in row.prefix], top, places)
            choice, left = found or choice, max(left, min(rest, row.bound))
        return pd.DataFrame({"value": [top], "choice": [choice or []], "bound": [left]})

    found = spark.createDataFrame(dealt, "task long, at long, bound double, prefix array<long>").groupBy("task").applyInPandas(search, "value double, choice array<long>, bound double").collect()  # a row a task
    top = max(found, key=lambda r: (r["value"], [-k for k in r["choice"]]))
    if top["choice"]:
        best, value = tuple(int(kept[k]) for k in top["choice"]), top["value"]
    return best, value, max(value, *[r["bound"] for r in found])


def select_batch(pool: DataFrame, budget: int, labelled: DataFrame | None = None, alpha: float = 0.03, beta: float = 1.0, gamma: float = 0.1, delta: float = 1.0, exact_limit: int = 200_000, gap: bool = False) -> DataFrame:
    """AL8: (id, objective, exact) of ``budget`` samples that maximise diversity minus probability, frontier share and density.

    Every choice is tried while there are at most ``exact_limit``; otherwise the least
    costly choice is improved by exchanges until none helps, and then by branch and
    bound (pools of up to ``LOCAL`` codes, ``alpha`` not negative, ``exact_limit`` not 0),
    whose subtrees are tasks with a fixed number of places. ``exact`` says that no batch is
    better; with ``gap``, a column says by how much one might be (null where no bound was
    sought). A sample without labelled neighbours has no frontier share; an empty pool gives none.
    """
    spark, schema = pool.sparkSession, "id long, objective double, exact boolean" + (", gap double" if gap else "")
    pool = pool.where(F.col("code").isNotNull())
    held = _matrix(pool)
    if held is None:
        share = frontier(pool, labelled).withColumnRenamed("id", "_i") if labelled is not None else spark.createDataFrame([], "_i long, frontier double")
        scored = pool.select("id", "prob").join(mean_distances(pool.select("id", "code")), "id").join(share, F.col("id") == F.col("_i"), "left")
        cost = delta * F.col("prob") + beta * F.coalesce("frontier", F.lit(0.0)) + gamma * F.col("spread")
        chosen, objective = _exchanged(pool, scored.select("id", cost.alias("cost")), budget, alpha)
        return spark.createDataFrame([(int(i), float(objective), False, *([None] if gap else [])) for i in sorted(chosen)], schema)
    ids, codes, probs, _ = held
    if not len(ids) or not budget:
        return spark.createDataFrame([], schema)
    dist = _distances(codes, codes)
    np.fill_diagonal(dist, 0)
    front = np.zeros(len(ids))
    if labelled is not None:
        share = {r["id"]: r["frontier"] for r in frontier(pool, labelled).collect()}
        front = np.array([share.get(i, 0.0) for i in ids.tolist()])
    cost = delta * probs + beta * front + gamma * dist.mean(0)
    budget = min(budget, len(ids))
    exact = math.comb(len(ids), budget) <= exact_limit
    over = 0.0 if exact else None
    if exact:
        best = max(combinations(range(len(ids)), budget), key=lambda c: batch_value(dist, cost, c, alpha))
    else:
        best = tuple(np.argsort(cost, kind="stable")[:budget].tolist())
        value = batch_value(dist, cost, best, alpha)
        improved = True
        while improved:
            improved = False
            for at in range(budget):
                rest = [k for k in range(len(ids)) if k not in best]
                if not rest:
                    break
                others = [b for n, b in enumerate(best) if n != at]
                gain = alpha * dist[np.ix_(rest, others)].sum(1) / (budget * (budget - 1) / 2 or 1) - cost[rest] / budget
                candidate = tuple([*others, rest[int(gain.argmax())]])
                if (v := batch_value(dist, cost, candidate, alpha)) > value + 1e-12:
                    best, value, improved = candidate, v, True
        if exact_limit and alpha >= 0 and budget > 1:
            best, value, bound = _proven(spark, dist, cost, best, value, alpha)
            exact, over = bool(bound <= value + 1e-12), float(bound - value)
    objective = batch_value(dist, cost, best, alpha)
    return spark.createDataFrame([(int(ids[b]), float(objective), exact, *([over] if gap else [])) for b in sorted(best)], schema)
