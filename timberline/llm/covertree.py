"""Embedding near-duplicates by dual traversal of cover trees.

Equal vectors are one class. The top levels of one cover tree over a bounded
sample give the centres of cells; every class goes to its nearest centre, and a
cell's covering radius is that of all its classes. Cells are cut by hash into
tiles of bounded size, which spreads a dense cluster; each tile gets a cover tree
over its unit vectors: nested levels whose radii halve, every node with the true
covering radius of what lies below it. Two tiles are one task if the covering
balls of their cells can meet within the link distance; it walks both trees at
once: a pair of nodes is dropped when their centres are farther apart than the
link distance plus both covering radii, taken whole when even the farthest
points must link, and opened otherwise; what remains is tested by the cosine itself.

Whole pairs of nodes are counted, not listed, so a cluster of k alike vectors
sends O(k) rows.
"""

from __future__ import annotations

import heapq
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import Forest, connected_components, cut

TILE = 8192
#: Classes in the sample whose cover tree gives the cells, and cells, at most.
SAMPLE, CELLS = 8192, 1024
#: Bytes of that sample at most.
SAMPLE_BYTES = 32 << 20
#: Vector lengths that get cells of their own; of those with over ``TILE`` classes, the commonest first. Others are one cell each.
LENGTHS = 256
#: Tasks of a step at most.
MAX_TASKS = 1 << 14
LEAF = 16
SPARSE = 4
#: Room for rounding in distance bounds; the final test is the cosine's.
SLACK = 1e-6
#: The same for dot products in single precision.
ROOM = 1e-4
_BLOCK = 1024
_SALTS = 16


class CoverTree:
    """Nodes of a cover tree over the rows of ``x``, which are scaled to length 1.

    A part of ``SPARSE`` points or fewer that is wider than ``tight`` becomes as
    many nodes of one point: its bound would rule out less than the points do.
    Nodes are in flat arrays; the points below node k are ``order[first[k]:last[k]]``, its children ``child_at[k]:child_to[k]``."""

    def __init__(self, x: np.ndarray, tight: float = 0.0):
        self.x = x
        scale = np.abs(x).max(1)
        self.norm = np.sqrt(((x / scale[:, None]) ** 2).sum(1)) * scale
        self.unit = (x / scale[:, None]) / (self.norm / scale)[:, None]
        self.unit32 = self.unit.astype(np.float32)
        self.order = np.arange(len(x))
        rows: list[list] = []  # centre, covering radius, first, last, child_at, child_to
        if len(x):
            rows.append([0, 0.0, 0, len(x), 0, 0])
        level = [(0, 2.0)]
        while level and rows:
            below = []
            for k, radius in level:
                centre, _, first, last = rows[k][:4]
                members = self.order[first:last]
                away = self._distance(centre, members)
                rows[k][1] = float(away.max())
                if len(members) <= LEAF or rows[k][1] <= SLACK:
                    continue
                half = radius / 2
                while half > rows[k][1]:
                    half /= 2
                rows[k][4] = len(rows)
                parts, at = [], first
                while len(members):  # a greedy net: the centre stays a centre on the next level
                    near = away <= half
                    part = members[near]
                    parts.append(part)
                    if len(part) <= SPARSE and float(away[near].max()) > tight:
                        rows += [[m, 0.0, at + n, at + n + 1, 0, 0] for n, m in enumerate(part.tolist())]
                    else:
                        below.append((len(rows), half))
                        rows.append([centre, 0.0, at, at + len(part), 0, 0])
                    at += len(part)
                    members = members[~near]
                    if len(members):
                        centre = members[0]
                        away = self._distance(centre, members)
                self.order[first:last] = np.concatenate(parts)
                rows[k][5] = len(rows)
            level = below
        table = np.array(rows, np.float64).reshape(-1, 6)
        self.radius = table[:, 1]
        self.centre, self.first, self.last, self.child_at, self.child_to = (table[:, c].astype(np.int64) for c in (0, 2, 3, 4, 5))

    def _distance(self, centre: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.unit[members] @ self.unit[centre])))

    def below(self, k: int) -> np.ndarray:
        return self.order[self.first[k] : self.last[k]]

    def pack(self) -> bytes:
        nodes = np.column_stack([self.centre, self.first, self.last, self.child_at, self.child_to])
        single = self.x.astype(np.float32)
        narrow = bool((single == self.x).all())  # vectors that come in single precision go in it
        head = struct.pack("<4q", *self.x.shape, len(nodes), narrow)
        return b"".join((head, (single if narrow else self.x).tobytes(), self.order.astype(np.int32).tobytes(), nodes.astype(np.int32).tobytes(), self.radius.tobytes()))

    @classmethod
    def unpack(cls, blob: bytes) -> CoverTree:
        n, d, k, narrow = struct.unpack_from("<4q", blob)
        tree, at = cls.__new__(cls), 32

        def take(kind, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        tree.x = take(np.float32 if narrow else np.float64, n * d).reshape(n, d).astype(np.float64)
        tree.order = take(np.int32, n).astype(np.int64)
        nodes = take(np.int32, 5 * k).reshape(k, 5).astype(np.int64)
        tree.centre, tree.first, tree.last, tree.child_at, tree.child_to = nodes.T
        tree.radius = take(np.float64, k)
        scale = np.abs(tree.x).max(1) if n else np.empty(0)
        tree.norm = np.sqrt(((tree.x / scale[:, None]) ** 2).sum(1)) * scale
        tree.unit = (tree.x / scale[:, None]) / (tree.norm / scale)[:, None]
        tree.unit32 = tree.unit.astype(np.float32)
        return tree


def dual_traversal(a: CoverTree, b: CoverTree, cosine: float, link, link_all) -> None:
    """Call ``link(i, j)`` (arrays) and ``link_all(I, J)`` (all of I with all of J) until every pair at ``cosine`` or more is told once.

    For a tree with itself (``a is b``) each unordered pair is told once or in
    both orders consistently: ``link`` gets i < j only, ``link_all`` gets the
    same block twice or two disjoint ones.
    """
    if not len(a.centre) or not len(b.centre):
        return
    same = a is b
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))

    def exact(i: np.ndarray, j: np.ndarray) -> None:
        for s in range(0, len(i), 1 << 15):
            p, q = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
            ok = np.einsum("ij,ij->i", a.x[p] / a.norm[p, None], b.x[q] / b.norm[q, None]) >= cosine
            if ok.any():
                link(p[ok], q[ok])

    def nodes(t: CoverTree, k: int) -> np.ndarray:
        return np.arange(t.child_at[k], t.child_to[k]) if t.child_to[k] > t.child_at[k] else np.array([k])

    def near_pairs(ps: np.ndarray, qs: np.ndarray, mirrored: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of nodes that the covering radii do not rule out, with their centres' distance.

        Distances of most pairs are only compared, as dot products in single
        precision with room to spare; those that pass are computed again.
        """
        for p_is_point in (True, False):
            p_all = ps[(a.radius[ps] == 0) == p_is_point]
            for q_is_point in (True, False):
                q = qs[(b.radius[qs] == 0) == q_is_point]
                right = b.unit32[b.centre[q]].T
                for at in range(0, len(p_all) if len(q) else 0, _BLOCK):
                    p = p_all[at : at + _BLOCK]
                    dots = a.unit32[a.centre[p]] @ right
                    if p_is_point and q_is_point:
                        r, c = np.divmod(np.flatnonzero(dots.ravel() >= np.float32(1.0 - (reach + SLACK) ** 2 / 2 - ROOM)), len(q))
                    else:
                        bound = reach + a.radius[p][:, None] + b.radius[q][None, :] + SLACK
                        r, c = np.nonzero(dots >= 1.0 - bound * bound / 2 - ROOM)
                    u, v = p[r], q[c]
                    if mirrored:
                        u, v = u[u <= v], v[u <= v]
                    if len(u):
                        apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", a.unit[a.centre[u]], b.unit[b.centre[v]])))
                        keep = apart <= reach + a.radius[u] + b.radius[v] + SLACK
                        yield u[keep], v[keep], apart[keep]

    pending: list[tuple[np.ndarray, np.ndarray, bool]] = [(np.array([0]), np.array([0]), same)]
    while pending:
        ps, qs, mirrored = pending.pop()
        singles_i, singles_j = [], []
        for u, v, d in near_pairs(ps, qs, mirrored):
            nu, nv = a.last[u] - a.first[u], b.last[v] - b.first[v]
            one = (nu == 1) & (nv == 1)
            if one.any():
                i, j = a.order[a.first[u[one]]], b.order[b.first[v[one]]]
                keep = i != j if mirrored else np.ones(len(i), bool)
                singles_i.append(i[keep])
                singles_j.append(j[keep])
            for k, m, dist in zip(u[~one].tolist(), v[~one].tolist(), d[~one].tolist(), strict=True):
                itself = mirrored and k == m
                if dist + a.radius[k] + b.radius[m] < reach - SLACK:
                    link_all(a.below(k), b.below(m))
                    continue
                cu, cv = nodes(a, k), nodes(b, m)
                if len(cu) > 1 or len(cv) > 1:
                    if itself:
                        pending.append((cu, cv, True))
                    elif len(cu) > 1 and len(cv) > 1 and 0.5 <= a.radius[k] / b.radius[m] <= 2:
                        pending.append((cu, cv, False))  # of a level: both are opened at once
                    elif len(cu) > 1 and (len(cv) == 1 or a.radius[k] >= b.radius[m]):
                        pending.append((cu, np.array([m]), False))
                    else:
                        pending.append((np.array([k]), cv, False))
                else:  # two leaves
                    x, y = a.below(k), b.below(m)
                    i, j = np.repeat(x, len(y)), np.tile(y, len(x))
                    keep = i < j if itself else np.ones(len(i), bool)
                    exact(i[keep], j[keep])
        if singles_i:
            exact(np.concatenate(singles_i), np.concatenate(singles_j))


def _build(pdf: pd.DataFrame, tight: float) -> pd.DataFrame:
    tree = CoverTree(np.array(pdf["vector"].tolist(), np.float64), tight)
    ids = pdf[["node", "copies"]].to_numpy(np.int64).tobytes()
    return pd.DataFrame({"dims": pdf["dims"].iloc[:1], "cell": pdf["cell"].iloc[:1], "part": pdf["part"].iloc[:1], "tree": [tree.pack()], "ids": [ids]})


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1)[:, None]
    x = x / scale
    return x / np.sqrt((x * x).sum(1))[:, None]


def top_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of at most ``cells`` nodes that cover the sample: of the cover tree's nodes the widest is opened until they are enough."""
    tree = CoverTree(sample)
    front, done = [(-float(tree.radius[0]), 0)], []
    while front and len(front) + len(done) < cells:
        _, k = heapq.heappop(front)
        below = range(int(tree.child_at[k]), int(tree.child_to[k]))
        if len(below) == 0:
            done.append(k)
        elif len(front) + len(done) + len(below) > cells:
            done.append(k)
        else:
            for c in below:
                heapq.heappush(front, (-float(tree.radius[c]), c))
    return tree.unit[tree.centre[sorted([*done, *[k for _, k in front]])]]


def _with_cells(classes: DataFrame, tile: int, cells: int, reach: float) -> tuple[DataFrame, DataFrame]:
    """``classes`` with cell and away (the distance from its centre), and the pairs (dims, a, b) of cells whose covering balls can meet."""
    spark = classes.sparkSession
    counts = {r["dims"]: r["count"] for r in classes.groupBy("dims").count().where(F.col("count") > tile).orderBy(F.desc("count"), "dims").limit(LENGTHS).collect()}
    centres = {}
    for d, n in counts.items():
        size = min(SAMPLE, max(2, SAMPLE_BYTES // (8 * d)))
        rows = classes.where(F.col("dims") == d).orderBy(F.xxhash64("vector", F.lit(1))).limit(size).select("vector").toArrow().column("vector").combine_chunks()
        centres[d] = top_centres(rows.flatten().to_numpy().reshape(-1, d), min(cells, max(2, 2 * n // tile)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, away = np.zeros(len(pdf), np.int32), np.full(len(pdf), 2.0)
            for d, c in centres.items():
                mine = np.flatnonzero(pdf["dims"].to_numpy() == d)
                for s in range(0, len(mine), _BLOCK):
                    at = mine[s : s + _BLOCK]
                    dots = _unit(np.array(pdf["vector"].iloc[at].tolist(), np.float64)) @ c.T
                    cell[at] = dots.argmax(1)
                    away[at] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots.max(1)))
            yield pdf.assign(cell=cell, away=away)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    placed = cut(classes.mapInPandas(place, f"{schema}, cell int, away double"))
    radius = {(r["dims"], r["cell"]): r["radius"] for r in placed.where(F.col("dims").isin(list(centres))).groupBy("dims", "cell").agg(F.max("away").alias("radius")).collect()}  # CELLS rows a length at most
    pairs = []
    for d, c in centres.items():
        used = sorted(k for n, k in radius if n == d)
        r, u = np.array([radius[d, k] for k in used]), c[used]
        apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (u @ u.T)))
        i, j = np.nonzero(np.triu(apart <= reach + r[:, None] + r[None, :] + SLACK))
        pairs += [(d, used[p], used[q]) for p, q in zip(i.tolist(), j.tolist(), strict=True)]
    rest = placed.where(~F.col("dims").isin(list(centres))).select("dims", F.lit(0).alias("a"), F.lit(0).alias("b")).distinct()
    return placed, spark.createDataFrame(pairs, "dims int, a int, b int").union(rest)  # half of CELLS squared at most


def _compare(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of one pair of tiles: (node, links, root) of every class that has any, root being the least class it is tied to here."""
    pdf = pdf.sort_values("side")
    trees = [CoverTree.unpack(t) for t in pdf["tree"]]
    ids = [np.frombuffer(i, np.int64).reshape(-1, 2) for i in pdf["ids"]]
    same = len(trees) == 1
    a, b = trees[0], trees[-1]
    wa, wb = ids[0][:, 1], ids[-1][:, 1]
    rep = ids[0][:, 0] if same else np.concatenate([ids[0][:, 0], ids[1][:, 0]])
    shift = 0 if same else len(wa)
    order = np.argsort(rep, kind="stable")  # so that the forest's least index is the least rep
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    links, forest = np.zeros(len(rep), np.int64), Forest(len(rep))

    def link(i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(links, i, wb[j])
        np.add.at(links, j + shift, wa[i])
        forest.link(place[i], place[j + shift])

    def link_all(i: np.ndarray, j: np.ndarray) -> None:
        if same and np.array_equal(i, j):
            links[i] += wb[i].sum() - wb[i]
        else:
            links[i] += wb[j].sum()
            links[j + shift] += wa[i].sum()
        both = np.concatenate([place[i], place[j + shift]])
        forest.link(np.full(len(both), both.min()), both)

    dual_traversal(a, b, cosine, link, link_all)
    root = rep[order[forest.roots()[place]]]
    has = links > 0
    return pd.DataFrame({"node": rep[has], "links": links[has], "root": root[has]})


def near_duplicates(embeddings: DataFrame, cosine: float = 0.95, tile: int = TILE, cells: int = CELLS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``embeddings`` (vec_id, embedding, anything else).

    Two vectors of the same length are linked if their cosine, in double
    precision, is at least ``cosine``. Null, empty and zero vectors and those
    with null or non-finite components link with nothing. Repeated vectors are
    linked with each other; rows with a repeated vec_id count as rows, and
    different vectors under one vec_id are not tied by it. A null vec_id stays
    null; its vector links like others and its component is the least id
    reachable (null if there is none). An empty table gives an empty frame.
    """
    if not 0.5 <= cosine <= 1:
        raise ValueError("cosine must lie in [0.5, 1]")
    reach = math.sqrt(2.0 - 2.0 * cosine)
    vector = F.col("embedding").cast("array<double>")
    big = F.lit(1.7976931348623157e308)
    fit = (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= big)) & F.exists("vector", lambda v: v != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).withColumn("fit", F.coalesce(F.col("vector").isNotNull() & fit, F.lit(False)))
    keyed = rows.select("vec_id", F.when(F.col("fit"), F.col("vector")).alias("vector"))
    classes = keyed.where(F.col("vector").isNotNull()).groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # numbered in the order of their ids, so the least node of a component has the least id
    classes = classes.withColumn("dims", F.size("vector")).orderBy(F.col("rep").asc_nulls_last(), F.xxhash64("vector"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    placed, pairs = _with_cells(classes, tile, cells, reach)
    parts = placed.groupBy("dims", "cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts"))
    dealt = placed.join(parts, ["dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("vector"), F.col("parts")).cast("int"))
    # a task for each tile and for each pair of tiles, about: they are small in bytes and long in work, so that sizes do not tell how to deal them
    tiles = min(int(parts.agg(F.coalesce(F.sum("parts"), F.lit(1))).first()[0]), MAX_TASKS)
    dealt = dealt.select("dims", "cell", "part", "vector", "node", "copies").repartition(tiles, "dims", "cell", "part")
    trees = cut(dealt.groupBy("dims", "cell", "part").applyInPandas(lambda pdf: _build(pdf, reach), "dims int, cell int, part int, tree binary, ids binary"))
    # every tile on the first side of its cell's pairs and on the second; a pair of tiles is told by cell and part of both
    sized = parts.select("dims", F.col("cell").alias("_c"), "parts")
    plan = pairs.join(sized.withColumnsRenamed({"_c": "a", "parts": "na"}), ["dims", "a"]).join(sized.withColumnsRenamed({"_c": "b", "parts": "nb"}), ["dims", "b"])
    plan = plan.withColumn("pa", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    plan = cut(plan.where((F.col("a") < F.col("b")) | (F.col("pa") <= F.col("pb"))).select("dims", "a", "pa", "b", "pb"))
    ends = F.when((F.col("a") == F.col("b")) & (F.col("pa") == F.col("pb")), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    sides = plan.withColumn("side", F.explode(ends)).withColumns({"cell": F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")), "part": F.when(F.col("side") == 0, F.col("pa")).otherwise(F.col("pb"))})
    sides = sides.join(trees, ["dims", "cell", "part"]).select("dims", "a", "pa", "b", "pb", "side", "tree", "ids")
    # a tile to which the hash gave nothing leaves one side: compared with itself only in the group of its own
    sides = sides.repartition(min(max(1, plan.count()), MAX_TASKS), "dims", "a", "pa", "b", "pb")
    found = sides.groupBy("dims", "a", "pa", "b", "pb").applyInPandas(lambda key, pdf: _compare_group(key, pdf, cosine), "node long, links long, root long")
    found = cut(found)
    totals = found.groupBy(F.col("node").alias("_n")).agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("_m"), "component")
    named = classes.join(totals, F.col("node") == F.col("_n"), "left").join(components, F.col("node") == F.col("_m"), "left")
    named = cut(named.select("vector", "rep", "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("root")))
    # a component of many classes meets its least id in shares
    salt, shares = F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    heads = named.where(F.col("root") == F.col("node"))
    names = heads.select(F.col("node").alias("_root"), F.col("rep").alias("_least"), shares.alias("_salt"))
    tied = named.where(F.col("root") != F.col("node")).join(names, (F.col("root") == F.col("_root")) & (salt == F.col("_salt")))
    info = heads.select("vector", "n_links", F.col("rep").alias("component_id")).union(tied.select("vector", "n_links", "_least")).withColumnRenamed("vector", "_vector")
    out = keyed.join(info, F.col("vector") == F.col("_vector"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )


def _compare_group(key: tuple, pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    if len(pdf) == 1 and key[1:3] != key[3:5]:
        return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
    return _compare(pdf, cosine)


def pairs(embeddings: np.ndarray, cosine: float = 0.95) -> Iterator[tuple[int, int]]:
    """Index pairs (i < j) of one in-memory matrix at ``cosine`` or more; for small sets and tests."""
    tree, out = CoverTree(np.asarray(embeddings, np.float64)), set()
    dual_traversal(
        tree, tree, cosine,
        lambda i, j: out.update((min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)),
        lambda i, j: out.update((min(p, q), max(p, q)) for p in i.tolist() for q in j.tolist() if p != q),
    )
    return iter(sorted(out))
