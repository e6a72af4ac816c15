"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has ``lanes`` 64-bit words. Bit b of a word is set if it is set
in over half the hashes of the document's shingles. Distinct fingerprints are
dealt into tiles by population count; two tiles are compared (numpy
exclusive-or and bit counts, every pair) unless their population counts differ
by more than the radius, a lower bound of the Hamming distance. Each tile pair
returns a spanning forest of its links, so a group of k alike documents sends
O(k) rows, and components are then joined across tiles.

The comparison of distinct fingerprints is exact and therefore quadratic in
their number; the README gives the constant. Joins of tables that grow with the
corpus are merge joins, so their rows never pass through the driver.
"""

from __future__ import annotations

import math
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import Forest, by_text_chunks, connected_components, cut, texts_of

SEED = 42
TILE = 16384
#: Sizes of shingle sets up to which the chance of differing bits is computed exactly.
SMALL = 64
#: The share of linked pairs that each of the two comparisons of fingerprints may drop.
MISSED = 1e-9
#: Elements of shingle sets in one block of documents that are compared on their texts.
BLOCK = 1 << 21
#: Stands for a null doc_id and comes after all others; a document of this id counts as one without.
NO_ID = (1 << 63) - 1
#: Shares in which the classes of one component meet its least id.
SALTS = 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LANE_MASK = np.uint64(0x0101010101010101)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EDGES = "u long, v long"
_NO_EDGES = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})


def shingle_hashes(text: bytes, width: int, distinct: bool) -> np.ndarray:
    """XXH64 (seed 42) of every ``width``-word shingle of the A-Z lower-cased text."""
    words = text.translate(_LOWER).split()
    # bytes.split() breaks at exactly the bytes 9-13 and 32
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    flat = b" ".join(words)
    ends, at = [0] * n, -1
    for i, w in enumerate(words):
        at += len(w) + 1
        ends[i] = at
    starts = [0, *[e + 1 for e in ends[: n - width]]]
    digest, seed = xxhash.xxh64_intdigest, SEED
    out = np.fromiter((digest(flat[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=True)), np.uint64, n - width + 1)
    return np.unique(out) if distinct else out


def _remix(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 independent-looking bits of each hash (the finaliser of SplitMix64); lane 0 is the hash."""
    if not lane:
        return h
    z = h + np.uint64(int(_MIX) * lane & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority_bits(hashes: list[np.ndarray], lanes: int) -> np.ndarray:
    """A row of ``lanes`` words a document; no hashes give zero."""
    counts = np.array([len(h) for h in hashes])
    out = np.zeros((len(hashes), lanes), np.uint64)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    flat, sizes = np.concatenate([hashes[i] for i in filled]), counts[filled]
    pieces = -(-sizes // 255)  # a byte counts to 255
    first = np.cumsum(pieces) - pieces
    starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    for lane in range(lanes):
        h, word = _remix(flat, lane), np.zeros(len(filled), np.uint64)
        for bit in range(8):
            sums = np.add.reduceat((h >> np.uint64(bit)) & _LANE_MASK, starts)
            ones = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
            over = 2 * ones > sizes[:, None]
            for byte in range(8):
                word |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + bit)
        out[filled, lane] = word
    return out


def _fingerprint_batch(batch: pa.RecordBatch, width: int, lanes: int, distinct: bool) -> pa.RecordBatch:
    hashes = [shingle_hashes(t.encode("utf-8", "surrogatepass"), width, distinct) for t in texts_of(batch)]
    words = majority_bits(hashes, lanes)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc"), batch.column("mark"), pa.array([w.astype(">u8").tobytes() for w in words], pa.binary()), pa.array([len(h) for h in hashes], pa.int64())],
        names=["doc", "mark", "fp", "shingles"],
    )


def _marked(docs: DataFrame) -> DataFrame:
    """(doc, mark, text): the id (``NO_ID`` for null, which comes last) and a hash of the text, which together name a row."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def fingerprints(docs: DataFrame, width: int = 5, lanes: int = 1, distinct: bool = False) -> DataFrame:
    """(doc, mark, fp binary of 8 * ``lanes`` big-endian bytes, shingles) for each row of ``docs``; null text is empty."""
    batch = partial(_fingerprint_batch, width=width, lanes=lanes, distinct=distinct)
    return _marked(docs).mapInArrow(by_text_chunks(batch), "doc long, mark long, fp binary, shingles long")


def hamming_for(similarity: float, bits: int) -> int:
    """Expected differing bits of two equally long sets with this Jaccard similarity (angle of the set vectors)."""
    cosine = 2 * similarity / (1 + similarity)
    return round(bits * math.acos(cosine) / math.pi)


@lru_cache
def flip_shares(similarity: float) -> np.ndarray:
    """The largest chance that a bit differs between linked sets, by the smaller set's size (0 to SMALL; SMALL stands for all larger).

    Exact for small sets, of which even ones lose ties: the common elements give
    s ones, the others of each set a binomial number. The chance settles towards
    the angle of large sets, so the last entry is the largest of the last sizes.
    """

    def pmf(n: int) -> np.ndarray:
        return np.array([math.comb(n, k) / 2**n for k in range(n + 1)])

    def over(n: int, common: int) -> np.ndarray:
        """Chance of a majority in a set of n if s = 0, 1, ... of the common elements have the bit."""
        least = np.clip(n // 2 + 1 - np.arange(common + 1), 0, n - common + 1)
        return np.append(np.cumsum(pmf(n - common)[::-1])[::-1], 0.0)[least]

    out = np.zeros(SMALL + 1)
    for m in range(1, SMALL + 1):
        for n in range(m, math.floor(m / similarity + 1e-9) + 1):
            least = max(0, math.ceil(similarity * (m + n) / (1 + similarity) - 1e-9))
            for common in range(least, min(m, least + 3) + 1):  # a smaller overlap flips more, but for parity
                u, v = over(m, common), over(n, common)
                out[m] = max(out[m], float(pmf(common) @ (u * (1 - v) + v * (1 - u))))
    out[SMALL] = max(out[SMALL - 24 :].max(), math.acos(2 * similarity / (1 + similarity)) / math.pi)
    return out


def allowed_distances(similarity: float, bits: int) -> np.ndarray:
    """By the smaller set's size as in :func:`flip_shares`, the distance that a linked pair exceeds in one of 1 / MISSED cases at most."""
    out = []
    for share in flip_shares(similarity).tolist():
        tail, d = 0.0, bits
        while d and (tail := tail + math.comb(bits, d) * share**d * (1 - share) ** (bits - d)) <= MISSED:
            d -= 1
        out.append(d)
    return np.array(out)


def _links(a, b, radius: int):
    """(i, j) of rows of ``a`` and ``b`` at most ``radius`` bits apart, block by block."""
    step = max(1, (1 << 19) // max(1, len(b)))
    x = np.empty((step, len(b)), np.uint64)
    c = np.empty((step, len(b)), np.uint8)
    left, right = np.ascontiguousarray(a[:, 0]), np.ascontiguousarray(b[:, 0])
    for at in range(0, len(a), step):
        part = left[at : at + step]
        np.bitwise_xor(part[:, None], right[None, :], out=x[: len(part)])
        np.bitwise_count(x[: len(part)], out=c[: len(part)])
        i, j = np.divmod(np.flatnonzero(c[: len(part)].ravel() <= radius), len(b))
        i += at
        for s in range(0, len(i), 1 << 17):
            p, q = i[s : s + (1 << 17)], j[s : s + (1 << 17)]
            keep = np.bitwise_count(a[p] ^ b[q]).sum(1, dtype=np.int64) <= radius
            if keep.any():
                yield p[keep], q[keep]


def _similar(a, b, na, nb, similarity: float, allowed: np.ndarray, worst: np.ndarray, same: bool):
    """(i, j, estimate) of rows of ``a`` and ``b``, both in the order of their set sizes, whose distance linked sets of these sizes may have.

    Only sizes that allow the similarity meet. The first two words drop nearly
    all other pairs by ``worst``, the largest distances that sets of this size or
    more may have there. With ``same``, b is a, and i <= j.
    """
    bits, step, few = 64 * a.shape[1], 32, min(2, a.shape[1])
    left, right = ([np.ascontiguousarray(m[:, k]) for k in range(few)] for m in (a, b))
    for at in range(0, len(a), step):
        n = len(na[at : at + step])
        low = int(np.searchsorted(nb, similarity * na[at] - 1e-6))
        high = int(np.searchsorted(nb, na[at + n - 1] / similarity + 1e-6, side="right"))
        low = max(low, at) if same else low
        if low >= high:
            continue
        c = np.zeros((n, high - low), np.uint8)
        for p, q in zip(left, right, strict=True):
            c += np.bitwise_count(p[at : at + n, None] ^ q[None, low:high])
        i, j = np.divmod(np.flatnonzero(c.ravel() <= worst[int(min(na[at], nb[low], SMALL))]), high - low)
        i, j = i + at, j + low
        for s in range(0, len(i), 1 << 17):
            p, q = i[s : s + (1 << 17)], j[s : s + (1 << 17)]
            apart = np.bitwise_count(a[p] ^ b[q]).sum(1, dtype=np.int64)
            keep = apart <= allowed[np.minimum(np.minimum(na[p], nb[q]), SMALL).astype(np.int64)]
            p, q, apart = p[keep], q[keep], apart[keep]
            if len(p):  # Jaccard similarity from the angle and both set sizes
                common = np.cos(np.pi * apart / bits) * np.sqrt(na[p] * nb[q])
                union = na[p] + nb[q] - common
                yield p, q, np.where(union > 0, common / np.where(union > 0, union, 1), 1.0)


def _compare_tiles(table: pa.Table, lanes: int, radius: int | None, similarity: float | None, allowed, worst, tiers: tuple[float, ...]) -> pa.Table:
    """Edges of one pair of tiles: a forest of all links, or of each tier of estimated similarity."""
    words, reps, sizes = [], [], []
    sides = table.column("rows").combine_chunks()
    for k in np.argsort(table.column("tile").to_numpy()):
        rows = sides[int(k)].values
        size = rows.field("shingles").to_numpy().astype(np.float64)
        order = np.argsort(size, kind="stable")
        words.append(np.frombuffer(b"".join(rows.field("fp").to_pylist()), ">u8").astype(np.uint64).reshape(-1, lanes)[order])
        reps.append(rows.field("node").to_numpy()[order])
        sizes.append(size[order])
    offset = len(words[0]) if len(words) == 2 else 0
    ids = np.concatenate(reps)
    forests, u, v = [Forest(len(ids)) for _ in tiers], [], []
    if similarity is not None:
        for i, j, estimate in _similar(words[0], words[-1], sizes[0], sizes[-1], similarity, allowed, worst, not offset):
            tier = np.maximum(np.searchsorted(tiers, estimate, side="right") - 1, 0)
            for t, forest in enumerate(forests):
                mine = np.flatnonzero(tier == t)
                mine = mine[np.argsort(-estimate[mine], kind="stable")]
                joined = mine[forest.link(i[mine], j[mine] + offset)]
                u.append(ids[i[joined]])
                v.append(ids[j[joined] + offset])
    else:
        for i, j in _links(words[0], words[-1], radius):
            forests[0].link(i, j + offset)
        root = forests[0].roots()
        linked = np.flatnonzero(root != np.arange(len(root)))
        u, v = [ids[linked]], [ids[root[linked]]]
    none = np.empty(0, np.int64)
    return pa.table({"u": pa.array(np.concatenate([none, *u])), "v": pa.array(np.concatenate([none, *v]))})


def _set_batch(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    sets = [shingle_hashes(t.encode("utf-8", "surrogatepass"), width, True).view(np.int64) for t in texts_of(batch)]
    ends = np.cumsum([0, *map(len, sets)])
    return pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], names=["node", "hashes"])


def verified(docs: DataFrame, classes: DataFrame, edges: DataFrame, width: int, similarity: float) -> DataFrame:
    """The edges (u, v) between classes whose shingle sets have at least this Jaccard similarity, computed exactly."""
    edges = edges.distinct()
    nodes = edges.select(F.col("u").alias("_n")).union(edges.select("v")).distinct()
    sets = _sets_of(docs, classes, nodes, width)
    sides = [sets.select(F.col("node").alias(f"_{c}"), F.col("hashes").alias(f"h{c}")) for c in "uv"]
    both = edges.join(sides[0].hint("merge"), F.col("u") == F.col("_u")).join(sides[1].hint("merge"), F.col("v") == F.col("_v"))
    common = F.size(F.array_intersect("hu", "hv"))
    return both.where(common >= similarity * (F.size("hu") + F.size("hv") - common)).select("u", "v")


def _common(hashes: np.ndarray, sizes: np.ndarray):
    """A function that counts the elements a set shares with each of the sets whose elements follow one another in ``hashes``."""
    order = np.argsort(hashes, kind="stable")
    keys, first = np.unique(hashes[order], return_index=True)
    owner, last = np.repeat(np.arange(len(sizes)), sizes)[order], np.append(first[1:], len(hashes))

    def count(wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, wanted)
        at = at[keys[np.minimum(at, len(keys) - 1)] == wanted]
        n = last[at] - first[at]
        return np.bincount(owner[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sizes))

    return count


def _join_blocks(table: pa.Table, similarity: float) -> pa.Table:
    """(u, v) components of which two documents, of one block or of a pair of blocks, reach the similarity; a forest of them."""
    sides = [table.column("rows").combine_chunks()[k].values for k in range(len(table))]
    component, group = (np.concatenate([r.field(c).to_numpy() for r in sides]) for c in ("component", "grp"))
    hashes = [r.field("hashes").flatten().to_numpy() for r in sides]
    sizes = [r.field("hashes").value_lengths().to_numpy().astype(np.int64) for r in sides]
    names, place = np.unique(component, return_inverse=True)
    # the largest component of each group is only compared with, as one end of each pair lies in another one
    of = np.empty(len(names), group.dtype)
    of[place] = group
    by_size = np.lexsort((names, -np.bincount(place), of))
    largest = np.zeros(len(names), bool)
    largest[by_size[np.append(True, of[by_size][1:] != of[by_size][:-1])]] = True
    forest, u, v, starts = Forest(len(names)), [], [], [0, len(sizes[0])]
    for one in range(len(sides)):
        other = len(sides) - 1 - one
        mine, theirs = (place[starts[k] : starts[k] + len(sizes[k])] for k in (one, other))
        if not len(hashes[other]):
            continue
        count, ends = _common(hashes[other], sizes[other]), np.cumsum(sizes[one])
        for k in np.flatnonzero(~largest[mine]).tolist():
            common = count(hashes[one][ends[k] - sizes[one][k] : ends[k]])
            hit = theirs[common >= similarity * (sizes[one][k] + sizes[other] - common)]
            joined = forest.link(np.full(len(hit), mine[k]), hit)
            u.append(np.full(len(joined), names[mine[k]]))
            v.append(names[hit[joined]])
    none = np.empty(0, np.int64)
    return pa.table({"u": pa.array(np.concatenate([none, *u])), "v": pa.array(np.concatenate([none, *v]))})


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of the classes whose nodes are the column _n of ``wanted``, read from the text that names the class."""
    named = classes.join(wanted.hint("merge"), F.col("node") == F.col("_n"), "left_semi").select("node", F.col("rep").alias("_doc"), F.col("rep_mark").alias("_mark"))
    text = _marked(docs).join(named.hint("merge"), (F.col("doc") == F.col("_doc")) & (F.col("mark") == F.col("_mark")))
    text = text.select("node", "text").dropDuplicates(["node"])  # repeated rows
    return text.mapInArrow(by_text_chunks(partial(_set_batch, width=width)), "node long, hashes array<long>")


def joined_components(docs: DataFrame, classes: DataFrame, edges: DataFrame, true: DataFrame, components: DataFrame, width: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """(node, component) of the components (of the ``true`` edges) that untested candidates join.

    ``edges`` are forests that span all candidates, so a candidate between two
    components lies inside one group of components that failed edges tie
    together. In each such group all pairs of documents of different components
    are compared on their whole shingle sets, in blocks of about ``block`` elements.
    """
    at = [components.select(F.col("node").alias(f"n{c}"), F.col("component").alias(f"c{c}")).hint("merge") for c in "uv"]
    failed = edges.distinct().join(true, ["u", "v"], "left_anti").join(at[0], F.col("u") == F.col("nu"), "left").join(at[1], F.col("v") == F.col("nv"), "left")
    failed = failed.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    groups = connected_components(failed)
    nodes = edges.select(F.col("u").alias("_n")).union(edges.select("v")).distinct()
    nodes = nodes.join(at[0], F.col("_n") == F.col("nu"), "left").select("_n", F.coalesce("cu", "_n").alias("_c"))
    members = cut(nodes.join(groups.hint("merge"), F.col("_c") == F.col("node")).select("_n", F.col("_c"), F.col("component").alias("grp")))
    sets = _sets_of(docs, classes, members.select("_n"), width).withColumnRenamed("node", "_node").join(members, F.col("_node") == F.col("_n"))
    sets = cut(sets.select("_node", F.col("_c").alias("component"), "grp", "hashes"))
    total = sets.agg(F.sum(F.size("hashes").cast("long"))).first()[0] or 0
    sets = sets.withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(-(-total // block) or 1)))  # small groups share a block
    blocks = sets.groupBy("bucket").agg(F.ceil(F.sum(F.size("hashes").cast("long")) / F.lit(block)).alias("_blocks"))
    sets = sets.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("_node"), F.greatest("_blocks", F.lit(1))))
    packed = sets.groupBy("bucket", "block", "_blocks").agg(F.collect_list(F.struct("component", "grp", "hashes")).alias("rows"))
    sides = packed.select("bucket", "block", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("_blocks", F.lit(1)) - 1)).alias("other"))
    sides = sides.select("bucket", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "rows")
    join = partial(_join_blocks, similarity=similarity)
    more = sides.groupBy("bucket", "a", "b").applyInArrow(lambda key, table: join(table) if len(table) == 2 or key[1].as_py() == key[2].as_py() else _NO_EDGES, _EDGES)
    return connected_components(more)


def _grouped(docs: DataFrame, width: int, lanes: int, radius: int | None, similarity: float | None, distinct: bool, tile: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Fingerprints of the rows, classes (key, node, rep, rep_mark, root), and the columns of the key.

    A class holds the rows of equal fingerprints (and set sizes); its least row
    (by doc_id, then text hash) names it. Nodes are numbered in the order of
    these rows, so the least node of a component, its ``root``, has the least id.
    """
    if (radius is None) == (similarity is None):
        raise ValueError("give either radius or similarity")
    prints = cut(fingerprints(docs, width, lanes, distinct or similarity is not None))  # the sizes of sets bound their similarity
    key = ["fp"] if similarity is None else ["fp", "shingles"]
    if similarity is None:
        classes = prints.groupBy("fp").agg(F.min("doc").alias("rep"), F.first("shingles").alias("shingles")).withColumn("rep_mark", F.lit(0).cast("long"))
    else:
        classes = prints.groupBy(*key).agg(F.min(F.struct("doc", "mark")).alias("least")).select(*key, F.col("least.doc").alias("rep"), F.col("least.mark").alias("rep_mark"))
    classes = cut(classes.orderBy("rep", "rep_mark", *key).withColumn("node", F.monotonically_increasing_id()))
    if similarity is None:
        prune, allowed, worst, tiers = radius, None, None, (0.0,)
    else:
        allowed = allowed_distances(similarity, 64 * lanes)
        worst = np.maximum.accumulate(allowed_distances(similarity, 64 * min(2, lanes))[::-1])[::-1]
        prune, share = 64, hamming_for(similarity, 1 << 20) / (1 << 20)
        # the lowest tier begins three standard deviations below the threshold and takes in what lies lower
        bits, room = 64 * lanes * share, 3 * math.sqrt(64 * lanes * share * (1 - share))
        cosine = math.cos(math.pi * (bits + room) / (64 * lanes))
        estimate = cosine / (2 - cosine)
        tiers = tuple(estimate + (1 - estimate) * k / 5 for k in range(5))
    ones = F.bit_count(F.conv(F.hex(F.substring("fp", 1, 4)), 16, 10).cast("long")) + F.bit_count(F.conv(F.hex(F.substring("fp", 5, 4)), 16, 10).cast("long"))
    # one word's count of several says too little to rule out a tile
    ready = classes.withColumn("ones", ones.cast("int") if similarity is None else F.lit(0))
    counts = {r["ones"]: r["n"] for r in ready.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    first, tiles = {}, 0
    for p in range(65):
        first[p] = tiles
        tiles += -(-counts.get(p, 0) // tile)
    first[65] = tiles
    at = F.array(*[F.lit(first[min(65, max(0, p))]) for p in range(66)])
    own = F.get(at, F.col("ones"))
    spread = F.greatest(F.get(at, F.col("ones") + 1) - own, F.lit(1))
    dealt = ready.withColumn("tile", (own + F.pmod(F.xxhash64("fp", "shingles"), spread.cast("long"))).cast("int"))
    packed = dealt.groupBy("tile", "ones").agg(F.collect_list(F.struct("fp", "node", F.col("shingles"))).alias("rows"))
    lowest = F.get(at, F.greatest(F.col("ones") - prune, F.lit(0)))
    beyond = F.get(at, F.least(F.col("ones") + prune + 1, F.lit(65)))
    sides = packed.select("tile", "rows", F.explode(F.sequence(lowest, beyond - 1)).alias("other"))
    sides = sides.select("tile", "rows", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    # a pair of which one tile is empty has one side only and is not a tile with itself
    compare = partial(_compare_tiles, lanes=lanes, radius=radius, similarity=similarity, allowed=allowed, worst=worst, tiers=tiers)
    edges = sides.groupBy("a", "b").applyInArrow(lambda key, table: compare(table) if len(table) == 2 or key[0].as_py() == key[1].as_py() else _NO_EDGES, _EDGES)
    if similarity is None:
        components = connected_components(edges)
    else:
        edges = cut(edges)
        true = cut(verified(docs, classes, edges, width, similarity))
        components = connected_components(true)
    roots = components.select(F.col("node").alias("_node"), F.col("component").alias("root"))
    groups = classes.join(roots.hint("merge"), F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node"))
    if similarity is not None:
        moved = joined_components(docs, classes, edges, true, components, width, similarity).select(F.col("node").alias("_old"), F.col("component").alias("_new"))
        groups = groups.join(moved.hint("merge"), F.col("root") == F.col("_old"), "left").withColumn("root", F.coalesce("_new", "root"))
    return prints, groups.select(*key, "node", "rep", "rep_mark", "root"), key


def near_duplicates(
    docs: DataFrame, width: int = 5, lanes: int = 8, radius: int | None = None, similarity: float | None = 0.8, distinct: bool = True, tile: int = TILE
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text, anything else).

    Two documents are linked if their fingerprints differ in at most ``radius``
    bits, or, with ``similarity``, if the Jaccard similarity of their shingle
    sets reaches it. Then pairs are candidates unless their set sizes or the
    distance of their fingerprints rule the similarity out (see
    :func:`allowed_distances`), each tile pair keeps a spanning forest of every
    tier of estimates, and the forests' edges are verified on the texts. Where
    edges fail, all pairs of documents of the components on both sides are
    compared as well. component_id is the smallest doc_id reachable. Equal
    fingerprints (with equal set sizes) are one class and compared once.

    Null and empty texts have the fingerprint zero and are linked like others.
    Rows are what is linked: rows with different texts under one doc_id are
    documents of their own, which a shared doc_id does not tie together, and
    rows with a null doc_id get the component of their class (null if none of
    its rows has an id). Repeated rows are returned as often as they occur; an
    empty table gives an empty frame; other columns are ignored.
    """
    prints, groups, key = _grouped(docs, width, lanes, radius, similarity, distinct, tile)
    groups = cut(groups)
    # a component of many classes meets its root's id in shares
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    shares = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    names = groups.where(F.col("root") == F.col("node")).select(F.col("node").alias("_root"), F.col("rep").alias("_least"), shares.alias("_salt"))
    tied = groups.where(F.col("root") != F.col("node")).join(names, (F.col("root") == F.col("_root")) & (salt == F.col("_salt")))
    alone = groups.where(F.col("root") == F.col("node")).select(*key, F.col("rep").alias("component_id"))
    groups = alone.union(tied.select(*key, "_least")).select(*[F.col(k).alias(f"k_{k}") for k in key], "component_id")
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"k_{k}") for k in key])
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    out = prints.join(groups, same, "left").withColumnRenamed("doc", "doc_id")
    return out.select(known("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), known("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, lanes: int = 8, similarity: float = 0.8, tile: int = TILE) -> DataFrame:
    """The row of ``docs`` with the least doc_id (nulls last, then the least text hash) of each group of near-duplicates, all columns as they are.

    Groups are those of :func:`near_duplicates`; a text under a doc_id that
    another text has as well is judged for itself. Of repeated rows (equal
    doc_id and text) one stays, the one whose columns have the least hash; null
    and empty texts are one group; an empty table gives an empty frame.
    """
    own = [f"c{k}" for k in range(len(docs.columns))]  # names that clash with nothing
    kept = _grouped(docs, width, lanes, None, similarity, True, tile)[1].where(F.col("node") == F.col("root")).select(F.col("rep").alias("_doc"), F.col("rep_mark").alias("_mark"))
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    rows = docs.toDF(*own).withColumns({"doc": F.coalesce(doc_id.cast("long"), F.lit(NO_ID)), "mark": F.xxhash64(text.cast("string"))})
    rows = rows.join(kept.hint("merge"), (F.col("doc") == F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left_semi")
    plain = [c for c, f in zip(own, docs.schema, strict=True) if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    one = rows.groupBy("doc", "mark").agg(F.min_by(F.struct(*own), F.xxhash64(*plain)).alias("row"))
    return one.select("row.*").toDF(*docs.columns)
