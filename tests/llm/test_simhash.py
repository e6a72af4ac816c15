import re

import numpy as np
import xxhash
from llm_helpers import frame, prose
from pyspark.sql import functions as F

from timberline.llm import simhash


def brute_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints, radius):
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if i < j and (a ^ b).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


def test_equals_brute_force(spark):
    rows = [(k, prose(k // 3, 80 + k % 3)) for k in range(60)] + [(60 + k, "the same text again and again") for k in range(20)] + [(90, ""), (91, None), (92, "ÀB c"), (93, "Àb C")]
    got = simhash.near_duplicates(frame(spark, rows), width=4, lanes=1, radius=4, similarity=None, distinct=False, tile=7).collect()
    prints = [(i, brute_fingerprint(t, 4)) for i, t in rows]
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints}
    assert {r.doc_id: r.component_id for r in got} == brute_components(prints, 4)


def test_awkward_rows(awkward, none):
    got = simhash.near_duplicates(awkward, width=4, lanes=1, radius=4, similarity=None, distinct=False).collect()
    assert len(got) == awkward.count()
    by = {r.doc_id: r for r in got}
    assert by[0].fingerprint == by[1].fingerprint == by[2].fingerprint == "0" * 16
    assert by[0].component_id == by[9].component_id == 0 and by[5].component_id == 4
    assert simhash.near_duplicates(none).count() == 0


def test_similarity_mode_links_by_jaccard(spark):
    base = prose(5, 400).split()
    near, far = list(base), list(base)
    near[200] = "changed"
    for k in range(0, 400, 8):
        far[k] = f"other{k}"
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, prose(6, 400))])).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_similarity_mode_equals_brute_force(spark):
    import random

    r, rows = random.Random(11), []
    for base in range(8):
        words = prose(500 + base, 200).split()
        for copy in range(8):
            rows.append((len(rows), " ".join(f"edit{r.random()}" if r.random() < 0.004 * copy else w for w in words)))
    rows += [(100, "one two"), (101, "One TWO"), (102, "one two three"), (103, ""), (104, None)]
    sets = {i: set(simhash.shingle_hashes((t or "").encode(), 5, True).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            union = len(sets[i] | sets[j])
            if i < j and (not union or len(sets[i] & sets[j]) >= 0.8 * union) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(frame(spark, rows), tile=10).collect()}
    assert got == root and len(set(root.values())) > 12


def test_hot_group_of_near_copies(spark):
    base = prose(7, 200).split()
    rows = [(k, " ".join([*base[:50], f"edit{k}", *base[51:]])) for k in range(300)]
    got = simhash.near_duplicates(frame(spark, rows), tile=64).collect()
    assert {r.component_id for r in got} == {0}


def test_majority_bits_of_many_shingles():
    h = np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > 1000)
    assert int(simhash.majority_bits([h], 1)[0, 0]) == want


def test_short_documents_at_the_threshold(spark):
    """Four of five shingles: ties of the even set make the distance larger than the angle says."""
    rows = []
    for k in range(60):
        text = [f"w{k}x{n}" for n in range(9)]
        rows += [(2 * k, " ".join(text[:8])), (2 * k + 1, " ".join(text))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_allowed_distances_hold_for_sets_at_the_threshold():
    r = np.random.default_rng(3)
    for m, n, common in ((4, 5, 4), (12, 15, 12), (14, 13, 12), (20, 25, 20), (200, 250, 200), (180, 180, 160)):
        limits = simhash.allowed_distances(0.8, 512)
        for _ in range(300):
            h = r.integers(0, 1 << 63, m + n - common, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, m + n - common, dtype=np.uint64)
            a, b = simhash.majority_bits([h[:m], h[m - common :]], 8)
            assert int(np.bitwise_count(a ^ b).sum()) <= limits[min(m, n, simhash.SMALL)]


def _components_by_jaccard(rows):
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5, True).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_links_behind_failed_ones(spark):
    """Copies are linked to their base only (0.82), while the estimates between copies (0.67) make them candidates as well."""
    import random

    r, rows = random.Random(4), []
    for group in range(3):
        words = [f"g{group}w{k}" for k in range(204)]
        rows.append((1000 * group + 500, " ".join(words)))
        for copy in range(60):
            edited = {at + r.randint(0, 4) for at in r.sample(range(5, 195, 10), 4)}
            rows.append((1000 * group + copy, " ".join(f"c{copy}w{k}" if k in edited else w for k, w in enumerate(words))))
    want = _components_by_jaccard(rows)
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(frame(spark, rows), tile=50).collect()}
    assert got == want and len(set(want.values())) == 3


def test_blocks_of_sets_meet(spark):
    """The exact comparison does not depend on how documents are dealt into blocks."""
    rows = [(k, " ".join(f"w{n}" for n in range(40 + 2 * k))) for k in range(30)]
    edges = spark.createDataFrame([(k, 29) for k in range(29)], "u long, v long")
    none = edges.where("u < 0")
    want, docs = _components_by_jaccard(rows), frame(spark, rows)
    classes = simhash._marked(docs).select(F.col("doc").alias("node"), F.col("doc").alias("rep"), F.col("mark").alias("rep_mark"))
    for block in (100, 700, 1 << 21):
        got = simhash.joined_components(docs, classes, edges, none, none.toDF("node", "component"), 5, 0.8, block)
        assert {x.node: x.component for x in got.collect()} == want


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    a, b, c = prose(31, 80), prose(32, 80), prose(33, 80)
    rows = [(3, a), (5, a), (5, b), (9, b), (None, c), (None, a), (9, b)]
    docs = frame(spark, rows)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs, width=4, lanes=1, radius=4, similarity=None, distinct=False).collect()}
    prints = {t: f"{brute_fingerprint(t, 4):016x}" for t in (a, b, c)}
    assert got == {(3, prints[a]): 3, (5, prints[a]): 3, (None, prints[a]): 3, (5, prints[b]): 5, (9, prints[b]): 5, (None, prints[c]): None}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(map(repr, kept.select("doc_id", "text").collect())) == sorted(map(repr, frame(spark, [(3, a), (5, b), (None, c)]).select("doc_id", "text").collect()))
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_does_not_depend_on_partitions(spark):
    rows = [(k % 5 or None, prose(k % 7, 50 + k % 2)) for k in range(70)]
    docs = spark.createDataFrame([(i, t, k, {"m": k}) for k, (i, t) in enumerate(rows)], "doc_id long, text string, doc int, mark map<string,int>")
    one, two = (sorted(map(repr, simhash.one_of_each(docs.repartition(n, "doc")).collect())) for n in (1, 4))
    assert one == two and len({r for r in one}) == 7
