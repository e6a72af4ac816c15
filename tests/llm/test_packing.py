import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import frame, prose
from tokenizers import Tokenizer

from timberline.llm import packing


def expand(patterns):
    return [[w for w, k in items for _ in range(k)] for items, n in patterns for _ in range(n)]


def exact(sizes, capacity):
    """The least number of bins, by search."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b >= sizes[k]:
                rest = list(bins)
                rest.remove(b)
                go(k + 1, [*rest, b - sizes[k]])
        go(k + 1, [*bins, capacity - sizes[k]])

    go(0, [])
    return best[0]


def counts(sizes):
    out = {}
    for s in sizes:
        out[s] = out.get(s, 0) + 1
    return out


def test_plan_uses_every_piece_once():
    r = random.Random(1)
    for _ in range(60):
        sizes = [min(1024, max(1, int(r.lognormvariate(5.5, 1.2)))) for _ in range(r.randint(0, 800))]
        bins = expand(packing.plan(counts(sizes)))
        assert sorted(w for b in bins for w in b) == sorted(sizes) and all(sum(b) <= 1024 for b in bins)
        assert len(bins) <= max(-(-sum(sizes) // 1024) * 1.25 + 1, sum(s > 512 for s in sizes) * 1.1 + 1)


def test_reduction_keeps_an_optimum():
    r = random.Random(2)
    for _ in range(150):
        sizes = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        fixed, rest = packing.reduce_by_dominance(counts(sizes), 20)
        left = [w for w, n in rest.items() for _ in range(n)]
        assert len(expand(fixed)) + (exact(left, 20) if left else 0) == exact(sizes, 20), sizes


def test_cut_points():
    assert packing.cut_points(1024) == [0] and packing.cut_points(1025) == [0, 1] and packing.cut_points(2048) == [0, 1024] and packing.cut_points(1) == [0]


def check(spark, docs):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    want = defaultdict(int)
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        at = packing.cut_points(len(ids))
        for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)):
            want[r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    have, sequences = defaultdict(int), defaultdict(list)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_awkward_rows(spark, awkward, none):
    check(spark, awkward)
    assert packing.pack_documents(none, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_special_strings_and_many_copies(spark):
    rows = [(k, prose(k % 7, 30 + k % 50)) for k in range(300)] + [(1000 + k, "copy " * 40) for k in range(400)] + [(5000, "a <|endoftext|> b")]
    n = check(spark, frame(spark, rows))
    assert n < 300


TOKENS = packing.Tokens(P.path("byte_bpe_50k.json"), P.PATTERN)
LIBRARY = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text("aAé中 \t\n\r\u00a0\u2028'sdl019.,!_<|endoftx>", max_size=80)))
def test_ids_equal_the_library(text):
    assert TOKENS.ranks is not None and TOKENS.ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_other_files_are_left_to_their_library(tmp_path):
    import json

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for k, change in enumerate(({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"ignore_merges": True}})):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(spec | change))
        tokens, library = packing.Tokens(str(path), P.PATTERN), Tokenizer.from_file(str(path))
        assert tokens.ranks is None and tokens.ids("Hello World").tolist() == library.encode("Hello World", add_special_tokens=False).ids
    assert packing.Tokens(P.path("byte_bpe_50k.json"), r"\S+|\s+").ranks is None


def test_buckets_do_not_change_the_law(spark, monkeypatch):
    rows = [(k % 50, 0, 0, 300 + k % 3, 7) for k in range(400)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(5)
    for together in (7, 1 << 18):
        monkeypatch.setattr(packing, "RANKED_TOGETHER", together)
        got = packing.pack(parts).collect()
        assert sorted((r.doc_id, r.length) for r in got) == sorted((r[0], r[3]) for r in rows)
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            b.sort()
            assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:], strict=False)) and sum(b[-1]) <= 1024
