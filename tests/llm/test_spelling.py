import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_helpers import frame, prose

from timberline.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(word, letters):
    """Every string one edit away, by the definition."""
    cuts = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters} - {word}


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    letters, out = set("".join(n)), {}
    for w in n:
        near = sorted((x for x in edits(w, letters) - {w} if x in n), key=lambda x: (-n[x], x))
        out[w] = (near[0] if near and n[near[0]] >= 10 * n[w] else None, len(near))

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {w: (form, root(w), n[w], near, n[form] if form else None) for w, (form, near) in out.items()}


def corpus(seed, docs, letters="abcdéÉ"):
    """Few letters, so that words have many near ones; frequencies that form chains of forms."""
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randint(6, 9))) for _ in range(30)]

    def word():
        w = base[min(int(r.expovariate(0.25)), 29)]
        while r.random() < 0.12:
            k = r.randrange(len(w))
            w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k + 1 :], w[:k] + r.choice(letters) + w[k:]])
        return w.upper() if r.random() < 0.1 else w

    return [(k, r.choice([" ", ", ", "-", "\n"]).join(word() for _ in range(r.randint(0, 120)))) for k in range(docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed, 250) + [(900, "bdcabdca " * 900 + "bdcabdcb " * 60 + "bdcabccb " * 4)]
    want = brute(rows)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(frame(spark, rows)).collect()}
    assert got == want
    assert any(f for f, *_ in want.values()) and any(f and root != f for f, root, *_ in want.values())


def test_ties_lengths_and_case(spark):
    rows = [(0, "zebrass zebrass zebrast zebrast " * 10 + "zebrasx zebrasx"), (1, "ÉCLAIRS éclairs Éclairs éclairs"), (2, "×××××××÷ ×××××××÷ aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa")]
    want = brute(rows)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(frame(spark, rows)).collect()}
    assert got == want and got["zebrasx"][0] == min("zebrass", "zebrast")


def test_neighbours_are_all_and_distinct():
    letters = "abcxé"
    for word in ("aabbcca", "abcabcx", "ééééééé"):
        spelt = np.array([[letters.index(c) for c in word]] * 2)
        found = list(spelling.neighbours(spelt, letters, lambda h: np.ones(h.shape, bool)))
        for row in (0, 1):
            mine = [t for r, t in found if r == row]
            assert len(mine) == len(set(mine)) and set(mine) == edits(word, letters) - {word}


def test_hashes_of_neighbours_are_those_of_the_strings():
    letters, word, seen = "abcdé", "abbacdé", []

    def keep(h):
        seen.append(h.copy())
        return np.ones(h.shape, bool)

    spelt = np.array([[letters.index(c) for c in word]])
    found = {t for _, t in spelling.neighbours(spelt, letters, keep)}
    numbers = spelling._numbers(letters)
    own = {int((numbers[[letters.index(c) for c in t]] * spelling._powers(len(t))[:-1]).sum(dtype=np.uint64)) for t in found}
    assert own <= {int(x) for h in seen for x in h.ravel()} and len(own) == len(found)


def test_awkward_rows(spark, awkward, none):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(awkward).collect()}
    assert got == brute(rows)
    assert spelling.group_variants(none).collect() == []
    assert spelling.group_variants(frame(spark, [(1, "short words only"), (2, None)])).collect() == []
    once = frame(spark, [(k, prose(k, 80)) for k in range(40)])
    twice = {r.word: r.n for r in spelling.group_variants(once.union(once)).collect()}
    assert all(twice[r.word] == 2 * r.n for r in spelling.group_variants(once).collect())


def test_roots_of_long_ways(spark):
    ways = [(f"w{k:03d}", f"w{k + 1:03d}") for k in range(100)] + [("x", "y")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(ways, "word string, form string")).collect()}
    assert got == {f"w{k:03d}": "w100" for k in range(100)} | {"x": "y"}
