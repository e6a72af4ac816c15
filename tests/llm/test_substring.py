import re
from collections import Counter

import pyarrow as pa
import xxhash
from llm_helpers import frame, prose

from timberline.llm import substring


def grams(text, k=51):
    w = text.split()
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}


def run(docs):
    return {r.doc_id: r for r in substring.without_repeats(docs).collect()}


def test_passages_over_fifty_words_go_wherever_they_stand(spark):
    passage, unstopped = prose(100, 60), prose(101, 60).replace(".", "")
    rows = []
    for k in range(40):
        own = prose(k, 120).split()
        part = passage if k % 2 else unstopped
        rows.append((k, " ".join([*own[: 20 + k], part, *own[20 + k :]])))
    got = run(frame(spark, rows))
    seen = Counter(g for r in got.values() for g in grams(r.text))
    assert max(seen.values()) == 1
    assert got[0].text == rows[0][1] and got[1].text == rows[1][1] and got[0].removed_sentences == 0
    assert all(got[k].removed_sentences > 0 for k in range(2, 40))
    own = set(prose(7, 120).split())
    assert len(own - set(got[7].text.split())) < 30  # at most the passage's neighbours in a sentence


def test_clean_documents_stay(spark):
    rows = [(k, prose(1000 + k, 200)) for k in range(30)] + [(50, "Short. Text."), (51, "Short. Text."), (52, "one two three four five six seven.\n"), (53, "one two three four five six seven.\n")]
    got = run(frame(spark, rows))
    assert all(got[i].text == t for i, t in rows)


def cut(text):
    s = substring.split([text.encode()])
    return list(zip(s.start.tolist(), s.end.tolist(), s.words.tolist(), s.hash.tolist(), strict=True))


def test_equals_brute_force(spark):
    rows = [(k, " ".join(prose(s, 36) for s in (k % 5, k, (k + 1) % 5, 50 + k % 3))) for k in range(30)]
    seen, want = {}, {}
    for i, text in rows:
        parts, gone, raw = cut(text), set(), text.encode()
        words = [" ".join(raw[a:b].decode().split()) for a, b, _, _ in parts]
        for a in range(len(parts)):
            for b in range(a + 1, min(len(parts), a + 20) + 1):
                long = lambda x, y: y - x >= substring.MIN_SENTENCES and sum(c[2] for c in parts[x:y]) >= substring.MIN_WORDS  # noqa: B023, E731
                if long(a, b) and not (long(a, b - 1) and long(a + 1, b)):
                    if seen.setdefault(tuple(words[a:b]), (i, a)) != (i, a):
                        gone.update(range(a, b))
        want[i] = b"".join(raw[c[0] : c[1]] for k, c in enumerate(parts) if k not in gone).decode()
    got = run(frame(spark, rows))
    assert {i: r.text for i, r in got.items()} == want and any(r.removed_sentences for r in got.values())


def test_sentences_cover_the_text():
    texts = ["", " ", "a", ".", "...", "A. B! C?\n\nD", prose(1, 300).replace(".", ""), "中文 é。 句子", ' "Hi." she said. ', "x" * 10000, "\0 a \0", "end "]
    many = substring.split([t.encode() for t in texts])
    for k, text in enumerate(texts):
        parts, raw = cut(text), text.encode()
        assert b"".join(raw[a:b] for a, b, _, _ in parts) == (raw if text.split() else b"")
        mine = many.doc == k
        assert list(zip(many.start[mine].tolist(), many.end[mine].tolist(), many.words[mine].tolist(), many.hash[mine].tolist(), strict=True)) == parts
        assert all(w <= substring.LONG for _, _, w, _ in parts)
    assert [w for _, _, w, _ in cut('One two. "Three four!" five\nsix seven')] == [2, 2, 1, 2]


def test_awkward_rows(awkward, none):
    docs = awkward.withColumnRenamed("tile", "removed_sentences")
    rows = substring.without_repeats(docs).collect()
    assert len(rows) == awkward.count() and set(rows[0].asDict()) == set(docs.columns)
    assert sum(r.text is None for r in rows) == 2
    kept = {(r.doc_id, r.text) for r in rows}
    assert (5, "") in kept and sum(r.doc_id == 5 and r.text == "" for r in rows) == 2  # copies of 4, twice
    assert substring.without_repeats(none).count() == 0


def brute_word_hash(word):
    mask, (k0, k1, k2, k3, k4) = (1 << 64) - 1, map(int, substring._K)

    def mix(h):
        h = (h ^ h >> 32) * k3 & mask
        return h ^ h >> 29

    if len(word) > 24:
        return xxhash.xxh3_64_intdigest(word)
    h = len(word) * k4 & mask
    for at, k in ((0, k0), (8, k1), (16, k2)):
        h = mix(h ^ int.from_bytes(word[at : at + 8], "little") * k & mask)
    return h


def brute_split(text):
    """Lists of words: sentences end after a full stop or a line break; long ones are cut after words with chosen hashes, then every 16 words."""
    raw, words, ends = text.encode(), [], []
    for m in re.finditer(rb"[^\t\n\x0b\x0c\r ]+", raw):
        words.append(m[0])
        following = re.match(rb"[\t\n\x0b\x0c\r ]*", raw[m.end() :])[0]
        ends.append(m[0][-1:] in b".!?" or (len(m[0]) > 1 and m[0][-1:] in b"\"')]" and m[0][-2:-1] in b".!?") or b"\n" in following)

    def pieces(at):
        out = [[]]
        for word, stop in zip(words, at, strict=True):
            out[-1].append(word)
            if stop:
                out.append([])
        return [p for p in out if p]

    for bits in (7, 3, 1):
        ends = [e for p in pieces(ends) for e in [len(p) > 16 and brute_word_hash(w) >> 17 & bits == 0 for w in p[:-1]] + [True]]
    return [p[k : k + 16] for p in pieces(ends) for k in range(0, len(p), 16)]


def test_splitting_equals_brute_force():
    texts = [prose(s, n) for s, n in ((1, 300), (2, 17), (3, 16))] + [prose(4, 400).replace(".", ""), "a.\n\nb 'c.' d\te! " * 9, "same " * 50 + "end", "x" * 30 + " " + "y" * 25 + " z", "(Yes.) No", "中文 é。 句子 " * 20, ".", "\"'", "a\n" * 40]
    for text in texts:
        raw = text.encode()
        assert [raw[a:b].split() for a, b, _, _ in cut(text)] == brute_split(text), text
        assert [w for _, _, w, _ in cut(text)] == [len(p) for p in brute_split(text)]


def test_runs_that_share_one_hash_are_told_apart(spark, monkeypatch):
    """The second hash alone keeps different runs apart if the first one fails."""
    whole = substring.runs
    monkeypatch.setattr(substring, "runs", lambda s: (lambda f, n, h, c: (f, n, h * 0, c))(*whole(s)))
    rows = [(k, prose(k // 2, 60)) for k in range(20)]
    batches = [r for r in substring._run_rows(iter([pa.RecordBatch.from_pydict({"doc": [i for i, _ in rows], "mark": [i for i, _ in rows], "text": [t for _, t in rows]})]))]
    known = pa.Table.from_batches(batches).to_pandas().query("known")
    assert sorted(known["doc"].unique()) == list(range(1, 20, 2))
