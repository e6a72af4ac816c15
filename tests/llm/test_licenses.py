import re

import pytest
from llm_helpers import frame, prose

from timberline.llm import licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_base(text):
    """(n_words, places as (start, label)) word by word."""
    w, found = words(text), []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    return len(w), sorted(found)


def brute_score(text, notice):
    """The best score of a notice in a text that has it once: template words in equal runs, on diagonals tied by SHIFT."""
    w, t, g = words(text), words(notice), licenses.GRAM
    at = {}
    for p in range(len(w) - g + 1):
        for q in range(len(t) - g + 1):
            if w[p : p + g] == t[q : q + g]:
                at.setdefault(p - q, set()).add(q)
    kept = sorted((d, q) for d, q in at.items() if len(q) >= licenses.MIN_VOTES)
    best, k = 0.0, 0
    while k < len(kept):
        span = [kept[k]]
        while k + 1 < len(kept) and kept[k + 1][0] - kept[k][0] <= licenses.SHIFT:
            k += 1
            span.append(kept[k])
        k += 1
        seen = {x for _, qs in span for q in qs for x in range(q, q + g)}
        start, end = min(d + min(q) for d, q in span), max(d + max(q) + g for d, q in span)
        best = max(best, len(seen) / max(len(t), end - start))
    return best


def check_base(rows, texts):
    for r in rows:
        n, found = brute_base(texts[r.doc_id])
        assert r.n_words == n and r.n_base == len(found)
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1 or not found) and (r.score > 0) == bool(r.labels)


def test_phrases_equal_brute_force(spark):
    texts = {
        0: "Released under the MIT License.", 1: "CC BY-NC 4.0 and cc-by-nc; cc by nc", 2: "under the\nMIT (license) under the mit licensé", 3: "Apache License, Version 2.0, apache license version 20",
        4: "under under the mit license", 5: "xcc by nc", 6: "cc by ncé", 7: "cc\x00by\x7fnc", 8: "ＣＣ by nc under the mit license" * 2, 9: prose(3, 200) + " CC-BY-NC " + prose(4, 200), 10: "by nc", 11: "CC BY nC", 12: "cc by nc " * 3000,
    }
    got = licenses.scan(frame(spark, texts.items())).collect()
    assert len(got) == len(texts)
    check_base(got, texts)


def test_notices_with_words_put_in_left_out_and_replaced(spark):
    apache, gpl3, mit = licenses.NOTICES[1][0], licenses.NOTICES[2][0], licenses.NOTICES[0][0]
    cut = gpl3.split()
    texts = {
        0: gpl3, 1: gpl3.replace("version 3", "version 2"), 2: " ".join(cut[:12] + ["kindly"] + cut[12:]), 3: " ".join(cut[:9] + cut[11:]), 4: " ".join(cut[:15]),
        5: prose(1, 300) + mit + prose(2, 300), 6: "licensed under the GNU Lesser General Public License version 3", 7: "This work is licensed under the GNU General Public License, version 3.", 8: apache.upper(), 9: prose(5, 500), 10: mit + " " + gpl3,
    }
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts.items())).collect()}
    check_base(got.values(), texts)
    want = {0: "gpl-3", 1: "gpl-2", 2: "gpl-3", 3: "gpl-3", 4: "", 5: "mit", 6: "lgpl-3", 7: "gpl-3", 8: "apache-2", 9: "", 10: "gpl-3,mit"}
    assert {k: r.labels for k, r in got.items()} == want
    for k, notice in ((2, gpl3), (3, gpl3), (5, mit), (6, licenses.NOTICES[6][0])):
        assert got[k].score == pytest.approx(brute_score(texts[k], notice), abs=1e-9)
    n = len(words(mit))
    assert got[10].notices == f"mit:0:{n},gpl-3:{n}:{n + len(words(gpl3))}"


def test_awkward_rows(awkward, none):
    got = licenses.scan(awkward).collect()
    assert len(got) == awkward.count() and all(r.n_base == 0 and r.score == 0 for r in got)
    texts = {r.doc_id: r.text for r in awkward.collect()}
    assert all(r.n_words == len(words(texts[r.doc_id])) for r in got)
    assert licenses.scan(none).collect() == []


def test_copies_count_once_each_and_stay(spark):
    rows = [(k, "x Under the MIT license y" if k % 3 else None) for k in range(300)] + [(None, "cc by nc")] * 3
    got = licenses.scan(frame(spark, rows)).collect()
    assert len(got) == 303 and sum(r.n_base for r in got) == 203
    assert {(r.n_base, r.first_word, r.labels) for r in got if r.doc_id is None} == {(1, 0, "cc-by-nc")}


def test_no_python_in_the_plan(spark, capsys):
    licenses.scan(frame(spark, [(1, "a")])).select("n_words", "labels").explain()
    assert "Python" not in capsys.readouterr().out.replace("ExistingRDD", "")


def test_short_templates_are_refused(spark):
    with pytest.raises(Exception, match="too few words"):
        licenses.scan(frame(spark, [(1, "a b c")]), phrases=(("mit license", "mit"),)).collect()
