import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import frame, prose

from timberline.llm import bpe

VOCABULARY = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe(bpe.load_ranks(VOCABULARY), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(VOCABULARY), special_tokens={})


def test_hash_is_minimal_and_perfect():
    keys = [f"key {k}".encode() for k in range(5000)]
    table = bpe.MinimalPerfectHash(keys)
    slots = table.slots(keys)
    assert sorted(slots.tolist()) == list(range(5000)) and (table.slot_key[slots] == np.arange(5000)).all()
    assert table.slots([b"other"])[0] < 5000


@pytest.mark.parametrize("text", ["", " ", "\n\n  x", "Hello, world's  end\t", "<|endoftext|>", "日本語 テキスト é", "a" * 3000, "ab" * 700 + "!?" * 400, " \xa0x", prose(3, 500)])
def test_equals_library(coder, library, text):
    assert coder.encode(text) == library.encode_ordinary(text)
    assert coder.decode(coder.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_library(text):
    coder, library = _pair()
    assert coder.encode(text) == library.encode_ordinary(text)


_CACHE = []


def _pair():
    if not _CACHE:
        ranks = bpe.load_ranks(VOCABULARY)
        _CACHE.extend([bpe.ByteBpe(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})])
    return _CACHE


def test_round_trip_of_awkward_rows(awkward, none, library):
    got = bpe.round_trip(awkward, VOCABULARY, P.PATTERN).collect()
    rows = awkward.select("doc_id", "text").collect()
    want = []
    for r in rows:
        ids = np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()
        want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.round_trip(none, VOCABULARY, P.PATTERN).count() == 0


def test_encode_column(spark, library):
    (row,) = bpe.encode(frame(spark, [(1, "some words here")]), VOCABULARY, P.PATTERN).collect()
    assert row.ids == library.encode_ordinary("some words here")


def test_memo_is_bounded(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 50)
    text = prose(9, 400)
    assert coder.encode(text) == library.encode_ordinary(text)
